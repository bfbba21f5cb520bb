"""Crossings of volume lines: price-volume trend, force index and the Klinger oscillator, each against zero or its own mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.windows import BARS as P

#: Signal -> rule over the columns of :func:`volume_lines` and theirs of the bar before.
VOLUME_LINE_SIGNALS: dict[str, str] = {
    "PVT_CROSS_UP": "pvt > pvt_mean AND pvt_1 <= pvt_mean_1", "PVT_CROSS_DN": "pvt < pvt_mean AND pvt_1 >= pvt_mean_1",
    "FORCE_INDEX_BULL": "force > 0 AND force_1 <= 0", "FORCE_INDEX_BEAR": "force < 0 AND force_1 >= 0",
    "KLINGER_CROSS_UP": "klinger > klinger_mean AND klinger_1 <= klinger_mean_1", "KLINGER_CROSS_DN": "klinger < klinger_mean AND klinger_1 >= klinger_mean_1",
}
LINES = ("pvt", "pvt_mean", "force", "klinger", "klinger_mean")


def volume_lines(bars: DataFrame, force: int = 13, fast: int = 34, slow: int = 55, mean: int = 13, pvt_mean: int = 20, signed: bool = False) -> DataFrame:
    """Adds the price-volume trend (percent changes times volume, from the second bar on) and its exponential mean, the force index, and
    the Klinger oscillator with its mean, and each of the bar before.  ``signed`` gives the oscillator's volume the sign of the close's change;
    without it, it compares two means of plain volume."""
    change = F.col("close") - P.lag("close")
    side = F.when(change > 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0)
    f = bars.withColumns({"__pvt": P.cum(F.sum(100 * change / P.lag("close") * F.col("volume"))), "__force": change * F.col("volume"), "__v": side * F.col("volume")})
    f = scans.ewma(f, {
        "pvt_mean": (F.col("__pvt"), 2 / (pvt_mean + 1)), "force": (F.col("__force"), 2 / (force + 1)), "__fast": (F.col("__v"), 2 / (fast + 1)), "__slow": (F.col("__v"), 2 / (slow + 1)),
    })
    f = f.withColumns({"pvt": F.col("__pvt"), "klinger": F.col("__fast") - F.col("__slow")})
    f = scans.ewma(f, {"klinger_mean": (F.col("klinger"), 2 / (mean + 1))})
    return f.withColumns({f"{c}_1": P.lag(c) for c in LINES}).select(*bars.columns, *LINES, *[f"{c}_1" for c in LINES])
