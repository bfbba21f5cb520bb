"""Chart patterns from sequences of confirmed pivots, and the event chains of accumulation and distribution.

A pattern is a rule over up to five alternating pivots, a level and a direction.  Each pivot row carries
its followers by ``lead``; the breakout is the first close beyond the level within the bars after the last
pivot is known, taken from an array that the confirmation bar carries, so the join is on equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P
from tapewright.operators.pivots import pivots

WAIT = 30
#: pattern -> (number of pivots, first kind, rule, level, direction).  p0..p4 are prices, b0..b4 bar numbers.
CHARTS: dict[str, tuple[int, str, str, str, str]] = {
    "INVERSE_HEAD_SHOULDERS": (5, "L", "p2 < p0 * 0.99 AND p2 < p4 * 0.99 AND abs(p4 / p0 - 1) <= 0.05 AND abs(p3 / p1 - 1) <= 0.05", "(p1 + p3) / 2", "up"),
    "HEAD_SHOULDERS_TOP": (5, "H", "p2 > p0 * 1.01 AND p2 > p4 * 1.01 AND abs(p4 / p0 - 1) <= 0.05 AND abs(p3 / p1 - 1) <= 0.05", "(p1 + p3) / 2", "down"),
    "DOUBLE_TOP": (3, "H", "abs(p2 / p0 - 1) <= 0.03 AND b2 - b0 BETWEEN 5 AND 120", "p1", "down"),
    "CUP_HANDLE": (4, "H", "abs(p2 / p0 - 1) <= 0.05 AND (p2 - p1) / p2 BETWEEN 0.04 AND 0.4 AND (p2 - p3) / p2 <= 0.5 * (p2 - p1) / p2 AND b2 - b0 >= 15", "p2", "up"),
    "ASCENDING_TRIANGLE": (5, "H", "abs(p2 / p0 - 1) <= 0.03 AND abs(p4 / p2 - 1) <= 0.03 AND p3 > p1", "greatest(p0, p2, p4)", "up"),
    "DESCENDING_TRIANGLE": (5, "L", "abs(p2 / p0 - 1) <= 0.03 AND abs(p4 / p2 - 1) <= 0.03 AND p3 < p1", "least(p0, p2, p4)", "down"),
    "RECTANGLE": (4, "H", "abs(p2 / p0 - 1) <= 0.03 AND abs(p3 / p1 - 1) <= 0.03 AND b3 - b0 >= 15", "greatest(p0, p2)", "up"),
}


def sequences(bars: DataFrame) -> DataFrame:
    """Each pivot with the prices and bars of the four after it, and when each is known."""
    w = Window.partitionBy("symbol").orderBy("bar_ix", "kind")
    p = pivots(bars)
    return p.select(
        "symbol", "kind", *[(F.lead(c, n).over(w) if n else F.col(c)).alias(f"{k}{n}") for n in range(5) for k, c in (("p", "price"), ("b", "bar_ix"), ("k", "confirmed_ix"))]
    )


def chart_patterns(bars: DataFrame) -> DataFrame:
    """(symbol, pattern, start_ix, end_ix, level, breakout_date, target) of every pattern that breaks out in time."""
    s = sequences(bars)
    found = F.filter(F.array(*[
        F.when((F.col("kind") == kind) & F.col(f"p{n - 1}").isNotNull() & F.expr(rule), F.struct(
            F.lit(name).alias("pattern"), F.expr(level).alias("level"), F.lit(1 if side == "up" else -1).alias("side"), F.col(f"b{n - 1}").alias("end_ix"), F.col(f"k{n - 1}").alias("known_ix"),
            (F.greatest(*[F.col(f"p{i}") for i in range(n)]) - F.least(*[F.col(f"p{i}") for i in range(n)])).alias("height"),
        )) for name, (n, kind, rule, level, side) in CHARTS.items()
    ]), lambda x: x.isNotNull())
    rows = s.select("symbol", F.col("b0").alias("start_ix"), F.explode(found).alias("f")).select("symbol", "start_ix", "f.*")
    ahead = bars.withColumn("path", F.collect_list(F.struct("bar_ix", "close", "trade_date")).over(P.FWD(WAIT))).select("symbol", F.col("bar_ix").alias("known_ix"), "path")
    hit = F.filter("path", lambda x: (x["close"] - F.col("level")) * F.col("side") > 0)
    out = rows.join(ahead, ["symbol", "known_ix"]).withColumn("hit", F.try_element_at(hit, F.lit(1))).filter("hit is not null")
    return out.select("symbol", "pattern", "start_ix", "end_ix", "level", F.col("hit.trade_date").alias("breakout_date"), (F.col("level") + F.col("side") * F.col("height")).alias("target"))


#: Fixed values: labels by side, and the limits of each event.
CAMPAIGNS = {1: ("accumulation", "PS", "SC", "AR", "ST", "SPRING", "TEST", "SOS", "LPS"), -1: ("distribution", "PSY", "BC", "AR", "ST", "UT", None, "SOW", "LPSY")}
CLIMAX_VOLUME, CLIMAX_SPREAD, CLIMAX_CLOSE, EARLY_VOLUME = 1.6, 1.2, 0.4, 1.25
RALLY_BARS, TEST_WITHIN, TEST_VOLUME = 25, (4, 29), 0.85
RANGE_BARS, RANGE_LEAST, RANGE_EDGE, RECENT = 40, 20, 3, 20
QUIET_BARS, QUIET_VOLUME, STRONG_VOLUME, PULLBACK_BARS = 8, 0.8, 1.3, 10


def campaign_events(bars: DataFrame, last: int = 120, least: int = 60) -> DataFrame:
    """(symbol, campaign, event, trade_date, price) over the last bars of symbols that have at least ``least``.

    Both sides are one chain: for distribution prices change their sign, so that lows are highs.  Every link is a pick
    among the bars of (symbol, side), laid beside all of them by a window over the same key: one shuffle, no joins."""
    side, key = F.col("side"), Window.partitionBy("symbol", "side")
    year = bars.withColumns({"n": F.count("*").over(Window.partitionBy("symbol")), "newest": F.max("bar_ix").over(Window.partitionBy("symbol"))}).filter(
        (F.col("n") >= least) & (F.col("bar_ix") > F.col("newest") - last)
    )
    w = year.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        "symbol", "side", "trade_date", "volume", F.row_number().over(key.orderBy("bar_ix")).alias("i"), F.count("*").over(key).alias("n"),
        (F.col("open") * side).alias("open"), (F.col("close") * side).alias("close"),
        F.when(side > 0, F.col("low")).otherwise(-F.col("high")).alias("low"), F.when(side > 0, F.col("high")).otherwise(-F.col("low")).alias("high"),
    )
    before = key.orderBy("i").rowsBetween(-20, -1)
    spread = F.col("high") - F.col("low")
    w = w.withColumns({
        "usual": F.avg("volume").over(before), "usual_spread": F.avg(spread).over(before), "known": F.count("*").over(before) == 20,
        "floor": F.min("low").over(key), "ceiling": F.max("high").over(key),
    })
    bar = F.struct("i", "trade_date", "open", "close", "low", "high", "volume", "usual")
    i, down, busy = F.col("i"), F.col("close") < F.col("open"), F.try_divide("volume", "usual")
    first, latest = (lambda when: F.min_by(bar, F.when(when, i)).over(key)), (lambda when: F.max_by(bar, F.when(when, i)).over(key))
    most = lambda when, *by: F.max_by(bar, F.when(when, F.struct(*by, -i))).over(key)
    depth = F.coalesce(F.try_divide(F.col("ceiling") - F.col("low"), F.col("ceiling") - F.col("floor")), F.lit(1.0))
    is_climax = F.col("known") & (busy >= CLIMAX_VOLUME) & (spread >= CLIMAX_SPREAD * F.col("usual_spread")) & down & (F.col("close") - F.col("low") <= CLIMAX_CLOSE * spread)
    w = w.withColumn("climax", most(is_climax, busy * depth)).filter(F.col("climax.i") < F.col("n") - 4)
    w = w.withColumns({
        "early": latest(F.col("known") & (i < F.col("climax.i")) & (busy >= EARLY_VOLUME) & down & (F.col("low") > F.col("climax.low"))),
        "rally": most(i.between(F.col("climax.i") + 1, F.col("climax.i") + RALLY_BARS), F.col("high")),
        "bars": F.least(F.lit(RANGE_BARS), F.col("n") - F.col("climax.i") + 1),
    })
    core = (F.col("bars") >= RANGE_LEAST) & (i > F.col("n") - F.col("bars")) & (i <= F.col("n") - RANGE_EDGE)
    quiet = F.col("volume") < TEST_VOLUME * F.least(F.col("climax.volume"), F.col("usual"))
    w = w.withColumns({
        "retest": first(i.between(*[F.col("rally.i") + b for b in TEST_WITHIN]) & (F.col("low") <= F.col("climax.low") * (1 + 0.025 * side)) & quiet),
        "bottom": F.least(F.min(F.when(core, F.col("low"))).over(key), F.col("climax.low")), "top": F.max(F.when(core, F.col("high"))).over(key),
    })
    w = w.withColumn("shake", latest((i >= F.greatest(F.col("climax.i"), F.col("n") - RECENT + 1)) & F.col("top").isNotNull() & (F.col("low") < F.col("bottom")) & (F.col("close") > F.col("bottom"))))
    usual = F.col("shake.usual")
    w = w.withColumns({
        "quiet": first(i.between(F.col("shake.i") + 1, F.col("shake.i") + QUIET_BARS) & (F.col("low") > F.col("shake.low")) & (F.col("volume") < QUIET_VOLUME * usual)),
        "strong": latest((i > F.col("shake.i")) & (F.col("close") > F.col("top")) & (F.col("volume") > STRONG_VOLUME * usual)),
    })
    near_top = F.col("close") > F.col("top") * (1 - 0.02 * side)
    w = w.withColumn("pullback", first(i.between(F.col("strong.i") + 1, F.col("strong.i") + PULLBACK_BARS) & near_top & (F.col("close") < F.col("strong.close"))))
    links = ("early", "climax", "rally", "retest", "shake", "quiet", "strong", "pullback")
    names = F.when(side > 0, F.array(*map(F.lit, CAMPAIGNS[1][1:]))).otherwise(F.array(*map(F.lit, CAMPAIGNS[-1][1:])))
    found = F.arrays_zip(names.alias("event"), F.array(*[F.col(x) for x in links]).alias("bar"))
    out = w.filter(i == F.col("n")).select("symbol", "side", F.explode(found).alias("f")).filter("f.event IS NOT NULL AND f.bar IS NOT NULL")
    price = F.when(F.col("f.event") == "AR", F.col("f.bar.high")).otherwise(F.col("f.bar.close")) * side
    return out.select("symbol", F.when(side > 0, CAMPAIGNS[1][0]).otherwise(CAMPAIGNS[-1][0]).alias("campaign"), F.col("f.event").alias("event"), F.col("f.bar.trade_date").alias("trade_date"), price.alias("price"))
