"""Replay of the accumulation detector over the whole history: what followed each signal, how that compares to any
bar, and which limit-up days it had seen coming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import wilson
from tapewright.functions.windows import BARS as P
from tapewright.functions.windows import run_length
from tapewright.operators.detectors import stealth_accumulation

#: Bars ahead, the largest move that is no corporate action, bars in which a limit-up day counts as seen, classes by strength.
HORIZONS = (5, 10, 20)
MOST_MOVE = 0.11
CAPTURE = 20
CLASSES = ("WATCH", "READY", "EXTREME")
FIRST_BAR, FIRST_LIMIT_BAR, BASE_EVERY = 31, 41, 5


def circuit_limit(bars: DataFrame, least: float = 0.05, most: float = MOST_MOVE, bin_width: float = 0.0025) -> DataFrame:
    """One row: where positive returns pile up (the lower edge of the fullest bin in (least, most], the lowest of equal ones), 0.1 without any.
    Bins are counted where the rows lie; their number does not depend on the data."""
    r = bars.select((F.col("close") / P.lag("close") - 1).alias("r")).filter((F.col("r") > least) & (F.col("r") <= most))
    bins = F.least(F.floor((F.col("r") - least) / bin_width).cast("int"), F.lit(int(round((most - least) / bin_width)) - 1))
    counted = r.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))
    best = counted.agg(F.max(F.struct("n", (-F.col("bin")).alias("low"))).alias("m"))
    return best.select(F.coalesce(F.round(least - F.col("m.low") * bin_width, 4), F.lit(0.1)).alias("circuit"))


def replayed(bars: DataFrame) -> DataFrame:
    """Each bar with its signal as of that bar, what followed (entry at the next open; null where it is not known or a corporate action
    lies within the horizon), whether it closed locked at the limit, and whether such a day follows within 20 bars."""
    f = stealth_accumulation(bars)
    longest = max(HORIZONS)
    f = f.withColumns({"__jump": F.abs(F.lead("close").over(P.base) / F.col("close") - 1), "__entry": F.lead("open").over(P.base), "ret": F.col("close") / P.lag("close") - 1})
    # the moves into the 20 bars that follow
    clean = F.coalesce(F.max("__jump").over(P.base.rowsBetween(0, longest - 1)) <= MOST_MOVE, F.lit(True)) & (F.col("__entry") > 0)
    f = f.withColumns({f"r{h}": F.when(clean, 100 * (F.lead("close", h).over(P.base) / F.col("__entry") - 1)) for h in HORIZONS} | {"followed": F.coalesce(clean, F.lit(False))})
    # the limit is one row
    f = f.crossJoin(F.broadcast(circuit_limit(bars)))
    lock = (F.col("ret") >= F.col("circuit") - 0.005) & (F.col("ret") <= MOST_MOVE) & (F.col("close") >= 0.999 * F.col("high"))
    f = f.withColumn("limit_up", F.coalesce(lock, F.lit(False)))
    f = f.withColumns({
        "limit_follows": F.coalesce(F.max(F.col("limit_up").cast("int")).over(P.FWD(20)) == 1, F.lit(False)),
        "new_signal": (F.col("signal_type") != "NO_SIGNAL") & ((F.col("bar_ix") == FIRST_BAR) | ((F.col("bar_ix") > FIRST_BAR) & (P.lag("signal_type") == "NO_SIGNAL"))),
        "is_base": (F.col("bar_ix") >= FIRST_BAR) & ((F.col("bar_ix") - 1) % BASE_EVERY == 0),
    })
    return f.drop("__jump", "__entry")


def _share(by: list[str], rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Share of rows with the flag, with an interval that lets rows of one date move together; Wilson's with one date."""
    per_date = rows.filter(flag.isNotNull()).groupBy(*by, "trade_date").agg(F.count("*").alias("m"), F.count_if(flag).alias("k"))
    total = Window.partitionBy(*by)
    p = F.sum("k").over(total) / F.sum("m").over(total)
    spread = per_date.withColumns({"p": p, "g": F.count("*").over(total)}).groupBy(*by).agg(
        F.sum("m").alias("n"), F.sum("k").alias("k"), F.first("p").alias("p"), F.first("g").alias("g"),
        F.sum(F.pow(F.col("k") - F.col("p") * F.col("m"), F.lit(2.0))).alias("ss"),
    )
    half = 1.96 * F.sqrt(F.try_divide(F.col("ss") * F.col("g"), F.col("g") - 1)) / F.col("n")
    low, high = wilson(F.col("k"), F.col("n"))
    one = F.col("g") < 2
    pct = lambda c: F.round(100 * c, 4)
    return spread.select(
        *by, pct(F.col("p")).alias(name), pct(F.when(one, low).otherwise(F.greatest(F.lit(0.0), F.col("p") - half))).alias(f"{name}_low"),
        pct(F.when(one, high).otherwise(F.least(F.lit(1.0), F.col("p") + half))).alias(f"{name}_high"),
    )


def replay_summary(f: DataFrame) -> DataFrame:
    """By class of signal, for all signals, and for every fifth bar (``BASE``): rows, dates, and at each horizon the mean, the median and the share
    of rises with its interval; last the share that a limit-up day followed."""
    groups = F.array_compact(F.array(F.when(F.col("new_signal"), F.col("signal_type")), F.when(F.col("new_signal"), F.lit("ALL")), F.when(F.col("is_base"), F.lit("BASE"))))
    rows = f.filter("followed").select("trade_date", "limit_follows", *[f"r{h}" for h in HORIZONS], F.explode(groups).alias("class"))
    aggs = [F.count("*").alias("n"), F.count_distinct("trade_date").alias("n_dates")]
    for h in HORIZONS:
        aggs += [F.round(F.avg(f"r{h}"), 6).alias(f"mean_{h}"), F.round(F.percentile(f"r{h}", F.lit(0.5)), 6).alias(f"median_{h}")]
    out = rows.groupBy("class").agg(*aggs)
    for name, flag in [(f"up_{h}", F.col(f"r{h}") > 0) for h in HORIZONS] + [("limit_up", F.col("limit_follows"))]:
        out = out.join(_share(["class"], rows, flag, name), "class", "left")
    return out


def limit_days(f: DataFrame) -> DataFrame:
    """The first bar of each run of limit-up days: how long the run is, whether any signal came in the bars before it, the strongest one, and what
    kept the detector silent on the bar before."""
    best = F.greatest(*[F.when(F.col("signal_type") == c, i + 1).otherwise(0) for i, c in enumerate(CLASSES)])
    gates = [("consolidation", "consolidating"), ("MACD", "macd_ok"), ("supply", "dry_supply"), ("absorption", "absorption"), ("OBV", "divergence")]
    silent = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates])), ",")
    # how many limit-up days follow in a row, this one included: the run's length counted from behind
    marked = f.withColumns({"__best": best, "__silent": silent, "__back": -F.col("bar_ix")})
    marked = run_length(marked, F.col("limit_up"), "__run", type(P)("symbol", "__back"))
    marked = marked.withColumns({
        "prior_best": F.max("__best").over(P.WP(CAPTURE)), "score_before": P.lag("score"), "missing_before": P.lag("__silent"),
        "starts": F.col("limit_up") & ~F.coalesce(P.lag("limit_up"), F.lit(False)),
    })
    names = F.array(*[F.lit(c) for c in CLASSES])
    return marked.filter(F.col("starts") & (F.col("bar_ix") >= FIRST_LIMIT_BAR)).select(
        "symbol", "trade_date", F.round(100 * F.col("ret"), 6).alias("ret_pct"), F.col("__run").alias("locks"), (F.col("prior_best") > 0).alias("caught"),
        F.get(names, F.col("prior_best") - 1).alias("best_class"), "score_before", "missing_before",
    )
