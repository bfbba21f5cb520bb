"""Inference over events: Wilson and cluster-robust intervals, two-way clustered effects,
false-discovery control, calibration, barrier labels, walk-forward splits, trade statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import wilson
from tapewright.functions.windows import BARS as P


def hit_rates(hits: DataFrame, by: list[str], hit: str) -> DataFrame:
    """Share of hits with its Wilson interval."""
    out = hits.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("int")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select(*by, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def cluster_interval(df: DataFrame, by: list[str], cluster: str, value: str, z: float = 1.96) -> DataFrame:
    """Mean with a standard error that lets values of one cluster (a date) move together: residuals are
    summed by cluster first, so the second aggregation sees one row for each cluster."""
    parts = df.groupBy(*by, cluster).agg(F.count("*").alias("m"), F.sum(value).alias("s"))
    mean = parts.groupBy(*by).agg((F.sum("s") / F.sum("m")).alias("mean"), F.sum("m").alias("n"), F.count("*").alias("clusters"))
    out = parts.join(mean, by).groupBy(*by).agg(
        F.first("mean").alias("mean"), F.first("n").alias("n"), F.first("clusters").alias("clusters"),
        F.sum(F.pow(F.col("s") - F.col("m") * F.col("mean"), F.lit(2.0))).alias("ss"),
    )
    g = F.col("clusters")
    se = F.sqrt(F.col("ss") * F.when(g > 1, g / (g - 1))) / F.col("n")
    return out.select(*by, "n", "clusters", F.round("mean", 6).alias("mean"), F.round(se, 6).alias("se"), F.round(F.col("mean") - z * se, 6).alias("low"), F.round(F.col("mean") + z * se, 6).alias("high"))


_SUMS = ("xy", "x", "y", "xx", "m")


def two_way_effect(df: DataFrame, flag: str, value: str, a: str, b: str) -> DataFrame:
    """Difference of means between flagged and other rows, with a variance clustered both ways:
    by a, plus by b, minus by both.  Only sums by cluster are shuffled."""
    x, y = F.col(flag).cast("double"), F.col(value)
    # a cell is one (a, b): its sums are all that the estimate and the three variances need, so the rows are read once
    cells = df.select(F.col(a).alias("a"), F.col(b).alias("b"), x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b").agg(
        F.count("*").alias("m"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx")
    )
    # every way to cluster, and all rows together, as one pass of partial sums: (a, b), a, b, ()
    sums = cells.groupingSets([["a", "b"], ["a"], ["b"], []], "a", "b").agg(F.grouping_id().alias("way"), *[F.sum(c).alias(c) for c in ("m", "x", "y", "xy", "xx")])
    every = lambda c: F.max(F.when(F.col("way") == 3, F.col(c))).over(Window.partitionBy())
    # the squares of a cluster's score need the estimate: expand u = sum (x - X)(y - Y - e (x - X)) into the sums
    by_way = sums.groupBy("way").agg(*[F.first(c).alias(c) for c in ("m", "x", "y", "xy", "xx")], *[
        F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for i, p in enumerate(_SUMS) for q in _SUMS[i:]
    ])
    t = by_way.withColumns({f"all_{c}": every(c) for c in ("m", "x", "y", "xy", "xx")})
    n, xm, ym = F.col("all_m"), F.col("all_x") / F.col("all_m"), F.col("all_y") / F.col("all_m")
    sxx = F.col("all_xx") - n * xm * xm
    effect = F.try_divide(F.col("all_xy") - n * xm * ym, sxx)
    # u as a linear form in a cluster's sums
    form = {"xy": F.lit(1.0), "x": -ym + 2 * effect * xm, "y": -xm, "xx": -effect, "m": xm * ym - effect * xm * xm}
    squares = sum((F.col(f"{p}_{q}") * form[p] * form[q] * (1 if p == q else 2) for i, p in enumerate(_SUMS) for q in _SUMS[i:]), F.lit(0.0))
    sign = F.when(F.col("way") == 0, -1).when(F.col("way") == 3, 0).otherwise(1)
    out = t.select(n.alias("n"), effect.alias("effect"), sxx.alias("sxx"), (sign * squares).alias("v")).groupBy("n", "effect", "sxx").agg(F.sum("v").alias("v"))
    out = out.withColumn("se", F.sqrt(F.greatest(F.col("v"), F.lit(0.0))) / F.col("sxx"))
    out = out.withColumn("t", F.try_divide(F.col("effect"), F.col("se")))
    return out.select("n", F.round("effect", 8).alias("effect"), F.round("se", 8).alias("se"), F.round("t", 4).alias("t"))


def p_values(df: DataFrame, t: str = "t") -> DataFrame:
    """Two-sided normal p-values: erfc is not a built-in, so it runs over Arrow batches."""

    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))

    return df.withColumn("p", p(F.col(t)))


def benjamini_hochberg(df: DataFrame, p: str = "p", level: float = 0.1) -> DataFrame:
    """q-values over all rows: p * m / rank, made monotone from the largest p down.  The table has
    one row for each hypothesis."""
    w = Window.orderBy(p)
    total = Window.partitionBy()
    out = df.withColumns({"rank": F.row_number().over(w), "m": F.count("*").over(total)}).withColumn("raw", F.col(p) * F.col("m") / F.col("rank"))
    q = F.least(F.lit(1.0), F.min("raw").over(Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("q", q).withColumn("passes", F.col("q") <= level).drop("raw", "m")


def triple_barrier(bars: DataFrame, up: float = 0.03, down: float = 0.02, horizon: int = 20) -> DataFrame:
    """+1 if the target is touched first, -1 if the stop is (it wins ties), 0 if neither is within the
    horizon, null where the horizon is not complete."""
    c = F.col("close")
    ahead = bars.withColumn("path", F.collect_list(F.struct("bar_ix", "high", "low")).over(P.FWD(horizon)))
    first = lambda test: F.array_min(F.transform(F.filter("path", test), lambda s: s["bar_ix"]))
    out = ahead.withColumns({"hit_up": first(lambda s: s["high"] >= c * (1 + up)), "hit_dn": first(lambda s: s["low"] <= c * (1 - down)), "n": F.size("path")})
    label = (
        F.when(F.col("hit_dn").isNotNull() & (F.col("hit_up").isNull() | (F.col("hit_dn") <= F.col("hit_up"))), -1)
        .when(F.col("hit_up").isNotNull(), 1).when(F.col("n") == horizon, 0)
    )
    return out.withColumn("label", F.when(F.col("n") == horizon, label)).withColumn("bars_to", F.when(F.col("label") != 0, F.least("hit_up", "hit_dn") - F.col("bar_ix"))).drop("path", "hit_up", "hit_dn", "n")


def next_open_trades(signals: DataFrame, target: float = 0.04, stop: float = 0.02, horizon: int = 10) -> DataFrame:
    """One trade for each flagged bar: in at the next open, out at the stop (first), the target, or the
    close of the last bar.  A gap through a level fills at the open."""
    path = signals.withColumn("path", F.collect_list(F.struct("bar_ix", "open", "high", "low", "close")).over(P.FWD(horizon)))
    t = path.filter(F.col("flag") & (F.size("path") == horizon)).withColumn("entry", F.col("path")[0]["open"])
    e = F.col("entry")
    step = lambda acc, s: F.when(acc["why"] != "open", acc).otherwise(
        F.when(s["low"] <= e * (1 - stop), F.struct(F.lit("stop").alias("why"), F.least(s["open"], e * (1 - stop)).alias("exit"), (s["bar_ix"] - F.col("bar_ix")).alias("bars")))
        .when(s["high"] >= e * (1 + target), F.struct(F.lit("target").alias("why"), F.greatest(s["open"], e * (1 + target)).alias("exit"), (s["bar_ix"] - F.col("bar_ix")).alias("bars")))
        .otherwise(F.struct(F.lit("open").alias("why"), s["close"].alias("exit"), (s["bar_ix"] - F.col("bar_ix")).alias("bars")))
    )
    start = F.struct(F.lit("open").alias("why"), F.lit(0.0).alias("exit"), F.lit(0).alias("bars"))
    out = t.withColumn("end", F.aggregate("path", start, step))
    return out.select("symbol", "trade_date", "entry", F.when(F.col("end.why") == "open", "timeout").otherwise(F.col("end.why")).alias("why"), F.col("end.exit").alias("exit"), F.col("end.bars").alias("bars")).withColumn("ret", F.col("exit") / F.col("entry") - 1)


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """Target-first share, profit factor, expectancy, Sharpe of a trade, largest drawdown of the sum in date order."""
    w = Window.partitionBy(*by).orderBy("trade_date", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("cum", F.sum("ret").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(w)))
    return t.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(100 * F.count_if(F.col("why") == "target") / F.count("*"), 4).alias("target_pct"),
        F.round(F.try_divide(F.sum(F.when(F.col("ret") > 0, F.col("ret"))), -F.sum(F.when(F.col("ret") < 0, F.col("ret")))), 4).alias("profit_factor"),
        F.round(F.avg("ret"), 6).alias("expectancy"), F.round(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), 4).alias("sharpe"), F.round(F.max(F.col("peak") - F.col("cum")), 6).alias("max_drawdown"),
    )


def split_position(bars: DataFrame) -> DataFrame:
    """train, validation or test by the bar's place in its symbol's history (.6, .2, .2), not by date."""
    last = F.max("bar_ix").over(Window.partitionBy("symbol"))
    at = (F.col("bar_ix") - 1) / F.greatest(last - 1, F.lit(1))
    return bars.withColumn("part", F.when(at < 0.6, "train").when(at < 0.8, "validation").otherwise("test"))


def walk_forward(hits: DataFrame, ret: str, bins: int = 5) -> DataFrame:
    """Signals ordered by their training win rate, cut into equal bins (the last takes the rest), with the pooled win rate out of sample."""
    rate = lambda part: F.avg(F.when(F.col("part") == part, (F.col(ret) > 0).cast("int")))
    s = hits.groupBy("signal").agg(
        rate("train").alias("train"), F.count_if(F.col("part") == "test").alias("n_test"), F.sum(F.when(F.col("part") == "test", (F.col(ret) > 0).cast("int"))).alias("wins"),
    ).filter("train is not null and n_test > 0")
    w = Window.orderBy("train", "signal")
    s = s.withColumns({"ix": F.row_number().over(w) - 1, "m": F.count("*").over(Window.partitionBy())})
    size = F.greatest(F.floor(F.col("m") / bins), F.lit(1))
    return s.withColumn("bin", F.least(F.floor(F.col("ix") / size), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(
        F.count("*").alias("signals"), F.round(F.avg("train") * 100, 4).alias("train_rate"), F.sum("n_test").alias("n_test"), F.round(100 * F.sum("wins") / F.sum("n_test"), 4).alias("test_rate")
    )


def reliability(events: DataFrame) -> DataFrame:
    """Forecast in fixed bins against what happened, with the Brier score over all."""
    edges = [0.2, 0.3, 0.4, 0.5]
    b = F.lit(0)
    for i, e in enumerate(edges):
        b = F.when(F.col("forecast") >= e, i + 1).otherwise(b)
    e = events.withColumn("bin", b)
    out = e.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("forecast"), 6).alias("forecast"), F.round(F.avg("hit"), 6).alias("observed"), F.round(F.avg(F.pow(F.col("forecast") - F.col("hit"), F.lit(2.0))), 6).alias("brier"))
    return out


def bootstrap_difference(df: DataFrame, flag: str, value: str, cluster: str, iterations: int = 200, seed: int = 3) -> DataFrame:
    """Quantiles of the difference of means when whole clusters are drawn again with Poisson weights hashed
    from (seed, iteration, cluster): sums by cluster are made once and replicated, rows are not."""
    x = F.col(flag)
    cells = df.groupBy(cluster).agg(
        F.sum(F.when(x, F.col(value))).alias("s1"), F.count(F.when(x, F.col(value))).alias("n1"), F.sum(F.when(~x, F.col(value))).alias("s0"), F.count(F.when(~x, F.col(value))).alias("n0"),
    )
    u = F.pmod(F.xxhash64(F.lit(seed), "it", F.col(cluster).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    total, weight = 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        weight = weight + (u >= total).cast("int")
    drawn = cells.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("w", weight)
    each = drawn.groupBy("it").agg((F.try_divide(F.sum(F.col("w") * F.col("s1")), F.sum(F.col("w") * F.col("n1"))) - F.try_divide(F.sum(F.col("w") * F.col("s0")), F.sum(F.col("w") * F.col("n0")))).alias("diff"))
    return each.agg(F.count("diff").alias("iterations"), F.round(F.avg("diff"), 8).alias("mean"), F.round(F.percentile("diff", F.lit(0.025)), 8).alias("low"), F.round(F.percentile("diff", F.lit(0.975)), 8).alias("high"))
