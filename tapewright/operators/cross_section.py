"""Operators across symbols on one date: breadth, sectors, quotes, buckets, relative strength, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import clamp
from tapewright.functions.windows import Panel, asof_backward, corr, run_length

P = Panel()
#: Bars back and weights of the relative-strength horizons.
RS_HORIZONS = {"1w": (1, 0.5), "1m": (4, 1.0), "3m": (13, 2.0), "6m": (26, 3.0), "12m": (52, 4.0)}


def quotes(bars: DataFrame, date: str) -> DataFrame:
    """The latest bar of each symbol with the change from the one before, a score and a setup label.
    Spark prunes each partition to two bars a symbol before the shuffle (WindowGroupLimit)."""
    ranked = bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ix")))).filter("rn <= 2")
    two = ranked.groupBy("symbol").agg(
        F.max_by(F.struct(date, "open", "high", "low", "close", "volume"), "bar_ix").alias("now"),
        F.min_by("close", "bar_ix").alias("ldcp"), F.count("*").alias("n"), *([F.first("sector").alias("sector")] if "sector" in bars.columns else []),
    ).filter("n = 2")
    q = two.select("symbol", *(["sector"] if "sector" in bars.columns else []), "ldcp", "now.*").withColumn("change", F.col("close") - F.col("ldcp"))
    q = q.withColumn("pct", 100 * F.col("change") / F.col("ldcp"))
    loc = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    score = clamp(50 + clamp(F.col("pct") * 2.2, -20, 20) + (loc - 0.5) * 24 + F.least(F.lit(20.0), F.log10(F.greatest("volume", F.lit(1.0))) * 3) / 2, 0, 100)
    setup = F.when((F.col("pct") > 2) & (loc > 0.7), "Breakout").when((F.col("pct") < -2) & (loc < 0.3), "Breakdown").when(loc > 0.7, "Accumulation").when(loc < 0.3, "Distribution").otherwise("Neutral")
    return q.withColumns({"loc": loc, "score": score, "setup": setup})


def breadth(q: DataFrame, by: list[str]) -> DataFrame:
    adv, dec = F.count_if(F.col("pct") > 0), F.count_if(F.col("pct") < 0)
    return q.groupBy(*by).agg(
        F.count("*").alias("n"), adv.alias("advancers"), dec.alias("decliners"), (F.count("*") - adv - dec).alias("unchanged"),
        F.round(100 * adv / F.greatest(F.lit(1), adv + dec), 4).alias("breadth_pct"), F.round(F.avg("pct"), 4).alias("avg_pct"), F.sum("volume").alias("volume"),
    )


def sector_rotation(q: DataFrame, top: int = 3) -> DataFrame:
    """Strength of each sector from breadth and mean change, its rank, and its leaders."""
    b = breadth(q, ["sector"])
    leaders = q.withColumn("rn", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("pct"), "symbol"))).filter(F.col("rn") <= top)
    names = leaders.groupBy("sector").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "symbol"))), lambda s: s["symbol"]), ",").alias("leaders"))
    strength = clamp(0.55 * F.col("breadth_pct") + 0.45 * clamp(50 + F.col("avg_pct") * 10, 0, 100), 0, 100)
    out = b.join(names, "sector").withColumn("strength", F.round(strength, 4))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "sector")))


def bucket_lists(q: DataFrame, k: int = 10) -> DataFrame:
    """Overlapping top-k lists over one scored set: rows are put into all their buckets at once and
    ranked within each; nothing is scanned twice."""
    tests = {
        "top_score": F.lit(True), "momentum": F.col("pct") > 1, "breakout": F.col("setup") == "Breakout", "accumulation": F.col("setup") == "Accumulation",
        "weak": F.col("pct") < -1, "liquid": F.col("volume") >= 20,
    }
    put = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
    rows = q.select("symbol", "score", F.explode(put).alias("bucket"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "symbol"))).filter(F.col("rank") <= k)


def leave_one_out(bars: DataFrame, date: str) -> DataFrame:
    """Return of each symbol beside the mean of its sector without it: one window, no self-join."""
    r = bars.withColumn("ret", F.col("close") / P.lag("close") - 1).filter("ret is not null and abs(ret) <= 0.5")
    own = Window.partitionBy("sector", date)
    return r.withColumn("peers", F.count("*").over(own) - 1).withColumn(
        "peer_ret", F.when(F.col("peers") > 0, (F.sum("ret").over(own) - F.col("ret")) / F.col("peers"))
    )


def index_series(bars: DataFrame, date: str) -> DataFrame:
    """Equal-weight index of all symbols, compounded.  The running sum is over dates only."""
    r = bars.withColumn("ret", F.col("close") / P.lag("close") - 1).filter("ret is not null")
    daily = r.groupBy(date).agg(F.avg("ret").alias("index_ret"))
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("index_level", 100 * F.exp(F.sum(F.log1p("index_ret")).over(w)))


def relative_strength(bars: DataFrame, date: str) -> DataFrame:
    """Weighted excess return over the index at several horizons, with a class.  Only horizons that
    are there count, and their weights are scaled up."""
    idx = index_series(bars, date)
    w = Window.orderBy(date)
    idx = idx.select(date, *[(F.col("index_level") / F.lag("index_level", n).over(w) - 1).alias(f"i_{k}") for k, (n, _) in RS_HORIZONS.items()])
    own = bars.withColumns({f"r_{k}": F.col("close") / P.lag("close", n) - 1 for k, (n, _) in RS_HORIZONS.items()})
    j = own.join(idx, date)
    ex = {k: F.col(f"r_{k}") - F.col(f"i_{k}") for k in RS_HORIZONS}
    num = sum((F.coalesce(ex[k] * wt, F.lit(0.0)) for k, (_, wt) in RS_HORIZONS.items()), F.lit(0.0))
    den = sum((F.when(ex[k].isNotNull(), F.lit(wt)).otherwise(0.0) for k, (_, wt) in RS_HORIZONS.items()), F.lit(0.0))
    j = j.withColumn("rs", F.when(den > 0, num / den))
    return j.withColumn("rs_class", F.when(F.col("rs") > 0.1, "Leader").when(F.col("rs") > 0.02, "Strong").when(F.col("rs") >= -0.02, "In line").when(F.col("rs") >= -0.1, "Weak").when(F.col("rs").isNotNull(), "Laggard"))


def beta(bars: DataFrame, date: str, n: int = 52) -> DataFrame:
    """Beta and correlation to the index over the last n common bars."""
    r = bars.withColumn("ret", F.col("close") / P.lag("close") - 1).join(index_series(bars, date), date).filter("ret is not null")
    w = Window.partitionBy("symbol").orderBy("bar_ix").rowsBetween(-(n - 1), 0)
    ok = F.count("ret").over(w) == n
    return r.withColumns({
        "beta": F.when(ok, F.try_divide(F.covar_samp("ret", "index_ret").over(w), F.var_samp("index_ret").over(w))),
        "corr": F.when(ok, corr("ret", "index_ret", w)),
    })


def regimes(bars: DataFrame, date: str) -> DataFrame:
    """Bull, bear or range by the index against its mean over 50 dates and the mean's slope over 5."""
    w = Window.orderBy(date)
    i = index_series(bars, date)
    i = i.withColumn("sma50", F.when(F.count("index_level").over(w.rowsBetween(-49, 0)) == 50, F.avg("index_level").over(w.rowsBetween(-49, 0))))
    i = i.withColumn("slope", F.col("sma50") - F.lag("sma50", 5).over(w))
    return i.withColumn("regime", F.when((F.col("index_level") > F.col("sma50")) & (F.col("slope") > 0), "Bull").when((F.col("index_level") < F.col("sma50")) & (F.col("slope") < 0), "Bear").when(F.col("slope").isNotNull(), "Range"))


def liquidity(bars: DataFrame, last: int = 60) -> DataFrame:
    """Tier, mean and median volume and value over the last bars of each symbol."""
    recent = bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ix")))).filter(F.col("rn") <= last)
    out = recent.groupBy("symbol").agg(
        F.avg("volume").alias("avg_volume"), F.percentile("volume", F.lit(0.5)).alias("median_volume"), F.avg(F.col("volume") * F.col("close")).alias("avg_value"),
        (100 * F.count_if(F.col("volume") < 20) / F.count("*")).alias("low_volume_pct"), F.try_divide(F.stddev_pop("volume"), F.avg("volume")).alias("cv"),
    )
    return out.withColumn("tier", F.when(F.col("avg_value") >= 25000, "HIGH").when(F.col("avg_value") >= 10000, "MEDIUM").otherwise("LOW"))


def quality_audit(bars: DataFrame) -> DataFrame:
    """Counts of broken rows, gaps, big moves and stale runs per symbol, and a penalty score.  A run of
    n equal closes counts floor(n / 5) stale runs."""
    f = bars.withColumns({
        "bad": ~((F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("close") > 0) & (F.col("volume") >= 0)),
        "gap_days": F.datediff("trade_date", P.lag("trade_date")), "move": F.abs(F.col("close") / P.lag("close") - 1), "same": F.col("close") == P.lag("close"),
    })
    f = run_length(f, F.col("same"), "stale_run")
    ends = (F.col("stale_run") > 0) & (F.coalesce(P.lead("stale_run"), F.lit(0)) == 0)
    f = f.withColumn("stale", F.when(ends, F.floor(F.col("stale_run") / 5)).otherwise(0))
    out = f.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.count_if("bad").alias("bad_rows"), F.count_if(F.col("gap_days") > 5).alias("gaps"), F.max("gap_days").alias("max_gap"),
        F.count_if(F.col("move") > 0.05).alias("big_moves"), F.sum("stale").cast("long").alias("stale_runs"), F.count_if(F.col("high") == F.col("low")).alias("locked"),
    )
    return out.withColumn("score", F.round(clamp(100 - 5.0 * F.col("bad_rows") - 0.5 * F.col("gaps") - 0.1 * F.col("big_moves") - 1.0 * F.col("stale_runs"), 0, 100), 4))


def sector_percentile(suppliers: DataFrame, min_peers: int = 3) -> DataFrame:
    """Fixed band score and percentile among sector peers, half each; peers need a minimum number."""
    w = Window.partitionBy("sector")
    band = clamp((F.col("value") + 1000) / 110, 0, 100)
    below = F.rank().over(Window.partitionBy("sector").orderBy("value")) - 1
    rel = F.when(F.count("value").over(w) >= min_peers, 100 * below / F.greatest(F.count("value").over(w) - 1, F.lit(1)))
    return suppliers.withColumns({"band": band, "rel": rel}).withColumn("score", F.when(F.col("rel").isNull(), F.col("band")).otherwise(0.5 * F.col("band") + 0.5 * F.col("rel")))


def weekly_onto_daily(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Each daily bar with the last completed week of its symbol (strictly before its date)."""
    w = weekly.select("symbol", F.col("week").alias("week_end"), F.col("close").alias("week_close"), F.col("sma4").alias("week_sma4"))
    return asof_backward(daily, w, "trade_date", "week_end", ["symbol"], ["week_end", "week_close", "week_sma4"], strict=True)


def to_weekly(bars: DataFrame) -> DataFrame:
    week = F.date_add(F.date_trunc("week", "trade_date").cast("date"), 4)
    w = bars.withColumn("week", week).groupBy("symbol", "week").agg(
        F.min_by("open", "bar_ix").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ix").alias("close"), F.sum("volume").alias("volume"),
    )
    w = w.withColumn("bar_ix", F.row_number().over(Window.partitionBy("symbol").orderBy("week")))
    return w.withColumn("sma4", P.full(F.avg("close"), 4))


def to_monthly(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.last_day("trade_date").alias("month")).agg(
        F.min_by("open", "bar_ix").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ix").alias("close"), F.sum("volume").alias("volume"),
    )
