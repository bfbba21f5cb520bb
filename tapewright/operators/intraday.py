"""Intraday detectors on session bars: baselines by time of day, compression, absorption, pre-fire,
fire with its score, near-close carry-over and session checks.  All are windows on one sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import bands, clamp
from tapewright.functions.windows import BARS as P
from tapewright.functions.windows import asof_backward


@dataclass(frozen=True)
class IgnitionConfig:
    """Thresholds; the defaults suit hourly bars of memoryless values."""

    lookback: int = 5
    max_move_pct: float = 40.0
    mfi_gain: float = 10.0
    max_rvol: float = 1.5
    min_rvol: float = 1.2
    support_bars: int = 20
    baseline_sessions: int = 30
    min_sessions: int = 5
    reject_bars: int = 5
    close_hour: int = 23


def time_of_day_baseline(bars: DataFrame, sessions: int = 30) -> DataFrame:
    """Median and mean volume by symbol and hour over each symbol's last sessions, cut to integers."""
    w = Window.partitionBy("symbol").orderBy(F.desc("session_date"))
    recent = bars.withColumn("age", F.dense_rank().over(w)).filter(F.col("age") <= sessions)
    return recent.groupBy("symbol", "hour").agg(
        F.percentile("volume", F.lit(0.5)).cast("long").alias("median_volume"), F.avg("volume").cast("long").alias("mean_volume"), F.count_distinct("session_date").alias("sessions"),
    )


def relative_volume(bars: DataFrame, sessions: int = 30, least: int = 5) -> DataFrame:
    """Volume over the baseline of its hour, with a class and a confidence; too few sessions: UNKNOWN."""
    j = bars.join(time_of_day_baseline(bars, sessions), ["symbol", "hour"], "left")
    rv = F.when((F.col("sessions") >= least) & (F.col("median_volume") > 0), F.col("volume") / F.col("median_volume"))
    kind = bands(F.col("rvol"), [(0.5, "THIN"), (1.5, "NORMAL"), (2.0, "ELEVATED"), (3.0, "ABNORMAL")], "EXTREME")
    return j.withColumn("rvol", rv).withColumns({"volume_class": F.coalesce(kind, F.lit("UNKNOWN")), "rv_confidence": F.least(F.lit(1.0), F.coalesce(F.col("sessions"), F.lit(0)) / 30)})


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index that is 100 without outflow (50 without any flow), first given at bar n."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    f = bars.withColumn("tp", tp).withColumn("dtp", F.col("tp") - P.lag("tp"))
    pos = P.full(F.sum(F.when(F.col("dtp") > 0, F.col("tp") * F.col("volume")).otherwise(0.0)), n, "dtp")
    neg = P.full(F.sum(F.when(F.col("dtp") < 0, F.col("tp") * F.col("volume")).otherwise(0.0)), n, "dtp")
    f = f.withColumns({"pos": pos, "neg": neg})
    f = f.withColumn("mfi", F.when(F.col("neg") == 0, F.when(F.col("pos") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.col("pos") / F.col("neg"))))
    return f.drop("tp", "dtp", "pos", "neg")


def ignition_frame(bars: DataFrame, cfg: IgnitionConfig = IgnitionConfig()) -> DataFrame:
    """Every intermediate column, then pre-fire and fire flags with their scores."""
    f = mfi(relative_volume(bars, cfg.baseline_sessions, cfg.min_sessions))
    n = cfg.lookback
    o = P.lag("open", n - 1)
    f = f.withColumns({
        "move_pct": F.when(o > 0, F.abs(F.col("close") - o) / o * 100), "support": F.min("low").over(P.WP(cfg.support_bars)), "resistance": F.max("high").over(P.WP(cfg.support_bars)),
        "mfi_gain": F.greatest(F.coalesce(F.col("mfi") - P.lag("mfi", n), F.lit(0.0)), F.coalesce(F.col("mfi") - P.lag("mfi", 3 * n), F.lit(0.0))),
        "mfi_before": P.lag("mfi", n - 1),
    })
    f = f.withColumns({
        "compressed": F.coalesce(F.col("move_pct") <= cfg.max_move_pct, F.lit(False)),
        "support_holds": F.coalesce(F.col("low") >= F.col("support"), F.lit(False)), "resistance_holds": F.coalesce(F.col("high") <= F.col("resistance"), F.lit(False)),
        "near_close": F.col("hour") >= cfg.close_hour,
    })
    rv = F.col("rvol")
    up = F.coalesce((F.col("mfi") >= 50) | (F.col("mfi") > F.col("mfi_before")), F.lit(False))
    down = F.coalesce((F.col("mfi") <= 50) | (F.col("mfi") < F.col("mfi_before")), F.lit(False))
    busy = F.coalesce(rv >= cfg.min_rvol, F.lit(False))
    pre = (F.col("mfi_gain") >= cfg.mfi_gain) & F.col("compressed") & F.coalesce(rv < cfg.max_rvol, F.lit(False)) & F.col("support_holds") & ~F.col("near_close")
    f = f.withColumns({
        "bull_absorption": busy & F.col("compressed") & F.col("support_holds") & up,
        "bear_absorption": busy & F.col("compressed") & F.col("resistance_holds") & down,
        "absorption_score": 30.0 * busy.cast("int") + 30.0 * F.col("compressed").cast("int") + 20.0 * F.col("support_holds").cast("int") + 20.0 * up.cast("int"),
        "pre_fire": pre,
        "pre_score": F.when(pre, 17.5 * (
            F.least(F.lit(1.0), F.col("mfi_gain") / (2 * cfg.mfi_gain)) + clamp(1 - F.col("move_pct") / cfg.max_move_pct, 0, 1) + clamp((cfg.max_rvol - rv) / cfg.max_rvol, 0, 1) + 0.5
        )).otherwise(0.0),
    })
    high_so_far = P.cum(F.max("high"))
    f = f.withColumn("high_so_far", high_so_far).withColumns({
        "pre_ix": F.last(F.when(F.col("pre_fire"), F.col("bar_ix")), True).over(P.base.rowsBetween(Window.unboundedPreceding, -1)),
        "break_level": F.last(F.when(F.col("pre_fire"), F.col("high_so_far")), True).over(P.base.rowsBetween(Window.unboundedPreceding, -1)),
        "mfi_then": F.last(F.when(F.col("pre_fire"), F.col("mfi")), True).over(P.base.rowsBetween(Window.unboundedPreceding, -1)),
    })
    f = f.withColumn("breakout", F.coalesce(F.col("close") > F.col("break_level"), F.lit(False)))
    episode = Window.partitionBy("symbol", "pre_ix").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("first_break", F.min(F.when(F.col("breakout"), F.col("bar_ix"))).over(episode))
    back = F.max(F.when((F.col("bar_ix") > F.col("first_break")) & (F.col("bar_ix") <= F.col("first_break") + cfg.reject_bars), (F.col("close") <= F.col("break_level")).cast("int"))).over(episode)
    f = f.withColumn("rejected", F.coalesce(back == 1, F.lit(False)))
    supportive = F.coalesce((F.col("mfi") >= 50) | (F.col("mfi") > F.col("mfi_then")), F.lit(False))
    f = f.withColumn("fire", F.col("breakout") & busy & supportive & ~F.col("rejected"))
    parts = {
        "mfi_acceleration": clamp(F.col("mfi_gain") / (2 * cfg.mfi_gain), 0, 1) * 20, "compression": F.col("compressed").cast("double") * 15, "absorption": F.col("absorption_score") / 100 * 20,
        "support": F.col("support_holds").cast("double") * 10, "expansion": F.coalesce(clamp(rv / 2, 0, 1), F.lit(0.0)) * 10, "breakout": F.col("breakout").cast("double") * 15,
    }
    f = f.withColumn("fire_score", F.round(sum(F.round(p, 2) for p in parts.values()), 2))
    return f.withColumn("rating", bands(F.col("fire_score"), [(40, "NO_SETUP"), (60, "WATCH"), (75, "PRE_FIRE"), (90, "STRONG_FIRE")], "EXTREME_FIRE"))


def session_checks(bars: DataFrame, expected: int = 24) -> DataFrame:
    """COMPLETE, INCOMPLETE or ANOMALY for each symbol and session, with the issues found."""
    s = bars.withColumn("jump", F.abs(F.col("close") / P.lag("close") - 1))
    own = Window.partitionBy("symbol", "session_date").orderBy("hour")
    s = s.withColumn("gap", F.col("hour") - F.lag("hour").over(own))
    out = s.groupBy("symbol", "session_date").agg(
        F.count("*").alias("bars"), F.max("gap").alias("max_gap"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(F.col("low") <= 0).alias("bad_price"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("bars") < 0.95 * expected, "missing_bars"), F.when(F.col("max_gap") > 3, "gap"), F.when(F.col("zero_volume") > 0, "zero_volume"), F.when(F.col("bad_price") > 0, "bad_price"),
    ))
    out = out.withColumn("issues", F.array_join(issues, ","))
    return out.withColumn("status", F.when(F.col("bad_price") > 0, "ANOMALY").when(F.col("bars") < 0.95 * expected, "INCOMPLETE").otherwise("COMPLETE"))


def carried_setups(frame: DataFrame) -> DataFrame:
    """Each session's first bar with the latest near-close setup of an earlier session: as-of, strictly before."""
    late = frame.filter((F.col("hour") >= 20) & F.col("compressed") & (F.col("mfi_gain") > 0)).groupBy("symbol", "session_date").agg(F.max("hour").alias("setup_hour"), F.max_by("close", "hour").alias("setup_close"))
    first = frame.groupBy("symbol", "session_date").agg(F.min_by("open", "hour").alias("open"))
    late = late.select("symbol", F.col("session_date").alias("setup_date"), "setup_hour", "setup_close")
    out = asof_backward(first, late, "session_date", "setup_date", ["symbol"], ["setup_date", "setup_hour", "setup_close"], strict=True)
    return out.withColumn("gap_pct", 100 * (F.col("open") / F.col("setup_close") - 1))
