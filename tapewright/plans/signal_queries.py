"""Signal, candle and back-test queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import candles as K
from tapewright.operators import signals as S
from tapewright.plans.indicator_queries import FRAMES, KERNEL_SQL, full
from tapewright.sources.panels import BARS_SQL, daily_bars

H = S.HORIZONS
FWD_SQL = ", ".join(f"lead(close, {h}) OVER b / close - 1 AS fwd_{h}" for h in H)
EXC_SQL = ", ".join(
    f"CASE WHEN count(close) OVER f{h} = {h} THEN max(high) OVER f{h} / close - 1 END AS mfe_{h}, CASE WHEN count(close) OVER f{h} = {h} THEN min(low) OVER f{h} / close - 1 END AS mae_{h}"
    for h in H
)
FWD_FRAMES = FRAMES + ", " + ", ".join(f"f{h} AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in H)


def hits_sql(source: str, rules: dict[str, str], keep: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{name}' AS signal FROM {source} WHERE ({where}) AND coalesce({rule}, false)" for name, rule in rules.items())


SIGNAL_BASE = f"""
  SELECT *, close - lag(close) OVER b AS diff, {full('avg(volume)', 20)} AS vol20, {full('avg(close)', 20)} AS sma, {full('stddev_samp(close)', 20)} AS sd,
    100 * (close / lag(close, 20) OVER b - 1) AS mom20, lag(close, 30) OVER b AS close_30,
    coalesce(sign(close - lag(close) OVER b), 0) * volume AS obv_step, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS mfv
"""
SIGNAL_CTES = f""", s0 AS ({SIGNAL_BASE} FROM {{source}} {FRAMES}), s1 AS (
  SELECT *, {full('avg(greatest(diff, 0))', 14, 'diff')} AS gain, {full('avg(greatest(-diff, 0))', 14, 'diff')} AS loss,
    sma + 2 * sd AS bb_up, sma - 2 * sd AS bb_low, 4 * sd / sma AS bandwidth, sum(obv_step) OVER cum AS obv, {full('sum(mfv)', 20)} / sum(volume) OVER w20 AS cmf20
  FROM s0 {FRAMES}
), s2 AS (
  SELECT *, CASE WHEN loss <> 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi, lag(obv, 30) OVER b AS obv_30, {full('quantile_cont(bandwidth, 0.1)', 60, 'bandwidth')} AS bw_q10 FROM s1 {FRAMES}
), s3 AS (
  SELECT *, {{lags}}, {FWD_SQL} FROM s2 {FRAMES}
), ok AS (SELECT * FROM s3 WHERE bar_ix > {S.MIN_HISTORY} AND fwd_{max(H)} IS NOT NULL)
"""


def _summary_sql(hits: str, by: str) -> str:
    stats = "count(*) AS n_signals, " + ", ".join(f"round(avg(CASE WHEN fwd_{h} > 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS win_rate_{h}d" for h in H)
    stats += ", round(avg(fwd_10) * 100, 4) AS avg_return_10d, round(quantile_cont(fwd_10, 0.5) * 100, 4) AS median_return_10d"
    base = ", ".join("'BASELINE' AS " + b for b in by.split(", "))
    return f"SELECT {by}, {stats} FROM ({hits}) GROUP BY {by} UNION ALL SELECT {base}, {stats} FROM ok"


W_LAGS = ", ".join(f"lag({x}) OVER b AS {x}_1" for x in S.LAGGED if x not in ("macd", "macd_signal", "macd_hist", "ema20", "ema50", "adx"))
ALL_LAGS = ", ".join(f"lag({x}) OVER b AS {x}_1" for x in S.LAGGED)
W_RULES = {s: S.SIGNALS[s][1] for s in S.WINDOWED}
R_RULES = {s: r for s, (_, r) in S.SIGNALS.items() if s not in S.WINDOWED}
FWD_COLS = ", ".join(f"fwd_{h}" for h in H)

WINDOWED_SQL = BARS_SQL + SIGNAL_CTES.format(source="bars", lags=W_LAGS) + _summary_sql(hits_sql("ok", W_RULES, FWD_COLS), "signal")
#: The recursive columns of the indicator query, unrounded, beside the bars.
RECURSIVE_CTE = KERNEL_SQL[: KERNEL_SQL.rindex("SELECT r.symbol")].rstrip()
RECURSIVE_CTE = (
    RECURSIVE_CTE.replace("close AS ema50,", "close AS ema50, close AS ema20, close AS ema200,", 1)
    .replace("q.ema26, q.ema50,", "q.ema26, q.ema50, q.ema20, q.ema200,", 1)
    .replace("AS ema50, r.sig,", "AS ema50, r.ema20 + (x.close - r.ema20) * (2.0 / 21) AS ema20, r.ema200 + (x.close - r.ema200) * (2.0 / 201) AS ema200, r.sig,", 1)
)
FULL_CTES = RECURSIVE_CTE + f""", k AS (
  SELECT bars.*, ema12 - ema26 AS macd, sig AS macd_signal, ema12 - ema26 - sig AS macd_hist, ema20, ema50, ema200, adx FROM bars JOIN r ON r.symbol = bars.symbol AND r.bar_ix = bars.bar_ix
)""" + SIGNAL_CTES.format(source="k", lags=ALL_LAGS)
ALL_SQL = FULL_CTES + _summary_sql(hits_sql("ok", {s: r for s, (_, r) in S.SIGNALS.items()}, FWD_COLS), "signal")
SUSTAINED_SQL = FULL_CTES + _summary_sql(hits_sql("ok", S.SUSTAINED, FWD_COLS), "signal")

CANDLE_CTES = ", cf0 AS (SELECT *, open AS o, high AS h, low AS l, close AS c, " + ", ".join(
    f"lag({x}, {n}) OVER b AS {k}{n}" for k, x in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for n in range(1, 5)
) + f", lag(close, 1) OVER b / lag(close, 10) OVER b - 1 AS drift FROM bars {FRAMES})" + "".join(
    f", {name} AS (SELECT *, " + ", ".join(f"{rule} AS {column}" for column, rule in step.items()) + f" FROM {before})"
    for before, name, step in zip(("cf0", "cf1", "cf2"), ("cf1", "cf2", "cf"), K.geometry())
)
CANDLES_SQL = BARS_SQL + CANDLE_CTES + ", hits AS (" + hits_sql("cf", K.CANDLES, "symbol, trade_date") + ") SELECT symbol, trade_date, signal, " + (
    "CASE WHEN signal IN (" + ", ".join(f"'{x}'" for x in sorted(K.BULLISH)) + ") THEN 'bullish' WHEN signal IN (" + ", ".join(f"'{x}'" for x in sorted(K.BEARISH)) + ") THEN 'bearish' ELSE 'neutral' END AS bias FROM hits"
)
RANGE_CTE = """, rf AS (SELECT *, min(low) OVER c AS sup, max(high) OVER c AS res, min(low) OVER d AS sup_b, max(high) OVER d AS res_b FROM {source}
  WINDOW c AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 39 PRECEDING AND 3 PRECEDING), d AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 40 PRECEDING AND 4 PRECEDING))"""
RANGE_SQL = BARS_SQL + RANGE_CTE.format(source="bars") + " " + hits_sql("rf", S.RANGE_EVENTS, "symbol, trade_date, round(sup, 6) AS sup, round(res, 6) AS res")
COMBO_SQL = BARS_SQL + CANDLE_CTES + RANGE_CTE.format(source="cf") + f""", ls AS (
  SELECT *, last_value(CASE WHEN {S.RANGE_EVENTS['Spring']} THEN bar_ix END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS last_spring FROM rf
), hits AS ({hits_sql('ls', K.CANDLES, 'symbol, trade_date, bar_ix - last_spring AS bars_after', 'bar_ix - last_spring BETWEEN 1 AND 10')})
SELECT symbol, trade_date, CAST(bars_after AS INT) AS bars_after, 'Spring + ' || signal AS signal FROM hits"""

STAT_COLS = """count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS win_rate, round(avg(ret), 4) AS avg_return,
  round(quantile_cont(ret, 0.5), 4) AS median_return, round(stddev_pop(ret), 4) AS stdev, round(coalesce(avg(CASE WHEN ret > 0 THEN ret END), 0), 4) AS avg_win,
  round(coalesce(avg(CASE WHEN ret <= 0 THEN ret END), 0), 4) AS avg_loss,
  round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * coalesce(avg(CASE WHEN ret > 0 THEN ret END), 0) + (1 - avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)) * coalesce(avg(CASE WHEN ret <= 0 THEN ret END), 0), 4) AS expectancy,
  count(*) < 20 AS low_sample"""
STACK = lambda source, keep: " UNION ALL ".join(f"SELECT {keep}, {h} AS horizon, fwd_{h} * 100 AS ret, mfe_{h} * 100 AS mfe, mae_{h} * 100 AS mae FROM {source}" for h in H)
PATTERN_SQL = BARS_SQL.replace("bars AS (", "bars0 AS (", 1) + f", bars AS (SELECT *, {FWD_SQL}, {EXC_SQL} FROM bars0 {FWD_FRAMES})" + CANDLE_CTES + RANGE_CTE.format(source="cf") + ", hits AS (" + hits_sql(
    "rf", K.CANDLES | S.RANGE_EVENTS, ", ".join(f"fwd_{h}, mfe_{h}, mae_{h}" for h in H)
) + "), st AS (" + STACK("hits", "signal") + f") SELECT signal, horizon, {STAT_COLS}, round(avg(mfe), 4) AS mfe, round(avg(mae), 4) AS mae FROM st WHERE ret IS NOT NULL GROUP BY signal, horizon"
BASELINE_SQL = BARS_SQL + f""", s0 AS (SELECT *, close - lag(close) OVER b AS diff, {full('avg(close)', 9)} AS sma9, {full('avg(close)', 20)} AS sma20, {full('avg(close)', 50)} AS sma50, {FWD_SQL}, {EXC_SQL} FROM bars {FWD_FRAMES}),
s1 AS (SELECT *, {full('avg(greatest(diff, 0))', 14, 'diff')} AS gain, {full('avg(greatest(-diff, 0))', 14, 'diff')} AS loss, lag(sma9) OVER b AS sma9_1, lag(sma20) OVER b AS sma20_1 FROM s0 {FRAMES}),
s2 AS (SELECT *, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_simple_100 FROM s1), hits AS (""" + hits_sql(
    "s2", S.BASELINES, ", ".join(f"fwd_{h}, mfe_{h}, mae_{h}" for h in H)
) + "), st AS (" + STACK("hits", "signal") + f") SELECT signal, horizon, {STAT_COLS} FROM st WHERE ret IS NOT NULL GROUP BY signal, horizon"


def q_windowed(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.eligible(S.with_forward(S.signal_frame(daily_bars(spark, sf), recursive=False)))
    fwd = [f"fwd_{h}" for h in H]
    return S.summarise(S.long_form(bars, W_RULES | S.BASELINE, fwd), ["signal"])


def q_all_signals(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.eligible(S.with_forward(S.signal_frame(daily_bars(spark, sf))))
    return S.summarise(S.long_form(bars, {s: r for s, (_, r) in S.SIGNALS.items()} | S.BASELINE, [f"fwd_{h}" for h in H]), ["signal"])


def q_sustained(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.eligible(S.with_forward(S.signal_frame(daily_bars(spark, sf))))
    return S.summarise(S.long_form(bars, S.SUSTAINED | S.BASELINE, [f"fwd_{h}" for h in H]), ["signal"])


def q_candles(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.long_form(K.candle_frame(daily_bars(spark, sf)), K.CANDLES, ["symbol", "trade_date"])
    return hits.withColumn("bias", K.bias(F.col("signal")))


def q_range_events(spark: SparkSession, sf: str) -> DataFrame:
    f = S.range_frame(daily_bars(spark, sf))
    return S.long_form(f, S.RANGE_EVENTS, ["symbol", "trade_date", F.round("sup", 6).alias("sup"), F.round("res", 6).alias("res")])


def q_spring_combos(spark: SparkSession, sf: str) -> DataFrame:
    return S.spring_combos(daily_bars(spark, sf)).select("symbol", "trade_date", (F.col("bar_ix") - F.col("last_spring")).cast("int").alias("bars_after"), "signal")


def q_pattern_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = S.with_forward(S.range_frame(K.candle_frame(daily_bars(spark, sf))))
    hits = S.long_form(f, K.CANDLES | S.RANGE_EVENTS, [c for h in H for c in (f"fwd_{h}", f"mfe_{h}", f"mae_{h}")])
    return S.return_stats(S.stacked_horizons(hits, ["signal"]), ["signal", "horizon"], "ret", means=("mfe", "mae"))


def q_baselines(spark: SparkSession, sf: str) -> DataFrame:
    f = S.with_forward(S.baseline_frame(daily_bars(spark, sf)))
    hits = S.long_form(f, S.BASELINES, [c for h in H for c in (f"fwd_{h}", f"mfe_{h}", f"mae_{h}")])
    return S.return_stats(S.stacked_horizons(hits, ["signal"]), ["signal", "horizon"], "ret")


QUERIES = {
    "bt_window_signals": (q_windowed, WINDOWED_SQL),
    "bt_all_signals": (q_all_signals, ALL_SQL),
    "bt_sustained_signals": (q_sustained, SUSTAINED_SQL),
    "pat_candles": (q_candles, CANDLES_SQL),
    "pat_range_events": (q_range_events, RANGE_SQL),
    "pat_spring_combos": (q_spring_combos, COMBO_SQL),
    "bt_pattern_stats": (q_pattern_stats, PATTERN_SQL),
    "bt_baselines": (q_baselines, BASELINE_SQL),
}
