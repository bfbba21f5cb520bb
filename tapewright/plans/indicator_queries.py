"""Indicator queries over daily bars, each with SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import indicators, kernels
from tapewright.sources.panels import BARS_SQL, daily_bars

KEYS = ["symbol", "trade_date"]
#: Named frames of the SQL side.
FRAMES = """
WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix), cum AS (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING),
""" + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY bar_ix ROWS {n - 1} PRECEDING)" for n in (3, 9, 10, 14, 20, 26, 50, 52, 60, 90, 200)
) + ", " + ", ".join(f"p{n} AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (20, 60))


def full(agg: str, n: int, seen: str = "close") -> str:
    return f"CASE WHEN count({seen}) OVER w{n} = {n} THEN {agg} OVER w{n} END"


def prior(agg: str, n: int, seen: str = "close") -> str:
    return f"CASE WHEN count({seen}) OVER p{n} = {n} THEN {agg} OVER p{n} END"


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*KEYS, *[F.round(F.col(x), digits).alias(x) for x in cols])


def sql_rounded(source: str, cols: list[str], digits: int = 6) -> str:
    return f"SELECT symbol, trade_date, {', '.join(f'round({x}, {digits}) AS {x}' for x in cols)} FROM {source}"


TREND = ["sma20", "sma50", "sma200", "bb_up", "bb_low", "bb_up_pop", "bb_low_pop", "don_high", "don_low", "tenkan", "kijun", "roc10", "mom20", "gap", "zscore20", "pct_b", "bandwidth", "span_a", "span_b"]
OSC = ["rsi_simple_null", "rsi_simple_100", "stoch_k", "stoch_d", "cci20", "mfi_null", "mfi_100", "mfi_50"]
VOL = ["obv", "adl", "vpt", "cmf20", "vroc14", "vwap20", "vwma20", "anchored_vwap", "rvol_prior", "rvol_incl", "force_raw"]
RISK = ["tr", "ret", "atr14", "adr14", "hv10", "hv20", "hv60", "bandwidth", "atr_rank", "bw_q10", "close_med90"]
REG = ["slope20", "r2_20", "drift60", "zslope20", "corr_cv20"]
LEVELS = ["pp", "r1", "s1", "r2", "s2", "fib_r1", "fib_s1", "cam_r3", "cam_s3", "support", "resistance"]
KERNEL = ["ema12", "ema26", "ema50", "macd", "macd_signal", "macd_hist", "rsi_wilder", "atr_wilder", "adx", "plus_di", "minus_di"]

TREND_SQL = BARS_SQL + f""", a AS (
  SELECT *, {full('avg(close)', 20)} AS sma20, {full('avg(close)', 50)} AS sma50, {full('avg(close)', 200)} AS sma200,
    {full('stddev_samp(close)', 20)} AS sds, {full('stddev_pop(close)', 20)} AS sdp,
    {full('max(high)', 20)} AS don_high, {full('min(low)', 20)} AS don_low,
    ({full('max(high)', 9)} + {full('min(low)', 9)}) / 2 AS tenkan, ({full('max(high)', 26)} + {full('min(low)', 26)}) / 2 AS kijun,
    ({full('max(high)', 52)} + {full('min(low)', 52)}) / 2 AS mid52,
    close / lag(close, 10) OVER b - 1 AS roc10, close - lag(close, 20) OVER b AS mom20, open / lag(close) OVER b - 1 AS gap
  FROM bars {FRAMES}
), t AS (
  SELECT *, sma20 + 2 * sds AS bb_up, sma20 - 2 * sds AS bb_low, sma20 + 2 * sdp AS bb_up_pop, sma20 - 2 * sdp AS bb_low_pop,
    CASE WHEN sdp <> 0 THEN (close - sma20) / sdp END AS zscore20, CASE WHEN sds <> 0 THEN (close - sma20 + 2 * sds) / (4 * sds) END AS pct_b, 4 * sds / sma20 AS bandwidth,
    lag((tenkan + kijun) / 2, 26) OVER (PARTITION BY symbol ORDER BY bar_ix) AS span_a, lag(mid52, 26) OVER (PARTITION BY symbol ORDER BY bar_ix) AS span_b
  FROM a
) """ + sql_rounded("t", TREND)

OSC_SQL = BARS_SQL + f""", a AS (
  SELECT *, close - lag(close) OVER b AS diff, (high + low + close) / 3 AS tp FROM bars {FRAMES}
), d AS (
  SELECT *, tp - lag(tp) OVER b AS dtp, {full('avg(greatest(diff, 0))', 14, 'diff')} AS gain, {full('avg(greatest(-diff, 0))', 14, 'diff')} AS loss,
    {full('max(high)', 14)} AS hi14, {full('min(low)', 14)} AS lo14, {full('avg(tp)', 20)} AS tp20, {full('list(tp)', 20)} AS tps
  FROM a {FRAMES}
), e AS (
  SELECT *, {full('sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END)', 14, 'dtp')} AS pos14,
    {full('sum(CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END)', 14, 'dtp')} AS neg14,
    CASE WHEN hi14 <> lo14 THEN 100 * (close - lo14) / (hi14 - lo14) END AS stoch_k,
    list_sum(list_transform(tps, lambda x: abs(x - tp20))) / 20 AS mad20
  FROM d {FRAMES}
), f AS (
  SELECT *, {full('avg(stoch_k)', 3, 'stoch_k')} AS stoch_d,
    CASE WHEN loss <> 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi_simple_null,
    CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_simple_100,
    CASE WHEN mad20 <> 0 THEN (tp - tp20) / (0.015 * mad20) END AS cci20,
    CASE WHEN neg14 <> 0 THEN 100 - 100 / (1 + pos14 / neg14) END AS mfi_null,
    CASE WHEN neg14 = 0 THEN 100 ELSE 100 - 100 / (1 + pos14 / neg14) END AS mfi_100,
    CASE WHEN neg14 = 0 THEN CASE WHEN pos14 > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + pos14 / neg14) END AS mfi_50
  FROM e {FRAMES}
) """ + sql_rounded("f", OSC)

VOL_SQL = BARS_SQL + f""", a AS (
  SELECT *, coalesce(sign(close - lag(close) OVER b), 0) * volume AS obv_step,
    CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS mfv,
    coalesce(volume * (close - lag(close) OVER b) / lag(close) OVER b, 0) AS vpt_step,
    (close - lag(close) OVER b) * volume AS force_raw, (high + low + close) / 3 * volume AS tpv FROM bars {FRAMES}
), t AS (
  SELECT *, sum(obv_step) OVER cum AS obv, sum(mfv) OVER cum AS adl, sum(vpt_step) OVER cum AS vpt,
    {full('sum(mfv)', 20)} / sum(volume) OVER w20 AS cmf20, 100 * (volume / lag(volume, 14) OVER b - 1) AS vroc14,
    {full('sum(tpv)', 20)} / sum(volume) OVER w20 AS vwap20, {full('sum(close * volume)', 20)} / sum(volume) OVER w20 AS vwma20,
    sum(tpv) OVER cum / sum(volume) OVER cum AS anchored_vwap, volume / ({prior('avg(volume)', 20)}) AS rvol_prior,
    volume / ({full('avg(volume)', 20)}) AS rvol_incl
  FROM a {FRAMES}
) """ + sql_rounded("t", VOL)

RISK_SQL = BARS_SQL + f""", a AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr,
    close / lag(close) OVER b - 1 AS ret, ln(close / lag(close) OVER b) AS lret, high / low - 1 AS dr FROM bars {FRAMES}
), d AS (
  SELECT *, {full('avg(tr)', 14)} AS atr14, {full('avg(dr)', 14)} AS adr14,
    {', '.join(f"({full('stddev_samp(lret)', n, 'lret')}) * sqrt(252) AS hv{n}" for n in (10, 20, 60))},
    4 * ({full('stddev_samp(close)', 20)}) / ({full('avg(close)', 20)}) AS bandwidth
  FROM a {FRAMES}
), t AS (
  SELECT *, list_filter(list(atr14) OVER p60, lambda x: x IS NOT NULL) AS before,
    {full('quantile_cont(bandwidth, 0.1)', 60, 'bandwidth')} AS bw_q10, {full('quantile_cont(close, 0.5)', 90)} AS close_med90
  FROM d {FRAMES}
), r AS (
  SELECT *, CASE WHEN len(before) >= 48 THEN (len(list_filter(before, lambda x: x < atr14)) + 0.5 * len(list_filter(before, lambda x: x = atr14))) / len(before) END AS atr_rank
  FROM t
) """ + sql_rounded("r", RISK)

REG_SQL = BARS_SQL + f""", t AS (
  SELECT *, {full('regr_slope(close, bar_ix)', 20)} AS slope20, {full('regr_r2(close, bar_ix)', 20)} AS r2_20,
    252 * ({full('regr_slope(ln(close), bar_ix)', 60)}) AS drift60, {full('stddev_pop(close)', 20)} AS sd, CASE WHEN count(close) OVER w20 = 20 AND stddev_pop(close) OVER w20 > 0 AND stddev_pop(volume) OVER w20 > 0 THEN corr(close, volume) OVER w20 END AS corr_cv20
  FROM bars {FRAMES}
), z AS (SELECT *, CASE WHEN sd <> 0 THEN slope20 / sd END AS zslope20 FROM t) """ + sql_rounded("z", REG, 5)

LEVELS_SQL = BARS_SQL + f""", a AS (
  SELECT *, lag(high) OVER b AS ph, lag(low) OVER b AS pl, lag(close) OVER b AS pc, {full('list(close)', 60)} AS cs FROM bars {FRAMES}
), t AS (
  SELECT *, (ph + pl + pc) / 3 AS pp, 2 * (ph + pl + pc) / 3 - pl AS r1, 2 * (ph + pl + pc) / 3 - ph AS s1,
    (ph + pl + pc) / 3 + ph - pl AS r2, (ph + pl + pc) / 3 - ph + pl AS s2,
    (ph + pl + pc) / 3 + 0.382 * (ph - pl) AS fib_r1, (ph + pl + pc) / 3 - 0.382 * (ph - pl) AS fib_s1,
    pc + (ph - pl) * 1.1 / 4 AS cam_r3, pc - (ph - pl) * 1.1 / 4 AS cam_s3,
    list_aggregate(list_filter(cs, lambda x: x <= close), 'quantile_cont', 0.1) AS support,
    list_aggregate(list_filter(cs, lambda x: x >= close), 'quantile_cont', 0.9) AS resistance
  FROM a
) """ + sql_rounded("t", LEVELS)

SQUEEZE_SQL = BARS_SQL + f""", a AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr FROM bars {FRAMES}
), t AS (
  SELECT *, coalesce(2 * ({full('stddev_pop(close)', 20)}) < 1.5 * ({full('avg(tr)', 20)}), false) AS squeezed FROM a {FRAMES}
), i AS (SELECT *, sum(CASE WHEN squeezed THEN 0 ELSE 1 END) OVER cum AS island FROM t {FRAMES})
SELECT symbol, trade_date, squeezed, CAST(sum(CASE WHEN squeezed THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS BIGINT) AS squeeze_len
FROM i
"""

#: EMA-type recursions: y = y' + a (x - y'), started with the first x that is there.
KERNEL_SQL = BARS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, a AS (
  SELECT symbol, trade_date, bar_ix, close, coalesce(close - lag(close) OVER b, 0) AS d, high - lag(high) OVER b AS up, lag(low) OVER b - low AS dn,
    greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr
  FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)
), x AS MATERIALIZED (
  SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM a
), r AS (
  SELECT symbol, bar_ix, close AS ema12, close AS ema26, close AS ema50, 0.0::DOUBLE AS sig, greatest(d, 0)::DOUBLE AS g, greatest(-d, 0)::DOUBLE AS l,
    tr AS atr, pdm::DOUBLE AS p, mdm::DOUBLE AS m, CASE WHEN pdm + mdm > 0 THEN 100 * abs(pdm - mdm) / (pdm + mdm) ELSE 0 END::DOUBLE AS adx
  FROM x WHERE bar_ix = 1
  UNION ALL
  SELECT q.symbol, q.bar_ix, q.ema12, q.ema26, q.ema50, q.sig + (q.ema12 - q.ema26 - q.sig) * 0.2, q.g, q.l, q.atr, q.p, q.m,
    q.adx + (CASE WHEN q.p + q.m > 0 THEN 100 * abs(q.p - q.m) / (q.p + q.m) ELSE 0 END - q.adx) / 14
  FROM (
    SELECT x.symbol, x.bar_ix, r.ema12 + (x.close - r.ema12) * (2.0 / 13) AS ema12, r.ema26 + (x.close - r.ema26) * (2.0 / 27) AS ema26,
      r.ema50 + (x.close - r.ema50) * (2.0 / 51) AS ema50, r.sig, r.g + (greatest(x.d, 0) - r.g) / 14 AS g, r.l + (greatest(-x.d, 0) - r.l) / 14 AS l,
      r.atr + (x.tr - r.atr) / 14 AS atr, r.p + (x.pdm - r.p) / 14 AS p, r.m + (x.mdm - r.m) / 14 AS m, r.adx
    FROM r JOIN x ON x.symbol = r.symbol AND x.bar_ix = r.bar_ix + 1
  ) q
)
SELECT r.symbol, x.trade_date, round(ema12, 6) AS ema12, round(ema26, 6) AS ema26, round(ema50, 6) AS ema50, round(ema12 - ema26, 6) AS macd, round(sig, 6) AS macd_signal,
  round(ema12 - ema26 - sig, 6) AS macd_hist, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END, 6) AS rsi_wilder, round(atr, 6) AS atr_wilder,
  round(adx, 6) AS adx, round(CASE WHEN atr > 0 THEN 100 * p / atr END, 6) AS plus_di, round(CASE WHEN atr > 0 THEN 100 * m / atr END, 6) AS minus_di
FROM r JOIN x ON x.symbol = r.symbol AND x.bar_ix = r.bar_ix
"""

SUPERTREND_SQL = BARS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, x AS MATERIALIZED (
  SELECT symbol, trade_date, bar_ix, close, high, low, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr,
    lag(close) OVER b AS pc
  FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)
), r AS (
  SELECT symbol, bar_ix, tr AS atr, (high + low) / 2 + 3 * tr AS up, (high + low) / 2 - 3 * tr AS dn, 1 AS dir FROM x WHERE bar_ix = 1
  UNION ALL
  SELECT q.symbol, q.bar_ix, q.atr, q.up, q.dn, CASE WHEN q.close > q.pup THEN 1 WHEN q.close < q.pdn THEN -1 ELSE q.dir END
  FROM (
    SELECT x.symbol, x.bar_ix, x.close, r.atr + (x.tr - r.atr) / 10 AS atr, r.up AS pup, r.dn AS pdn, r.dir,
      CASE WHEN x.pc <= r.up THEN least((x.high + x.low) / 2 + 3 * (r.atr + (x.tr - r.atr) / 10), r.up) ELSE (x.high + x.low) / 2 + 3 * (r.atr + (x.tr - r.atr) / 10) END AS up,
      CASE WHEN x.pc >= r.dn THEN greatest((x.high + x.low) / 2 - 3 * (r.atr + (x.tr - r.atr) / 10), r.dn) ELSE (x.high + x.low) / 2 - 3 * (r.atr + (x.tr - r.atr) / 10) END AS dn
    FROM r JOIN x ON x.symbol = r.symbol AND x.bar_ix = r.bar_ix + 1
  ) q
)
SELECT r.symbol, x.trade_date, CAST(dir AS INT) AS direction, round(CASE WHEN dir = 1 THEN dn ELSE up END, 6) AS supertrend
FROM r JOIN x ON x.symbol = r.symbol AND x.bar_ix = r.bar_ix
"""


def q_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.trend(daily_bars(spark, sf)), TREND)


def q_oscillators(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.oscillators(daily_bars(spark, sf)), OSC)


def q_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.volume(daily_bars(spark, sf)), VOL)


def q_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.volatility(daily_bars(spark, sf)), RISK)


def q_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.regression(daily_bars(spark, sf)), REG, 5)


def q_levels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indicators.weekly_levels(daily_bars(spark, sf)), LEVELS)


def q_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.squeeze(daily_bars(spark, sf)).select(*KEYS, "squeezed", "squeeze_len")


def q_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.recursive(daily_bars(spark, sf)), KERNEL)


def q_supertrend(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.supertrend(daily_bars(spark, sf)).select(*KEYS, "direction", F.round("supertrend", 6).alias("supertrend"))


QUERIES = {
    "ind_trend": (q_trend, TREND_SQL),
    "ind_oscillators": (q_oscillators, OSC_SQL),
    "ind_volume": (q_volume, VOL_SQL),
    "ind_volatility": (q_volatility, RISK_SQL),
    "ind_regression": (q_regression, REG_SQL),
    "ind_levels": (q_levels, LEVELS_SQL),
    "ind_squeeze": (q_squeeze, SQUEEZE_SQL),
    "ind_recursive": (q_recursive, KERNEL_SQL),
    "ind_supertrend": (q_supertrend, SUPERTREND_SQL),
}
