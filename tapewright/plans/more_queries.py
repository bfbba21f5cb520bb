"""Queries of ``operators.studies``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import signals as S
from tapewright.operators import statistics as T
from tapewright.operators import studies as O
from tapewright.plans.decision_queries import SCORE_CTE
from tapewright.plans.indicator_queries import FRAMES, OSC_SQL, full, prior
from tapewright.plans.signal_queries import hits_sql
from tapewright.plans.study_queries import PIVOT_CTE
from tapewright.sources.panels import BARS_SQL, daily_bars

_B = "PARTITION BY symbol ORDER BY bar_ix"
MFI_SQL = OSC_SQL[: OSC_SQL.rindex("SELECT symbol, trade_date")].rstrip() + f""", g AS (SELECT *, mfi_50 - lag(mfi_50, 5) OVER b AS d5, mfi_50 - lag(mfi_50, 15) OVER b AS d15,
  CASE WHEN count(mfi_50) OVER a15 = 15 THEN regr_slope(mfi_50, bar_ix) OVER a15 END AS slope15, CASE WHEN count(mfi_50) OVER w14 = 14 THEN regr_slope(mfi_50, bar_ix) OVER h2 - regr_slope(mfi_50, bar_ix) OVER h1 END AS accel
  FROM f WINDOW b AS ({_B}), a15 AS ({_B} ROWS 14 PRECEDING), w14 AS ({_B} ROWS 13 PRECEDING), h2 AS ({_B} ROWS 6 PRECEDING), h1 AS ({_B} ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING))
SELECT symbol, trade_date, round(d5, 5) AS d5, round(d15, 5) AS d15, round(slope15, 5) AS slope15, round(accel, 5) AS accel FROM g"""
EMA_SQL = BARS_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""", x AS MATERIALIZED (SELECT symbol, trade_date, bar_ix, close, volume, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, coalesce(close - lag(close) OVER b, 0) * volume AS fr,
  list(close) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS 25 PRECEDING) AS cs FROM bars WINDOW b AS ({_B})),
m AS (SELECT symbol, avg(tr) AS seed FROM x WHERE bar_ix <= 14 GROUP BY symbol),
r AS (SELECT x.symbol, bar_ix, close AS num, 1.0::DOUBLE AS den, NULL::DOUBLE AS atr, fr::DOUBLE AS force FROM x WHERE bar_ix = 1
  UNION ALL SELECT x.symbol, x.bar_ix, r.num * (1 - 2.0 / 27) + x.close, r.den * (1 - 2.0 / 27) + 1, CASE WHEN x.bar_ix = 14 THEN m.seed WHEN x.bar_ix > 14 THEN r.atr + (x.tr - r.atr) / 14 END, r.force + (x.fr - r.force) * (2.0 / 14)
  FROM r JOIN x ON x.symbol = r.symbol AND x.bar_ix = r.bar_ix + 1 JOIN m ON m.symbol = r.symbol)
SELECT r.symbol, x.trade_date, round(num / den, 6) AS ema26_adj, round(atr, 6) AS atr14_seeded, round(CASE WHEN len(cs) = 26 THEN list_reduce(cs, lambda y, z: y + (2.0 / 27) * (z - y)) END, 6) AS ema26_last, round(force, 4) AS force13 FROM r JOIN x ON x.symbol = r.symbol AND x.bar_ix = r.bar_ix"""
LEVEL_SQL = PIVOT_CTE + """, t AS (SELECT *, lag(price, 1) OVER w AS p1, lag(price, 2) OVER w AS p2 FROM pv WINDOW w AS (PARTITION BY symbol, kind ORDER BY bar_ix)), u AS (SELECT symbol, kind, confirmed_ix, greatest(price, p1, p2) AS top, least(price, p1, p2) AS bottom FROM t WHERE p2 IS NOT NULL),
j AS (SELECT b.symbol, b.trade_date, b.close, h.top AS htop, h.top / h.bottom - 1 <= 0.01 AS ht, l.bottom AS lbot, l.top / l.bottom - 1 <= 0.01 AS lt FROM bars b ASOF LEFT JOIN (SELECT * FROM u WHERE kind = 'H') h ON b.symbol = h.symbol AND b.bar_ix >= h.confirmed_ix ASOF LEFT JOIN (SELECT * FROM u WHERE kind = 'L') l ON b.symbol = l.symbol AND b.bar_ix >= l.confirmed_ix),
s AS (SELECT *, CASE WHEN ht AND close > htop * 1.02 THEN 'resistance' WHEN lt AND close < lbot * 0.98 THEN 'support' END AS side FROM j)
SELECT symbol, trade_date, side, round(CASE WHEN side = 'resistance' THEN htop ELSE lbot END, 6) AS level FROM s WHERE side IS NOT NULL"""
BREAK_SQL = SCORE_CTE.replace("SELECT *, close - lag(close) OVER b AS diff,", f"SELECT *, close - lag(close) OVER b AS diff, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, volume / ({prior('avg(volume)', 20)}) AS rvol, CASE WHEN high > low THEN (close - low) / (high - low) END AS pos, lead(close, 10) OVER b / close - 1 AS fwd,", 1) + f""", k AS (SELECT *, rsi AS rsi_simple_100, sma20 - 2 * sd AS bb_low, {full('avg(tr)', 14)} AS atr14 FROM g {FRAMES}), e AS (SELECT * FROM k WHERE close < lo20 AND fwd IS NOT NULL),
ev AS (""" + hits_sql("e", O.BREAK_CONDITIONS, "trade_date, fwd") + """), c AS (SELECT signal, trade_date, count(*) AS m, sum(fwd) AS s FROM ev GROUP BY signal, trade_date), a AS (SELECT signal, sum(s) / sum(m) AS mean, CAST(sum(m) AS BIGINT) AS n, count(*) AS clusters FROM c GROUP BY signal),
r AS (SELECT a.signal, n, clusters, mean, sqrt(sum((s - m * mean) ** 2) * CASE WHEN clusters > 1 THEN clusters / (clusters - 1) END) / n AS se FROM c JOIN a ON a.signal = c.signal GROUP BY a.signal, n, clusters, mean)
SELECT signal, n, clusters, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high FROM r"""
TRAIL_SQL = BARS_SQL + f""", f0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, {prior('max(high)', 20)} AS hi20 FROM bars {FRAMES}), f1 AS (SELECT *, {full('avg(tr)', 14)} AS atr14, max(bar_ix) OVER (PARTITION BY symbol) AS last FROM f0 {FRAMES}),
t AS (SELECT f1.symbol, f1.trade_date, f1.bar_ix, 2.0 * atr14 AS gap, n.open AS entry FROM f1 JOIN bars n ON n.symbol = f1.symbol AND n.bar_ix = f1.bar_ix + 1 WHERE f1.close > hi20 AND atr14 IS NOT NULL AND f1.bar_ix + 20 <= last),
p AS (SELECT t.*, b.bar_ix - t.bar_ix AS k, b.open AS o, b.low AS l, b.close AS c, greatest(entry, coalesce(max(b.high) OVER (PARTITION BY t.symbol, t.bar_ix ORDER BY b.bar_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry)) AS top FROM t JOIN bars b ON b.symbol = t.symbol AND b.bar_ix BETWEEN t.bar_ix + 1 AND t.bar_ix + 20),
x AS (SELECT symbol, trade_date, any_value(entry) AS entry, min(CASE WHEN l <= top - gap THEN k END) AS k0, max_by(c, k) AS final FROM p GROUP BY symbol, trade_date)
SELECT x.symbol, x.trade_date, round(x.entry, 6) AS entry, round(coalesce(least(p.o, p.top - p.gap), final), 6) AS exit, CAST(coalesce(k0, 20) AS INT) AS bars, k0 IS NOT NULL AS stopped FROM x LEFT JOIN p ON p.symbol = x.symbol AND p.trade_date = x.trade_date AND p.k = k0"""
_z = lambda c: f"CASE WHEN count({c}) OVER w60 = 60 AND stddev_samp({c}) OVER w60 <> 0 THEN ({c} - avg({c}) OVER w60) / stddev_samp({c}) OVER w60 END"
FORMULA_SQL = BARS_SQL + f""", g0 AS (SELECT *, close / lag(close, 10) OVER b - 1 AS mom, high / low - 1 AS rng FROM bars {FRAMES}), g1 AS (SELECT *, {_z('mom')} AS z_mom, {_z('volume')} AS z_vol, {_z('rng')} AS z_rng FROM g0 {FRAMES}),
g2 AS (SELECT *, tanh(z_mom * 0.6 + (CASE WHEN z_vol > z_mom THEN z_vol ELSE z_rng END - 0.3 * z_rng)) AS raw FROM g1), g3 AS (SELECT *, CASE WHEN lag(raw) OVER b IS NULL OR abs(raw - lag(raw) OVER b) >= 0.25 THEN raw END AS moved FROM g2 {FRAMES}),
g4 AS (SELECT *, last_value(moved IGNORE NULLS) OVER cum AS weight FROM g3 {FRAMES}), g5 AS (SELECT *, lag(weight) OVER b * (close / lag(close) OVER b - 1) AS ret FROM g4 {FRAMES})
SELECT symbol, trade_date, round(raw, 6) AS raw, round(weight, 6) AS weight, round(ret, 6) AS ret FROM g5"""


def q_mfi(spark, sf):
    return O.mfi_derivatives(daily_bars(spark, sf)).select("symbol", "trade_date", *[F.round(c, 5).alias(c) for c in ("d5", "d15", "slope15", "accel")])


def q_ema(spark, sf):
    return O.ema_variants(daily_bars(spark, sf)).select("symbol", "trade_date", *[F.round(c, 6).alias(c) for c in ("ema26_adj", "atr14_seeded", "ema26_last")], F.round("force13", 4).alias("force13"))


def q_levels(spark, sf):
    return O.level_breaks(daily_bars(spark, sf)).select("symbol", "trade_date", "side", F.round("level", 6).alias("level"))


def q_breaks(spark, sf):
    return T.cluster_interval(S.long_form(O.support_breaks(daily_bars(spark, sf)), O.BREAK_CONDITIONS, ["trade_date", "fwd"]), ["signal"], "trade_date", "fwd")


def q_trailing(spark, sf):
    return O.trailing_trades(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("entry", 6).alias("entry"), F.round("exit", 6).alias("exit"), F.col("bars").cast("int").alias("bars"), "stopped")


def q_formula(spark, sf):
    return O.formula_strategy(daily_bars(spark, sf)).select("symbol", "trade_date", *[F.round(c, 6).alias(c) for c in ("raw", "weight", "ret")])


QUERIES = {
    "ind_mfi_derivatives": (q_mfi, MFI_SQL), "ind_ema_variants": (q_ema, EMA_SQL), "pat_level_breaks": (q_levels, LEVEL_SQL), "st_break_conditions": (q_breaks, BREAK_SQL), "bt_trailing_stop": (q_trailing, TRAIL_SQL), "bt_formula": (q_formula, FORMULA_SQL),
}
