"""Inference, barrier, pivot and walk-forward queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import pivots as V
from tapewright.operators import candles as K
from tapewright.operators import signals as S
from tapewright.operators import statistics as T
from tapewright.plans.indicator_queries import FRAMES, full
from tapewright.plans.signal_queries import CANDLE_CTES, hits_sql
from tapewright.sources.panels import BARS_SQL, daily_bars

EVENTS = BARS_SQL + CANDLE_CTES + ", fx AS (SELECT *, lead(close, 10) OVER b / close - 1 AS fwd FROM cf WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)), ev AS (" + hits_sql("fx", K.CANDLES, "symbol, trade_date, bar_ix, fwd", "fwd IS NOT NULL") + ")"
WILSON_SQL = EVENTS + """, a AS (SELECT signal, count(*) AS n, CAST(sum(CASE WHEN fwd > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ev GROUP BY signal), z AS (SELECT *, CAST(hits AS DOUBLE) / n AS p, 3.8416 AS zz FROM a)
SELECT signal, n, hits, round(p, 6) AS share, round((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n), 6) AS low, round((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n), 6) AS high FROM z"""
CLUSTER_SQL = EVENTS + """, c AS (SELECT signal, trade_date, count(*) AS m, sum(fwd) AS s FROM ev GROUP BY signal, trade_date), a AS (SELECT signal, sum(s) / sum(m) AS mean, CAST(sum(m) AS BIGINT) AS n, count(*) AS clusters FROM c GROUP BY signal),
r AS (SELECT a.signal, n, clusters, mean, sqrt(sum((s - m * mean) ** 2) * CASE WHEN clusters > 1 THEN clusters / (clusters - 1) END) / n AS se FROM c JOIN a ON a.signal = c.signal GROUP BY a.signal, n, clusters, mean)
SELECT signal, n, clusters, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high FROM r"""
EFFECT_BASE = BARS_SQL + f""", e0 AS (SELECT symbol, trade_date, lead(close, 10) OVER b / close - 1 AS y, CASE WHEN close > ({full('avg(close)', 50)}) THEN 1.0 ELSE 0.0 END AS x, {full('avg(close)', 50)} AS s FROM bars {FRAMES}), e AS (SELECT * FROM e0 WHERE y IS NOT NULL AND s IS NOT NULL)"""
EFFECT_SQL = EFFECT_BASE + """, m AS (SELECT count(*) AS n, avg(x) AS xbar, covar_pop(x, y) / var_pop(x) AS effect, avg(y) AS ybar, var_pop(x) * count(*) AS sxx FROM e),
u AS (SELECT symbol, trade_date, sum((x - xbar) * (y - ybar - effect * (x - xbar))) AS u FROM e, m GROUP BY symbol, trade_date),
va AS (SELECT sum(s * s) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY trade_date)), vb AS (SELECT sum(s * s) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY symbol)), vab AS (SELECT sum(u * u) AS v FROM u),
r AS (SELECT n, effect, sqrt(greatest(va.v + vb.v - vab.v, 0)) / sxx AS se FROM m, va, vb, vab) SELECT n, round(effect, 8) AS effect, round(se, 8) AS se, round(effect / se, 4) AS t FROM r"""
BARRIER_SQL = BARS_SQL + """, h AS (
  SELECT a.symbol, a.trade_date, a.bar_ix, count(b.bar_ix) AS n, min(CASE WHEN b.high >= a.close * 1.03 THEN b.bar_ix END) AS up, min(CASE WHEN b.low <= a.close * (1 - 0.02) THEN b.bar_ix END) AS dn
  FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.bar_ix BETWEEN a.bar_ix + 1 AND a.bar_ix + 20 GROUP BY a.symbol, a.trade_date, a.bar_ix
), l AS (SELECT *, CASE WHEN n < 20 THEN NULL WHEN dn IS NOT NULL AND (up IS NULL OR dn <= up) THEN -1 WHEN up IS NOT NULL THEN 1 ELSE 0 END AS label FROM h)
SELECT symbol, trade_date, CAST(label AS INT) AS label, CAST(CASE WHEN label <> 0 THEN least(coalesce(up, dn), coalesce(dn, up)) - bar_ix END AS INT) AS bars_to FROM l"""
TRADES_CTE = BARS_SQL + f""", x0 AS (SELECT *, {full('avg(close)', 20)} AS sma20, {full('stddev_samp(close)', 20)} AS sd FROM bars {FRAMES}), x AS (SELECT *, coalesce(close < sma20 - 2 * sd, false) AS flag FROM x0),
t0 AS (SELECT x.symbol, x.trade_date, x.bar_ix, n.open AS entry FROM x JOIN bars n ON n.symbol = x.symbol AND n.bar_ix = x.bar_ix + 1 JOIN bars e ON e.symbol = x.symbol AND e.bar_ix = x.bar_ix + 10 WHERE flag),
p AS (SELECT t0.*, b.bar_ix - t0.bar_ix AS k, b.open AS o, b.close AS c, b.low <= entry * (1 - 0.02) AS st, b.high >= entry * (1 + 0.04) AS tg FROM t0 JOIN bars b ON b.symbol = t0.symbol AND b.bar_ix BETWEEN t0.bar_ix + 1 AND t0.bar_ix + 10),
e AS (SELECT symbol, trade_date, any_value(entry) AS entry, min(CASE WHEN st OR tg THEN k END) AS k0, max_by(c, k) AS last FROM p GROUP BY symbol, trade_date),
tr AS (SELECT e.symbol, e.trade_date, e.entry, CASE WHEN k0 IS NULL THEN 'timeout' WHEN st THEN 'stop' ELSE 'target' END AS why, CASE WHEN k0 IS NULL THEN last WHEN st THEN least(o, e.entry * (1 - 0.02)) ELSE greatest(o, e.entry * (1 + 0.04)) END AS exit, CAST(coalesce(k0, 10) AS INT) AS bars
  FROM e LEFT JOIN p ON p.symbol = e.symbol AND p.trade_date = e.trade_date AND p.k = e.k0), trr AS (SELECT *, exit / entry - 1 AS ret FROM tr)"""
TRADES_SQL = TRADES_CTE + " SELECT symbol, trade_date, round(entry, 6) AS entry, why, round(exit, 6) AS exit, bars, round(ret, 6) AS ret FROM trr"
TRADE_STATS_SQL = TRADES_CTE + """, c AS (SELECT *, sum(ret) OVER w AS cum FROM trr WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM c)
SELECT symbol, count(*) AS n, round(100.0 * count(*) FILTER (WHERE why = 'target') / count(*), 4) AS target_pct, round(sum(ret) FILTER (WHERE ret > 0) / -sum(ret) FILTER (WHERE ret < 0), 4) AS profit_factor, round(avg(ret), 6) AS expectancy, round(avg(ret) / stddev_samp(ret), 4) AS sharpe, round(max(dd), 6) AS max_drawdown FROM d GROUP BY symbol"""
SPLIT = "CASE WHEN (bar_ix - 1) / greatest(max(bar_ix) OVER (PARTITION BY symbol) - 1, 1) < 0.6 THEN 'train' WHEN (bar_ix - 1) / greatest(max(bar_ix) OVER (PARTITION BY symbol) - 1, 1) < 0.8 THEN 'validation' ELSE 'test' END AS part"
WALK_SQL = EVENTS.replace("fx AS (SELECT *,", f"fx AS (SELECT *, {SPLIT},", 1).replace("bar_ix, fwd,", "bar_ix, fwd, part,") + """, s0 AS (SELECT signal, avg(CASE WHEN part = 'train' THEN CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END END) AS train, count(*) FILTER (WHERE part = 'test') AS n_test, CAST(sum(CASE WHEN part = 'test' THEN CASE WHEN fwd > 0 THEN 1 ELSE 0 END END) AS BIGINT) AS wins FROM ev GROUP BY signal),
s1 AS (SELECT *, row_number() OVER (ORDER BY train, signal) - 1 AS ix, count(*) OVER () AS m FROM s0 WHERE train IS NOT NULL AND n_test > 0), s2 AS (SELECT *, CAST(least(ix // greatest(m // 5, 1), 4) AS INT) AS bin FROM s1)
SELECT bin, count(*) AS signals, round(avg(train) * 100, 4) AS train_rate, CAST(sum(n_test) AS BIGINT) AS n_test, round(100.0 * sum(wins) / sum(n_test), 4) AS test_rate FROM s2 GROUP BY bin"""
PIVOT_CTE = BARS_SQL + """, f AS (SELECT *, count(*) OVER ar = 7 AS ok, max(high) OVER bf AS hb, max(high) OVER af AS ha, min(low) OVER bf AS lb, min(low) OVER af AS la FROM bars WINDOW ar AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), bf AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), af AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
c AS (SELECT symbol, trade_date, bar_ix, 'H' AS kind, high AS price FROM f WHERE ok AND high > hb AND high >= ha UNION ALL SELECT symbol, trade_date, bar_ix, 'L', low FROM f WHERE ok AND low < lb AND low <= la),
o AS (SELECT *, CASE WHEN kind = 'H' THEN last_value(CASE WHEN kind = 'L' THEN price END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN kind = 'H' THEN price END IGNORE NULLS) OVER w END AS other FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_ix, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY symbol ORDER BY bar_ix, kind) THEN 0 ELSE 1 END AS new FROM o WHERE other IS NULL OR abs(price / other - 1) >= 0.02),
r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bar_ix, kind ROWS UNBOUNDED PRECEDING) AS run FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'H' THEN -price ELSE price END, bar_ix) AS rn FROM r), pv AS (SELECT symbol, trade_date, bar_ix, kind, price, bar_ix + 3 AS confirmed_ix FROM b WHERE rn = 1)"""
PIVOT_SQL = PIVOT_CTE + " SELECT symbol, trade_date, CAST(bar_ix AS INT) AS bar_ix, kind, round(price, 6) AS price, CAST(confirmed_ix AS INT) AS confirmed_ix FROM pv"
STRUCT_SQL = PIVOT_CTE + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY bar_ix DESC) AS q FROM pv), s AS (SELECT symbol, max(CASE WHEN kind = 'H' AND q = 1 THEN price END) AS h1, max(CASE WHEN kind = 'H' AND q = 2 THEN price END) AS h2, max(CASE WHEN kind = 'L' AND q = 1 THEN price END) AS l1, max(CASE WHEN kind = 'L' AND q = 2 THEN price END) AS l2 FROM n WHERE q <= 2 GROUP BY symbol)
SELECT symbol, round(h1, 6) AS h1, round(h2, 6) AS h2, round(l1, 6) AS l1, round(l2, 6) AS l2, CASE WHEN h1 > h2 AND l1 > l2 THEN 'HH/HL' WHEN h1 < h2 AND l1 < l2 THEN 'LH/LL' ELSE 'mixed' END AS structure FROM s"""
DOUBLE_SQL = PIVOT_CTE + """, t AS (SELECT symbol, kind AS k0, price AS p0, bar_ix AS b0, lead(kind) OVER w AS k1, lead(price) OVER w AS p1, lead(bar_ix) OVER w AS b1, lead(kind, 2) OVER w AS k2, lead(price, 2) OVER w AS p2, lead(bar_ix, 2) OVER w AS b2, lead(confirmed_ix, 2) OVER w AS fx FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY bar_ix, kind)),
d AS (SELECT * FROM t WHERE k0 = 'L' AND k1 = 'H' AND k2 = 'L' AND abs(p2 / p0 - 1) <= 0.03 AND b2 - b0 BETWEEN 5 AND 120)
SELECT d.symbol, CAST(b0 AS INT) AS bar_ix_0, CAST(b2 AS INT) AS bar_ix_2, round(any_value(p1), 6) AS neckline, min(bars.trade_date) AS breakout_date, round(any_value(2 * p1 - least(p0, p2)), 6) AS target
FROM d JOIN bars ON bars.symbol = d.symbol AND bars.bar_ix > fx AND bars.bar_ix <= fx + 30 AND bars.close > p1 GROUP BY d.symbol, b0, b1, b2"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    f = K.candle_frame(daily_bars(spark, sf)).withColumn("fwd", S.P.lead("close", 10) / F.col("close") - 1)
    return S.long_form(f.filter("fwd is not null"), K.CANDLES, ["symbol", "trade_date", "bar_ix", "fwd"])


def q_wilson(spark, sf):
    return T.hit_rates(_events(spark, sf).withColumn("hit", F.col("fwd") > 0), ["signal"], "hit")


def q_cluster(spark, sf):
    return T.cluster_interval(_events(spark, sf), ["signal"], "trade_date", "fwd")


def q_effect(spark, sf):
    p = S.P
    f = daily_bars(spark, sf).withColumns({"y": p.lead("close", 10) / F.col("close") - 1, "s": p.full(F.avg("close"), 50)}).filter("y is not null and s is not null")
    return T.two_way_effect(f.withColumn("x", F.col("close") > F.col("s")), "x", "y", "trade_date", "symbol")


def q_discovery(spark, sf):
    c = q_cluster(spark, sf).filter("se > 0 and n >= 30").withColumn("t", F.round(F.abs(F.col("mean") / F.col("se")), 4))
    return T.benjamini_hochberg(T.p_values(c)).select("signal", "t", "p", "q", "passes")


def q_barrier(spark, sf):
    return T.triple_barrier(daily_bars(spark, sf)).select("symbol", "trade_date", F.col("label").cast("int").alias("label"), F.col("bars_to").cast("int").alias("bars_to"))


def _trades(spark, sf):
    f = daily_bars(spark, sf).withColumns({"sma20": S.P.full(F.avg("close"), 20), "sd": S.P.full(F.stddev_samp("close"), 20)})
    return T.next_open_trades(f.withColumn("flag", F.coalesce(F.col("close") < F.col("sma20") - 2 * F.col("sd"), F.lit(False))))


def q_trades(spark, sf):
    return _trades(spark, sf).select("symbol", "trade_date", F.round("entry", 6).alias("entry"), "why", F.round("exit", 6).alias("exit"), F.col("bars").cast("int").alias("bars"), F.round("ret", 6).alias("ret"))


def q_trade_stats(spark, sf):
    return T.trade_stats(_trades(spark, sf), ["symbol"])


def q_walk_forward(spark, sf):
    f = T.split_position(K.candle_frame(daily_bars(spark, sf)).withColumn("fwd", S.P.lead("close", 10) / F.col("close") - 1))
    return T.walk_forward(S.long_form(f.filter("fwd is not null"), K.CANDLES, ["fwd", "part"]), "fwd")


def q_bootstrap(spark, sf):
    f = daily_bars(spark, sf).withColumns({"y": S.P.lead("close", 10) / F.col("close") - 1, "s": S.P.full(F.avg("close"), 50)}).filter("y is not null and s is not null")
    return T.bootstrap_difference(f.withColumn("x", F.col("close") > F.col("s")), "x", "y", "trade_date")


def q_pivots(spark, sf):
    return V.pivots(daily_bars(spark, sf)).withColumn("price", F.round("price", 6))


def q_structure(spark, sf):
    return V.structure(daily_bars(spark, sf)).select("symbol", *[F.round(c, 6).alias(c) for c in ("h1", "h2", "l1", "l2")], "structure")


def q_double_bottom(spark, sf):
    return V.double_bottoms(daily_bars(spark, sf)).select("symbol", "bar_ix_0", "bar_ix_2", F.round("neckline", 6).alias("neckline"), "breakout_date", F.round("target", 6).alias("target"))


def q_cooldown(spark, sf):
    e = S.long_form(S.range_frame(daily_bars(spark, sf)), {"Resistance Breakout": S.RANGE_EVENTS["Resistance Breakout"]}, ["symbol", "trade_date", "bar_ix"])
    return V.cooldown(e, 20).select("symbol", "trade_date", "bar_ix")


COOLDOWN_SQL = BARS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, rf AS (SELECT *, max(high) OVER d AS res_b FROM bars WINDOW d AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 40 PRECEDING AND 4 PRECEDING)),
e AS MATERIALIZED (SELECT symbol, trade_date, bar_ix FROM rf WHERE bar_ix > 40 AND close > res_b),
g AS (SELECT symbol, min(bar_ix) AS bar_ix FROM e GROUP BY symbol UNION ALL SELECT n.symbol, n.bar_ix FROM (SELECT g.symbol, min(e.bar_ix) AS bar_ix FROM g JOIN e ON e.symbol = g.symbol AND e.bar_ix >= g.bar_ix + 20 GROUP BY g.symbol) n)
SELECT e.symbol, e.trade_date, CAST(e.bar_ix AS INT) AS bar_ix FROM e JOIN g ON g.symbol = e.symbol AND g.bar_ix = e.bar_ix"""

QUERIES = {
    "st_wilson": (q_wilson, WILSON_SQL), "st_cluster_interval": (q_cluster, CLUSTER_SQL), "st_two_way_effect": (q_effect, EFFECT_SQL), "st_false_discovery": (q_discovery, None),
    "st_triple_barrier": (q_barrier, BARRIER_SQL), "bt_next_open_trades": (q_trades, TRADES_SQL), "bt_trade_stats": (q_trade_stats, TRADE_STATS_SQL), "bt_walk_forward": (q_walk_forward, WALK_SQL),
    "st_bootstrap": (q_bootstrap, None), "piv_confirmed": (q_pivots, PIVOT_SQL), "piv_structure": (q_structure, STRUCT_SQL), "piv_double_bottom": (q_double_bottom, DOUBLE_SQL), "seq_cooldown": (q_cooldown, COOLDOWN_SQL),
}
