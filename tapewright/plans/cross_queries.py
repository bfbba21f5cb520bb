"""Cross-section queries over weekly bars with sectors, and audits over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import cross_section as X
from tapewright.session import table
from tapewright.sources.panels import BARS_SQL, WEEKLY_SQL, daily_bars, weekly_bars

QUOTES_CTE = WEEKLY_SQL + """, two AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_ix) AS ldcp, row_number() OVER (PARTITION BY symbol ORDER BY bar_ix DESC) AS rn FROM weekly),
q0 AS (SELECT symbol, sector, ldcp, week, open, high, low, close, volume, close - ldcp AS change, 100 * (close - ldcp) / ldcp AS pct, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS loc FROM two WHERE rn = 1 AND ldcp IS NOT NULL),
q AS (SELECT *, greatest(0, least(100, 50 + greatest(-20, least(20, pct * 2.2)) + (loc - 0.5) * 24 + least(20, log10(greatest(volume, 1)) * 3) / 2)) AS score,
  CASE WHEN pct > 2 AND loc > 0.7 THEN 'Breakout' WHEN pct < -2 AND loc < 0.3 THEN 'Breakdown' WHEN loc > 0.7 THEN 'Accumulation' WHEN loc < 0.3 THEN 'Distribution' ELSE 'Neutral' END AS setup FROM q0)"""
BREADTH = """count(*) AS n, count(*) FILTER (WHERE pct > 0) AS advancers, count(*) FILTER (WHERE pct < 0) AS decliners, count(*) - count(*) FILTER (WHERE pct > 0) - count(*) FILTER (WHERE pct < 0) AS unchanged,
  round(100.0 * count(*) FILTER (WHERE pct > 0) / greatest(1, count(*) FILTER (WHERE pct <> 0)), 4) AS breadth_pct, round(avg(pct), 4) AS avg_pct, sum(volume) AS volume"""
QUOTES_SQL = QUOTES_CTE + " SELECT symbol, sector, week, round(ldcp, 6) AS ldcp, round(close, 6) AS close, round(change, 6) AS change, round(pct, 4) AS pct, volume, round(score, 4) AS score, setup FROM q"
REGIME_SQL = QUOTES_CTE + f", b AS (SELECT {BREADTH} FROM q) SELECT *, round(greatest(0, least(100, 0.6 * breadth_pct + 0.4 * greatest(0, least(100, 50 + avg_pct * 10)))), 4) AS regime_score FROM b"
SECTOR_SQL = QUOTES_CTE + f""", b AS (SELECT sector, {BREADTH} FROM q GROUP BY sector),
l AS (SELECT sector, string_agg(symbol, ',' ORDER BY rn) AS leaders FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY pct DESC, symbol) AS rn FROM q) WHERE rn <= 3 GROUP BY sector),
s AS (SELECT b.*, leaders, round(greatest(0, least(100, 0.55 * breadth_pct + 0.45 * greatest(0, least(100, 50 + avg_pct * 10)))), 4) AS strength FROM b JOIN l ON l.sector = b.sector)
SELECT *, CAST(row_number() OVER (ORDER BY strength DESC, sector) AS INT) AS rank FROM s"""
BUCKET_SQL = QUOTES_CTE + """, p AS (
  SELECT symbol, score, 'top_score' AS bucket FROM q UNION ALL SELECT symbol, score, 'momentum' FROM q WHERE pct > 1 UNION ALL SELECT symbol, score, 'breakout' FROM q WHERE setup = 'Breakout'
  UNION ALL SELECT symbol, score, 'accumulation' FROM q WHERE setup = 'Accumulation' UNION ALL SELECT symbol, score, 'weak' FROM q WHERE pct < -1 UNION ALL SELECT symbol, score, 'liquid' FROM q WHERE volume >= 20
) SELECT symbol, round(score, 4) AS score, bucket, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, symbol) AS rank FROM p) WHERE rank <= 10"""
RET_CTE = WEEKLY_SQL + ", r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_ix) - 1 AS ret FROM weekly)"
LOO_SQL = RET_CTE + """, f AS (SELECT * FROM r WHERE ret IS NOT NULL AND abs(ret) <= 0.5)
SELECT a.symbol, a.sector, a.week, round(a.ret, 6) AS ret, count(b.symbol) AS peers, round(avg(b.ret), 6) AS peer_ret
FROM f a LEFT JOIN f b ON a.sector = b.sector AND a.week = b.week AND a.symbol <> b.symbol GROUP BY a.symbol, a.sector, a.week, a.ret"""
INDEX_CTE = RET_CTE + """, d AS (SELECT week, avg(ret) AS index_ret FROM r WHERE ret IS NOT NULL GROUP BY week),
idx AS (SELECT *, 100 * exp(sum(ln(1 + index_ret)) OVER (ORDER BY week ROWS UNBOUNDED PRECEDING)) AS index_level FROM d)"""
INDEX_SQL = INDEX_CTE + ", s AS (SELECT *, CASE WHEN count(*) OVER w50 = 50 THEN avg(index_level) OVER w50 END AS sma50 FROM idx WINDOW w50 AS (ORDER BY week ROWS 49 PRECEDING)), t AS (SELECT *, sma50 - lag(sma50, 5) OVER (ORDER BY week) AS slope FROM s) SELECT week, round(index_ret, 6) AS index_ret, round(index_level, 6) AS index_level, CASE WHEN index_level > sma50 AND slope > 0 THEN 'Bull' WHEN index_level < sma50 AND slope < 0 THEN 'Bear' WHEN slope IS NOT NULL THEN 'Range' END AS regime FROM t"
_RS_R = ", ".join(f"close / lag(close, {n}) OVER b - 1 AS r_{k}" for k, (n, _) in X.RS_HORIZONS.items())
_RS_I = ", ".join(f"index_level / lag(index_level, {n}) OVER (ORDER BY week) - 1 AS i_{k}" for k, (n, _) in X.RS_HORIZONS.items())
_NUM = " + ".join(f"coalesce((r_{k} - i_{k}) * {w}, 0)" for k, (_, w) in X.RS_HORIZONS.items())
_DEN = " + ".join(f"CASE WHEN r_{k} - i_{k} IS NOT NULL THEN {w} ELSE 0 END" for k, (_, w) in X.RS_HORIZONS.items())
RS_SQL = INDEX_CTE + f""", i AS (SELECT week, {_RS_I} FROM idx), o AS (SELECT *, {_RS_R} FROM weekly WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)),
j AS (SELECT o.*, i.* EXCLUDE (week) FROM o JOIN i ON i.week = o.week), s AS (SELECT *, CASE WHEN {_DEN} > 0 THEN ({_NUM}) / ({_DEN}) END AS rs FROM j)
SELECT symbol, week, round(rs, 6) AS rs, CASE WHEN rs > 0.1 THEN 'Leader' WHEN rs > 0.02 THEN 'Strong' WHEN rs >= -0.02 THEN 'In line' WHEN rs >= -0.1 THEN 'Weak' WHEN rs IS NOT NULL THEN 'Laggard' END AS rs_class FROM s"""
BETA_SQL = INDEX_CTE + """, j AS (SELECT r.symbol, r.week, r.bar_ix, r.ret, idx.index_ret FROM r JOIN idx ON idx.week = r.week WHERE ret IS NOT NULL)
SELECT symbol, week, round(CASE WHEN count(ret) OVER w = 52 THEN covar_samp(ret, index_ret) OVER w / var_samp(index_ret) OVER w END, 5) AS beta, round(CASE WHEN count(ret) OVER w = 52 AND stddev_pop(ret) OVER w > 0 THEN corr(ret, index_ret) OVER w END, 5) AS corr
FROM j WINDOW w AS (PARTITION BY symbol ORDER BY bar_ix ROWS 51 PRECEDING)"""
LIQUIDITY_SQL = BARS_SQL + """, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ix DESC) AS rn FROM bars),
a AS (SELECT symbol, avg(volume) AS avg_volume, quantile_cont(volume, 0.5) AS median_volume, avg(volume * close) AS avg_value, 100.0 * count(*) FILTER (WHERE volume < 20) / count(*) AS low_volume_pct, stddev_pop(volume) / avg(volume) AS cv FROM l WHERE rn <= 60 GROUP BY symbol)
SELECT symbol, round(avg_volume, 4) AS avg_volume, round(median_volume, 4) AS median_volume, round(avg_value, 4) AS avg_value, round(low_volume_pct, 4) AS low_volume_pct, round(cv, 4) AS cv, CASE WHEN avg_value >= 25000 THEN 'HIGH' WHEN avg_value >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM a"""
AUDIT_SQL = BARS_SQL + """, f AS (
  SELECT *, NOT (low <= least(open, close) AND high >= greatest(open, close) AND close > 0 AND volume >= 0) AS bad, date_diff('day', lag(trade_date) OVER b, trade_date) AS gap_days,
    abs(close / lag(close) OVER b - 1) AS move, coalesce(close = lag(close) OVER b, false) AS same FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)
), i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS island FROM f),
runs AS (SELECT symbol, CAST(sum(n // 5) AS BIGINT) AS stale_runs FROM (SELECT symbol, island, count(*) FILTER (WHERE same) AS n FROM i GROUP BY symbol, island) GROUP BY symbol),
a AS (SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE bad) AS bad_rows, count(*) FILTER (WHERE gap_days > 5) AS gaps, CAST(max(gap_days) AS INT) AS max_gap, count(*) FILTER (WHERE move > 0.05) AS big_moves, count(*) FILTER (WHERE high = low) AS locked FROM f GROUP BY symbol)
SELECT a.symbol, n_bars, bad_rows, gaps, max_gap, big_moves, stale_runs, locked, round(greatest(0, least(100, 100 - 5.0 * bad_rows - 0.5 * gaps - 0.1 * big_moves - 1.0 * stale_runs)), 4) AS score FROM a JOIN runs ON runs.symbol = a.symbol"""
FUND_SQL = """WITH s AS (SELECT s_suppkey AS company, n_regionkey AS sector, s_acctbal AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT *, greatest(0, least(100, (value + 1000) / 110)) AS band, CASE WHEN count(*) OVER (PARTITION BY sector) >= 3 THEN 100.0 * (rank() OVER (PARTITION BY sector ORDER BY value) - 1) / greatest(count(*) OVER (PARTITION BY sector) - 1, 1) END AS rel FROM s)
SELECT company, sector, round(band, 4) AS band, round(rel, 4) AS rel, round(CASE WHEN rel IS NULL THEN band ELSE 0.5 * band + 0.5 * rel END, 4) AS score FROM b"""
WEEK_CTE = BARS_SQL + """, wk AS (
  SELECT symbol, CAST(date_trunc('week', trade_date) + INTERVAL 4 DAY AS DATE) AS week, min_by(open, bar_ix) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_ix) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2
), wks AS (SELECT *, CASE WHEN count(*) OVER w = 4 THEN avg(close) OVER w END AS sma4 FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY week ROWS 3 PRECEDING))"""
RESAMPLE_SQL = WEEK_CTE + """ SELECT symbol, 'W' AS rule, week AS period, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM wk
UNION ALL SELECT symbol, 'M', last_day(trade_date), round(min_by(open, bar_ix), 6), round(max(high), 6), round(min(low), 6), round(max_by(close, bar_ix), 6), sum(volume) FROM bars GROUP BY symbol, last_day(trade_date)"""
ASOF_SQL = WEEK_CTE + """ SELECT b.symbol, b.trade_date, w.week AS week_end, round(w.close, 6) AS week_close, round(w.sma4, 6) AS week_sma4 FROM bars b ASOF LEFT JOIN wks w ON b.symbol = w.symbol AND b.trade_date > w.week"""


def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    return X.quotes(weekly_bars(spark, sf), "week")


def q_quotes(spark, sf):
    q = _quotes(spark, sf)
    return q.select("symbol", "sector", "week", *[F.round(c, 6).alias(c) for c in ("ldcp", "close", "change")], F.round("pct", 4).alias("pct"), "volume", F.round("score", 4).alias("score"), "setup")


def q_regime(spark, sf):
    b = X.breadth(_quotes(spark, sf), [])
    return b.withColumn("regime_score", F.round(X.clamp(0.6 * F.col("breadth_pct") + 0.4 * X.clamp(50 + F.col("avg_pct") * 10, 0, 100), 0, 100), 4))


def q_sectors(spark, sf):
    return X.sector_rotation(_quotes(spark, sf))


def q_buckets(spark, sf):
    return X.bucket_lists(_quotes(spark, sf)).select("symbol", F.round("score", 4).alias("score"), "bucket", "rank")


def q_leave_one_out(spark, sf):
    return X.leave_one_out(weekly_bars(spark, sf), "week").select("symbol", "sector", "week", F.round("ret", 6).alias("ret"), "peers", F.round("peer_ret", 6).alias("peer_ret"))


def q_index(spark, sf):
    return X.regimes(weekly_bars(spark, sf), "week").select("week", F.round("index_ret", 6).alias("index_ret"), F.round("index_level", 6).alias("index_level"), "regime")


def q_relative_strength(spark, sf):
    return X.relative_strength(weekly_bars(spark, sf), "week").select("symbol", "week", F.round("rs", 6).alias("rs"), "rs_class")


def q_beta(spark, sf):
    return X.beta(weekly_bars(spark, sf), "week").select("symbol", "week", F.round("beta", 5).alias("beta"), F.round("corr", 5).alias("corr"))


def q_liquidity(spark, sf):
    q = X.liquidity(daily_bars(spark, sf))
    return q.select("symbol", *[F.round(c, 4).alias(c) for c in ("avg_volume", "median_volume", "avg_value", "low_volume_pct", "cv")], "tier")


def q_audit(spark, sf):
    return X.quality_audit(daily_bars(spark, sf))


def q_fundamentals(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = X.sector_percentile(s.select(F.col("s_suppkey").alias("company"), F.col("n_regionkey").alias("sector"), F.col("s_acctbal").alias("value")))
    return out.select("company", "sector", *[F.round(c, 4).alias(c) for c in ("band", "rel", "score")])


def q_resample(spark, sf):
    bars = daily_bars(spark, sf)
    px = [F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")]
    w = X.to_weekly(bars).select("symbol", F.lit("W").alias("rule"), F.col("week").alias("period"), *px, "volume")
    return w.unionByName(X.to_monthly(bars).select("symbol", F.lit("M").alias("rule"), F.col("month").alias("period"), *px, "volume"))


def q_weekly_asof(spark, sf):
    bars = daily_bars(spark, sf)
    out = X.weekly_onto_daily(bars.select("symbol", "trade_date", "bar_ix"), X.to_weekly(bars))
    return out.select("symbol", "trade_date", "week_end", F.round("week_close", 6).alias("week_close"), F.round("week_sma4", 6).alias("week_sma4"))


QUERIES = {
    "cs_quotes": (q_quotes, QUOTES_SQL), "cs_market_regime": (q_regime, REGIME_SQL), "cs_sector_rotation": (q_sectors, SECTOR_SQL), "cs_bucket_lists": (q_buckets, BUCKET_SQL),
    "cs_leave_one_out": (q_leave_one_out, LOO_SQL), "cs_index_regime": (q_index, INDEX_SQL), "cs_relative_strength": (q_relative_strength, RS_SQL), "cs_beta": (q_beta, BETA_SQL),
    "cs_liquidity": (q_liquidity, LIQUIDITY_SQL), "cs_quality_audit": (q_audit, AUDIT_SQL), "cs_sector_percentile": (q_fundamentals, FUND_SQL),
    "res_weekly_monthly": (q_resample, RESAMPLE_SQL), "asof_weekly": (q_weekly_asof, ASOF_SQL),
}
