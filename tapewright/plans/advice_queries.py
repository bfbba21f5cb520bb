"""Queries of ``operators.advice``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import advice as A
from tapewright.operators import scoring
from tapewright.plans.cross_queries import QUOTES_CTE, WEEK_CTE
from tapewright.plans.decision_queries import EVID_CTE, SCORE_CTE
from tapewright.plans.indicator_queries import FRAMES, VOL_SQL, full, prior
from tapewright.plans.signal_queries import RANGE_CTE, RECURSIVE_CTE
from tapewright.session import table
from tapewright.sources.panels import BARS_SQL, daily_bars, weekly_bars

_B = "PARTITION BY symbol ORDER BY bar_ix"
MACD_SQL = RECURSIVE_CTE + f""", k AS (SELECT bars.*, ema12 - ema26 AS macd, ema200 FROM bars JOIN r ON r.symbol = bars.symbol AND r.bar_ix = bars.bar_ix),
c AS (SELECT *, CASE WHEN macd > 0 AND lag(macd) OVER b <= 0 THEN 1 WHEN macd < 0 AND lag(macd) OVER b >= 0 THEN -1 ELSE 0 END AS x FROM k WINDOW b AS ({_B})), d AS (SELECT *, coalesce(sum(abs(x)) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS recent FROM c)
SELECT symbol, trade_date, CAST(x AS INT) AS side FROM d WHERE recent = 0 AND ((x = 1 AND close > ema200) OR (x = -1 AND close < ema200))"""
SPRING_SQL = BARS_SQL + RANGE_CTE.format(source="bars") + f""", s AS (SELECT *, volume / ({prior('avg(volume)', 20)}) AS rvol FROM rf {FRAMES}), t AS (SELECT *, 100 * (sup - low) / sup AS depth, (close - low) / (high - low) AS pos FROM s WHERE bar_ix > 45 AND low < sup AND close > sup)
SELECT symbol, trade_date, round(depth, 6) AS depth_pct, round(pos, 6) AS close_pos, round(40 * greatest(0, least(1, 1 - depth / 3)) + 35 * pos + 25 * greatest(0, least(1, rvol / 2)), 4) AS quality FROM t"""
VERDICT_SQL = VOL_SQL[: VOL_SQL.rindex("SELECT symbol, trade_date")].rstrip() + f""", u AS (SELECT *, CASE WHEN close > lag(close) OVER b THEN volume ELSE 0 END AS up_vol FROM t {FRAMES}),
z AS (SELECT *, {full('regr_slope(obv, bar_ix)', 20)} AS so, {full('regr_slope(vpt, bar_ix)', 20)} AS sv, {full('avg(force_raw)', 10, 'force_raw')} AS f10, ({full('sum(up_vol)', 20)}) / ({full('sum(volume)', 20)}) AS us FROM u {FRAMES})
SELECT symbol, trade_date, CAST(CASE WHEN so > 1e-6 THEN 1 WHEN so < -1e-6 THEN -1 ELSE 0 END + CASE WHEN sv > 1e-6 THEN 1 WHEN sv < -1e-6 THEN -1 ELSE 0 END + CASE WHEN f10 > 1e-6 THEN 1 WHEN f10 < -1e-6 THEN -1 ELSE 0 END + CASE WHEN cmf20 > 0.05 THEN 1 WHEN cmf20 < -0.05 THEN -1 ELSE 0 END
  + CASE WHEN us > 0.55 THEN 1 WHEN us < 0.45 THEN -1 ELSE 0 END + CASE WHEN rvol_prior >= 2 AND close > open THEN 1 WHEN rvol_prior >= 2 AND close < open THEN -1 ELSE 0 END AS INT) AS verdict FROM z WHERE so IS NOT NULL"""
DAILY_WEEKLY_SQL = EVID_CTE + WEEK_CTE[len(BARS_SQL) :] + """, j AS (SELECT h.symbol, h.trade_date, h.score, CASE WHEN w.close > w.sma4 THEN 1 WHEN w.close < w.sma4 THEN -1 ELSE 0 END AS weekly FROM h ASOF LEFT JOIN wks w ON h.symbol = w.symbol AND h.trade_date > w.week), k AS (SELECT *, greatest(0, least(100, score + 5 * weekly)) AS blend FROM j)
SELECT symbol, trade_date, CAST(weekly AS INT) AS weekly, round(blend, 4)::DOUBLE AS blend, CASE WHEN blend >= 65 AND weekly >= 0 THEN 'BUY' WHEN blend >= 60 THEN 'TRIGGER' WHEN blend >= 40 THEN 'WAIT' ELSE 'AVOID' END AS verdict FROM k"""
RISK_SQL = SCORE_CTE.replace("SELECT *, close - lag(close) OVER b AS diff,", f"SELECT *, close - lag(close) OVER b AS diff, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, {full('avg(volume * close)', 20)} AS avg_value, max(bar_ix) OVER (PARTITION BY symbol) AS last,", 1) + f""", k AS (SELECT *, {full('avg(tr)', 14)} AS atr14, CASE WHEN close <> lo20 THEN (hi20 - close) / (close - lo20) END AS rr FROM g {FRAMES})
SELECT symbol, trade_date, array_to_string(list_filter([CASE WHEN 100 * atr14 / close > 2 THEN 'volatile' END, CASE WHEN close / sma20 - 1 > 0.05 THEN 'extended' END, CASE WHEN rsi > 70 THEN 'overbought' END], lambda x: x IS NOT NULL), ',') AS warnings,
  array_to_string(list_filter([CASE WHEN avg_value < 5000 THEN 'illiquid' END, CASE WHEN rr < 0.5 OR rr IS NULL THEN 'reward' END, CASE WHEN close < lo20 THEN 'broken' END], lambda x: x IS NOT NULL), ',') AS vetoes, CAST(floor(1e6 * 0.01 / (2 * atr14)) AS BIGINT) AS shares FROM k WHERE bar_ix = last"""
BLEND_SQL = QUOTES_CTE + ", b AS (SELECT symbol, sector, pct, avg(pct) OVER () AS m, avg(pct) OVER (PARTITION BY sector) AS s FROM q) SELECT symbol, sector, round(0.3 * greatest(0, least(100, 50 + 10 * m)) + 0.3 * greatest(0, least(100, 50 + 10 * s)) + 0.4 * greatest(0, least(100, 50 + 10 * pct)), 4) AS blend FROM b"
LOAD_SQL = """WITH i AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN s_name || '-x' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_suppkey % 5 = 1),
n AS (SELECT k, count(*) AS n, min(name) AS name FROM i GROUP BY k) SELECT n.k, CASE WHEN n > 1 THEN 'duplicate' WHEN s_suppkey IS NULL THEN 'new' WHEN s_name IS NOT DISTINCT FROM name THEN 'same' ELSE 'conflict' END AS plan FROM n LEFT JOIN supplier ON s_suppkey = n.k"""
UPDATES_SQL = """WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n, min_by(value, (ts, event_id)) AS a, max_by(value, (ts, event_id)) AS z FROM events GROUP BY 1, 2, 3) SELECT user_id, event_type, day, CASE WHEN n = 1 THEN 'inserted' WHEN a <> z THEN 'updated' ELSE 'unchanged' END AS status FROM g"""
INCREMENTAL_SQL = BARS_SQL + ", m AS (SELECT symbol, max(trade_date) AS mark FROM bars WHERE trade_date < DATE '2001-01-01' AND symbol <> 'MACHINERY' GROUP BY symbol) SELECT b.symbol, b.trade_date, CASE WHEN b.trade_date = mark THEN 'recheck' ELSE 'new' END AS kind FROM bars b LEFT JOIN m ON m.symbol = b.symbol WHERE mark IS NULL OR b.trade_date >= mark"
FRESH_SQL = BARS_SQL + ", l AS (SELECT symbol, max(trade_date) AS d FROM bars GROUP BY symbol) SELECT count(*) AS symbols, round(avg(CASE WHEN d = (SELECT max(d) FROM l) THEN 1.0 ELSE 0.0 END), 6) AS fresh FROM l"
OFFSET_SQL = BARS_SQL + ", e AS (SELECT symbol, max_by(bar_ix, (volume, -bar_ix)) AS ix, max_by(close, (volume, -bar_ix)) AS c FROM bars GROUP BY symbol) SELECT b.symbol, CAST(b.bar_ix - ix AS INT) AS \"offset\", round(100 * (close / c - 1), 6) AS ret_pct FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_ix BETWEEN ix - 5 AND ix + 5"
TRADES_SQL = EVID_CTE + f""", x AS (SELECT *, lead(open) OVER b AS entry, lead(close, 10) OVER b AS exit, CASE WHEN count(close) OVER f = 10 THEN min(low) OVER f END AS worst FROM h WINDOW b AS ({_B}), f AS ({_B} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT symbol, trade_date, round(exit / entry - 1, 6) AS ret, round(worst / entry - 1, 6) AS worst_pct, round(CASE WHEN entry <> lo20 THEN (exit - entry) / (entry - lo20) END, 4) AS r_multiple FROM x WHERE bar_ix % 5 = 0 AND score >= 58 AND exit IS NOT NULL"""


def q_macd(spark, sf):
    return A.macd_zero_cross(daily_bars(spark, sf)).select("symbol", "trade_date", F.col("cross").alias("side"))


def q_flat(spark, sf):
    return A.flat_bases(daily_bars(spark, sf))


def q_spring(spark, sf):
    return A.spring_quality(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("depth_pct", 6).alias("depth_pct"), F.round("close_pos", 6).alias("close_pos"), F.round("quality", 4).alias("quality"))


def q_volume_verdict(spark, sf):
    return A.volume_verdict(daily_bars(spark, sf)).select("symbol", "trade_date", "verdict")


def q_daily_weekly(spark, sf):
    return A.daily_weekly_verdict(daily_bars(spark, sf)).select("symbol", "trade_date", "weekly", F.round("blend", 4).alias("blend"), "verdict")


def q_risk(spark, sf):
    return A.risk_checks(daily_bars(spark, sf))


def q_blend(spark, sf):
    from tapewright.operators.cross_section import quotes

    return A.blended_scores(quotes(weekly_bars(spark, sf), "week")).select("symbol", "sector", F.round("blend", 4).alias("blend"))


def q_load(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = s.filter("k % 2 = 0").withColumn("name", F.when(F.col("k") % 7 == 0, F.concat("name", F.lit("-x"))).otherwise(F.col("name")))
    new = new.unionByName(s.filter("k % 10 = 0")).unionByName(s.filter("k % 5 = 1").withColumn("k", F.col("k") + 1000000))
    return A.load_plan(s, new, "k", ["name"]).select("k", "plan")


def q_updates(spark, sf):
    return A.daily_updates(table(spark, sf, "events")).select("user_id", "event_type", "day", "status")


def q_incremental(spark, sf):
    b = daily_bars(spark, sf)
    return A.incremental(b.filter("trade_date < '2001-01-01' and symbol != 'MACHINERY'"), b).select("symbol", "trade_date", "kind")


def q_fresh(spark, sf):
    last = daily_bars(spark, sf).groupBy("symbol").agg(F.max("trade_date").alias("d"))
    newest = last.agg(F.max("d").alias("m"))
    return last.crossJoin(F.broadcast(newest)).agg(F.count("*").alias("symbols"), F.round(F.avg((F.col("d") == F.col("m")).cast("double")), 6).alias("fresh"))


def q_offsets(spark, sf):
    return A.event_offsets(daily_bars(spark, sf)).select("symbol", "offset", F.round("ret_pct", 6).alias("ret_pct"))


def q_score_trades(spark, sf):
    t = A.score_trades(scoring.evidence(daily_bars(spark, sf)))
    return t.select("symbol", "trade_date", F.round("ret", 6).alias("ret"), F.round("worst_pct", 6).alias("worst_pct"), F.round("r_multiple", 4).alias("r_multiple"))


QUERIES = {
    "pat_macd_zero_cross": (q_macd, MACD_SQL), "pat_flat_bases": (q_flat, None), "pat_spring_quality": (q_spring, SPRING_SQL), "ind_volume_verdict": (q_volume_verdict, VERDICT_SQL), "dec_daily_weekly": (q_daily_weekly, DAILY_WEEKLY_SQL),
    "dec_risk_checks": (q_risk, RISK_SQL), "dec_blend": (q_blend, BLEND_SQL), "ev_load_plan": (q_load, LOAD_SQL), "src_daily_updates": (q_updates, UPDATES_SQL), "src_incremental": (q_incremental, INCREMENTAL_SQL), "src_fresh_share": (q_fresh, FRESH_SQL),
    "pat_event_offsets": (q_offsets, OFFSET_SQL), "bt_score_trades": (q_score_trades, TRADES_SQL),
}
