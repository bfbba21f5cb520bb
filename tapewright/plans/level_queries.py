"""Retracement, divergence, rebasing, alert accuracy, forward as-of and JSON-key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions.windows import asof_forward
from tapewright.operators import intraday as I
from tapewright.operators import levels as L
from tapewright.operators import signals as S
from tapewright.plans.session_queries import IGNITION_CTE
from tapewright.session import table
from tapewright.sources.panels import BARS_SQL, WEEKLY_SQL, daily_bars, intraday_bars, weekly_bars

_B = "PARTITION BY symbol ORDER BY bar_ix"
FIB_SQL = BARS_SQL + f""", f AS (SELECT *, CASE WHEN count(*) OVER w = 120 THEN max(high) OVER w END AS hi, CASE WHEN count(*) OVER w = 120 THEN min(low) OVER w END AS lo, max_by(bar_ix, (high, -bar_ix)) OVER w AS hx, min_by(bar_ix, (low, bar_ix)) OVER w AS lx FROM bars WINDOW w AS ({_B} ROWS 119 PRECEDING))
SELECT symbol, trade_date, lx < hx AS up, round(CASE WHEN lx < hx THEN hi - 0.382 * (hi - lo) ELSE lo + 0.382 * (hi - lo) END, 6) AS fib_382, round(CASE WHEN lx < hx THEN hi - 0.5 * (hi - lo) ELSE lo + 0.5 * (hi - lo) END, 6) AS fib_500, round(CASE WHEN lx < hx THEN hi - 0.618 * (hi - lo) ELSE lo + 0.618 * (hi - lo) END, 6) AS fib_618 FROM f WHERE hi IS NOT NULL"""
DIV_SQL = BARS_SQL + f""", s AS (SELECT *, coalesce(sign(close - lag(close) OVER b), 0) * volume AS st FROM bars WINDOW b AS ({_B})), v AS (SELECT *, sum(st) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS obv FROM s),
d AS (SELECT *, min(close) OVER l AS low2, min(close) OVER e AS low1, min_by(obv, (close, bar_ix)) OVER l AS ol2, min_by(obv, (close, bar_ix)) OVER e AS ol1, max(close) OVER l AS high2, max(close) OVER e AS high1, max_by(obv, (close, bar_ix)) OVER l AS oh2, max_by(obv, (close, bar_ix)) OVER e AS oh1
  FROM v WINDOW l AS ({_B} ROWS 14 PRECEDING), e AS ({_B} ROWS BETWEEN 29 PRECEDING AND 15 PRECEDING))
SELECT symbol, trade_date, CASE WHEN low2 < low1 AND ol2 > ol1 THEN 'bullish' WHEN high2 > high1 AND oh2 < oh1 THEN 'bearish' ELSE 'none' END AS divergence FROM d WHERE bar_ix >= 30"""
REBASED_SQL = WEEKLY_SQL + " SELECT symbol, week, round(100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY week), 6) AS rebased FROM weekly"
ACCURACY_SQL = IGNITION_CTE + """, fw AS (SELECT *, lead(close, 1) OVER b / close - 1 AS fwd_1, lead(close, 3) OVER b / close - 1 AS fwd_3, lead(close, 5) OVER b / close - 1 AS fwd_5 FROM ff WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)),
al AS (SELECT 'bull_absorption' AS kind, 1 AS side, * FROM fw WHERE bull_absorption UNION ALL SELECT 'bear_absorption', -1, * FROM fw WHERE bear_absorption UNION ALL SELECT 'pre_fire', 1, * FROM fw WHERE pre_fire),
st AS (SELECT kind, side, 1 AS horizon, fwd_1 AS r FROM al UNION ALL SELECT kind, side, 3, fwd_3 FROM al UNION ALL SELECT kind, side, 5, fwd_5 FROM al)
SELECT kind, horizon, count(*) FILTER (WHERE r * side > 0.001) AS correct, count(*) FILTER (WHERE r * side < -0.001) AS wrong, count(*) FILTER (WHERE abs(r * side) <= 0.001) AS neutral, count(*) FILTER (WHERE r IS NULL) AS no_data FROM st GROUP BY kind, horizon"""
FORWARD_SQL = BARS_SQL + """, m AS (SELECT DISTINCT symbol, last_day(trade_date) AS month_end FROM bars)
SELECT m.symbol, m.month_end, b.trade_date AS entry_date, round(b.close, 6) AS entry, round(x.close / b.close - 1, 6) AS ret_10 FROM m ASOF LEFT JOIN bars b ON m.symbol = b.symbol AND m.month_end <= b.trade_date LEFT JOIN bars x ON x.symbol = b.symbol AND x.bar_ix = b.bar_ix + 10"""
JSON_SQL = "SELECT s_suppkey, s_name, count(e.event_id) AS events, round(coalesce(sum(value), 0), 4) AS total FROM supplier LEFT JOIN events e ON CAST(json_extract_string(props, '$.k') AS BIGINT) = s_suppkey GROUP BY s_suppkey, s_name"


def q_fib(spark, sf):
    return L.retracements(daily_bars(spark, sf)).filter("hi is not null").select("symbol", "trade_date", "up", *[F.round(c, 6).alias(c) for c in ("fib_382", "fib_500", "fib_618")])


def q_divergence(spark, sf):
    return L.obv_divergence(daily_bars(spark, sf)).select("symbol", "trade_date", "divergence")


def q_rebased(spark, sf):
    return L.rebased(weekly_bars(spark, sf), "week").select("symbol", "week", F.round("rebased", 6).alias("rebased"))


def q_accuracy(spark, sf):
    f = I.ignition_frame(intraday_bars(spark, sf)).withColumns({f"fwd_{h}": S.P.lead("close", h) / F.col("close") - 1 for h in (1, 3, 5)})
    kinds = {"bull_absorption": 1, "bear_absorption": -1, "pre_fire": 1}
    hit = F.array_compact(F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side"))) for k, s in kinds.items()]))
    return L.alert_accuracy(f.withColumn("a", F.explode(hit)).select("a.*", "fwd_1", "fwd_3", "fwd_5"))


def q_forward(spark, sf):
    b = daily_bars(spark, sf)
    b = b.withColumn("ret_10", S.P.lead("close", 10) / F.col("close") - 1)
    ends = b.select("symbol", F.last_day("trade_date").alias("month_end")).distinct()
    bars = b.select("symbol", F.col("trade_date").alias("entry_date"), F.col("close").alias("entry"), "ret_10")
    out = asof_forward(ends, bars, "month_end", "entry_date", ["symbol"], ["entry_date", "entry", "ret_10"])
    return out.select("symbol", "month_end", "entry_date", F.round("entry", 6).alias("entry"), F.round("ret_10", 6).alias("ret_10"))


def q_json(spark, sf):
    e = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("s_suppkey"), "value")
    sums = e.groupBy("s_suppkey").agg(F.count("*").alias("events"), F.sum("value").alias("total"))  # before the join: one row for each key
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name").join(sums, "s_suppkey", "left")
    return s.select("s_suppkey", "s_name", F.coalesce("events", F.lit(0)).alias("events"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


QUERIES = {
    "ind_retracements": (q_fib, FIB_SQL), "ind_obv_divergence": (q_divergence, DIV_SQL), "cs_rebased": (q_rebased, REBASED_SQL), "bt_alert_accuracy": (q_accuracy, ACCURACY_SQL),
    "asof_forward": (q_forward, FORWARD_SQL), "ev_json_key_join": (q_json, JSON_SQL),
}
