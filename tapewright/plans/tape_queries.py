"""The session tape over the events, as streams run to their end, each with SQL over the stored events that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.plans.session_queries import _run_stream
from tapewright.session import table
from tapewright.streaming import tape as T

#: The test events fall on the whole day: sessions of a day, with a break on Fridays; limits to the events' sizes.
SESSIONS = {d: ((0, 1440),) for d in range(4)} | {4: ((0, 720), (840, 1440))}
LIMITS = T.Limits(extreme=2.0, surge=1.4, watch=1.2, block=7_000.0, large=5_500.0, least_turnover=10_000.0)

TAPE_CTE = """WITH e AS (
  SELECT event_type AS symbol, ts, event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "at" FROM events
),
u AS (SELECT symbol, sum(k) / count(DISTINCT CAST(ts AS DATE)) AS usual FROM e GROUP BY symbol),
p AS (
  SELECT symbol, "at", CAST("at" - INTERVAL 1 SECOND AS DATE) AS session, sum(k) AS size, sum(value * k) AS paid, count(*) AS n, min_by(value, (ts, event_id)) AS first, max_by(value, (ts, event_id)) AS last,
    max(value) AS top, min(value) AS bottom FROM e GROUP BY symbol, "at"
),
g AS (
  SELECT p.*, usual, (epoch("at") - epoch(CAST(session AS TIMESTAMP))) / 60 AS minute, isodow(session) AS dow, sum(size) OVER w AS volume, sum(paid) OVER w AS turnover, sum(n) OVER w AS trades,
    first_value(first) OVER w AS open, max(top) OVER w AS high, min(bottom) OVER w AS low, lag(session) OVER s AS session_1, lag(last) OVER s AS last_1
  FROM p JOIN u ON u.symbol = p.symbol
  WINDOW w AS (PARTITION BY p.symbol, session ORDER BY "at" ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY p.symbol ORDER BY "at")
),
c AS (
  SELECT *, first_value(CASE WHEN session_1 <> session THEN last_1 END) OVER w AS prior_close, CASE WHEN high > low THEN (last - low) / (high - low) ELSE 0.5 END AS place,
    sum(CASE WHEN high > low AND size > 0 THEN ((last - low) - (high - last)) / (high - low) * size ELSE 0 END) OVER w AS flow,
    CASE WHEN dow > 5 THEN 1.0 WHEN dow < 5 THEN least(1.0, minute / 1440) ELSE (least(minute, 720) + greatest(0, minute - 840)) / 1320 END AS progress
  FROM g WINDOW w AS (PARTITION BY symbol, session ORDER BY "at" ROWS UNBOUNDED PRECEDING)
),
r AS (SELECT *, CASE WHEN progress > 0.05 THEN volume / (usual * progress) END AS ratio, (prior_close - last) / prior_close AS fall FROM c),
h AS (
  SELECT *, ratio >= 2 AS a1, ratio >= 1.4 AND ratio < 2 AS a2, ratio >= 1.2 AND place >= 0.85 AS a3, ratio >= 1.2 AND place <= 0.15 AS a4,
    fall > 0.005 AND flow > 0.01 * usual AS a5, fall < -0.005 AND flow < -0.01 * usual AS a6 FROM r
),
f AS (
  SELECT *, """ + ", ".join(
    f"coalesce(a{i}, false) AND sum(coalesce(a{i}, false)::INT) OVER (PARTITION BY symbol, session ORDER BY \"at\" ROWS UNBOUNDED PRECEDING) = 1 AS f{i}" for i in range(1, 7)
) + """ FROM h
),
t AS (SELECT * FROM f WHERE "at" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e))"""
TAPE_SQL = TAPE_CTE + """
SELECT symbol, session, "at", volume, round(turnover, 4) AS turnover, CAST(trades AS BIGINT) AS trades, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(last, 6) AS last, round(prior_close, 6) AS prior_close,
  round(ratio, 6) AS volume_ratio, round(place, 6) AS range_position, round(flow, 4) AS flow,
  array_to_string(list_filter([""" + ", ".join(f"CASE WHEN f{i} THEN '{a}' END" for i, a in enumerate(T.ALERTS, 1)) + """], lambda x: x IS NOT NULL), ',') AS alerts FROM t"""
KINDS_SQL = TAPE_CTE + """,
k0 AS (
  SELECT *, coalesce(100 * (last - prior_close) / prior_close, 0) AS change, turnover / trades AS each, CASE WHEN progress > 0.03 THEN volume / progress ELSE volume END / usual AS pace
  FROM t WHERE turnover >= 10000 AND trades >= 3
),
k1 AS (
  SELECT *, CASE WHEN pace >= 3 THEN 3 WHEN pace >= 1.8 THEN 1.5 ELSE 0 END + CASE WHEN each > 7000 THEN 3 WHEN each > 5500 THEN 1.5 ELSE 0 END AS i,
    CASE WHEN place > 0.7 AND change > 0 THEN 1.5 ELSE 0 END + CASE WHEN change > 2 THEN 1 ELSE 0 END AS bull, CASE WHEN place < 0.3 AND change < 0 THEN 1.5 ELSE 0 END + CASE WHEN change < -2 THEN 1 ELSE 0 END AS bear
  FROM k0
),
k2 AS (
  SELECT *, CASE WHEN i >= 4.5 AND bull > bear THEN 'ACCUMULATION' WHEN i >= 4.5 AND bear > bull THEN 'DISTRIBUTION' WHEN i >= 3 AND bear > bull THEN 'SELLING PRESSURE' WHEN each > 7000 THEN 'BLOCK TRADES'
    WHEN pace >= 3 THEN 'VOLUME SURGE' WHEN bull > 0 AND change > 0 THEN 'QUIET STRENGTH' ELSE 'UNUSUAL ACTIVITY' END AS kind
  FROM k1 WHERE i > 0 OR (place > 0.7 AND change > 0) OR (place < 0.3 AND change < 0)
)
SELECT symbol, "at", kind, CAST(CASE WHEN kind IN ('DISTRIBUTION', 'SELLING PRESSURE') THEN -(i + bear - bull) ELSE i + bull - bear END AS DOUBLE) AS score, round(pace, 4) AS pace, round(each, 4) AS average_trade FROM k2"""
QUOTES_SQL = TAPE_CTE + """,
d0 AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v
  FROM events GROUP BY event_type, CAST(ts AS DATE)
),
d1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back, coalesce(sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY day)), 0) * v AS step FROM d0),
d AS (
  SELECT symbol, sum(CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * v ELSE 0 END) / sum(v) AS cmf, sum(step) > 0 AS obv_up FROM d1 WHERE back <= 20 GROUP BY symbol
),
q AS (
  SELECT t.*, cmf, obv_up, round(volume / (greatest(0.05, least(1, progress)) * usual), 2) AS times_usual, coalesce(100 * (last - prior_close) / prior_close, 0) AS pct FROM t JOIN d ON d.symbol = t.symbol
),
z AS (SELECT *, array_to_string(list_filter([CASE WHEN times_usual >= 2 THEN 'VOLUME_SURGE' END, CASE WHEN cmf > 0.01 AND obv_up AND pct > 0 THEN 'ACCUMULATION' END,
  CASE WHEN cmf < -0.01 AND NOT obv_up AND pct < 0 THEN 'DISTRIBUTION' END], lambda x: x IS NOT NULL), ',') AS found FROM q)
SELECT symbol, "at", times_usual, round(pct, 4) AS pct, round(cmf, 6) AS cmf, found FROM z WHERE found <> ''"""


def usual_volume(spark, sf):
    """Mean size of a session by symbol: a row a symbol."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return e.groupBy("symbol").agg((F.sum("k") / F.count_distinct("day")).alias("usual_volume"))


def daily_flow(spark, sf):
    """Money flow and OBV over the last 20 days by symbol: a row a symbol."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    d = e.groupBy("symbol", "day").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum("k").alias("v"))
    w = Window.partitionBy("symbol").orderBy("day")
    d = d.withColumns({"step": F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("v"), "back": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))})
    money = F.when(F.col("high") > F.col("low"), (2 * F.col("close") - F.col("high") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("v")).otherwise(0.0)
    return d.filter("back <= 20").groupBy("symbol").agg(F.try_divide(F.sum(money), F.sum("v")).alias("cmf"), (F.sum("step") > 0).alias("obv_up"))


def _tape(spark, sf, then=lambda t: t):
    usual = usual_volume(spark, sf)
    with T.keyed_state(spark):
        return _run_stream(spark, sf, lambda s: then(T.tape_stream(T.tape_events(s, usual), limits=LIMITS, sessions=SESSIONS)))


def q_tape(spark, sf):
    digits = {"turnover": 4, "flow": 4} | {c: 6 for c in ("open", "high", "low", "last", "prior_close", "volume_ratio", "range_position")}
    return _tape(spark, sf).withColumns({c: F.round(c, n) for c, n in digits.items()}).drop("usual_volume", "progress")


def q_kinds(spark, sf):
    out = _tape(spark, sf, lambda t: T.tape_kinds(t, LIMITS))
    return out.select("symbol", "at", "kind", "score", F.round("pace", 4).alias("pace"), F.round("average_trade", 4).alias("average_trade"))


def q_quotes(spark, sf):
    flow = daily_flow(spark, sf)
    out = _tape(spark, sf, lambda t: T.quote_alerts(t, flow, least_flow=0.01))
    return out.select("symbol", "at", "times_usual", F.round("pct", 4).alias("pct"), F.round("cmf", 6).alias("cmf"), "found")


QUERIES = {"str_tape": (q_tape, TAPE_SQL), "str_tape_kinds": (q_kinds, KINDS_SQL), "str_quote_alerts": (q_quotes, QUOTES_SQL)}
