"""Intraday, text, evidence, source and streaming queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import evidence as E
from tapewright.operators import intraday as I
from tapewright.operators import text as X
from tapewright.session import table
from tapewright.sources import readers
from tapewright.sources.panels import BARS_SQL, INTRADAY_SQL, daily_bars, intraday_bars
from tapewright.streaming import alerts

CFG = I.IgnitionConfig()
BASE_CTE = INTRADAY_SQL + """, ag AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS age FROM intraday),
tb AS (SELECT symbol, hour, CAST(trunc(quantile_cont(volume, 0.5)) AS BIGINT) AS median_volume, CAST(trunc(avg(volume)) AS BIGINT) AS mean_volume, count(DISTINCT session_date) AS sessions FROM ag WHERE age <= 30 GROUP BY symbol, hour)"""
BASELINE_SQL = BASE_CTE + " SELECT symbol, CAST(hour AS INT) AS hour, median_volume, mean_volume, sessions FROM tb"
RV_CTE = BASE_CTE + """, rv AS (SELECT i.*, sessions, CASE WHEN sessions >= 5 AND median_volume > 0 THEN i.volume / median_volume END AS rvol FROM intraday i LEFT JOIN tb ON tb.symbol = i.symbol AND tb.hour = i.hour),
rc AS (SELECT *, coalesce(CASE WHEN rvol < 0.5 THEN 'THIN' WHEN rvol < 1.5 THEN 'NORMAL' WHEN rvol < 2 THEN 'ELEVATED' WHEN rvol < 3 THEN 'ABNORMAL' WHEN rvol IS NOT NULL THEN 'EXTREME' END, 'UNKNOWN') AS volume_class FROM rv)"""
RV_SQL = RV_CTE + " SELECT symbol, session_date, CAST(hour AS INT) AS hour, round(rvol, 6) AS rvol, volume_class, round(least(1.0, coalesce(sessions, 0) / 30.0), 6) AS rv_confidence FROM rc"
_N, _B = CFG.lookback, "PARTITION BY symbol ORDER BY bar_ix"
IGNITION_CTE = RV_CTE + f""", m0 AS (SELECT *, (high + low + close) / 3 AS tp FROM rc), m1 AS (SELECT *, tp - lag(tp) OVER (PARTITION BY symbol ORDER BY bar_ix) AS dtp FROM m0),
m2 AS (SELECT *, CASE WHEN count(dtp) OVER w = 14 THEN sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END) OVER w END AS pos, CASE WHEN count(dtp) OVER w = 14 THEN sum(CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END) OVER w END AS neg FROM m1 WINDOW w AS ({_B} ROWS 13 PRECEDING)),
m3 AS (SELECT *, CASE WHEN neg = 0 THEN CASE WHEN pos > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + pos / neg) END AS mfi FROM m2),
f0 AS (SELECT *, CASE WHEN lag(open, {_N - 1}) OVER b > 0 THEN abs(close - lag(open, {_N - 1}) OVER b) / lag(open, {_N - 1}) OVER b * 100 END AS move_pct, min(low) OVER p AS support, max(high) OVER p AS resistance,
  greatest(coalesce(mfi - lag(mfi, {_N}) OVER b, 0), coalesce(mfi - lag(mfi, {3 * _N}) OVER b, 0)) AS mfi_gain, lag(mfi, {_N - 1}) OVER b AS mfi_before
  FROM m3 WINDOW b AS ({_B}), p AS ({_B} ROWS BETWEEN {CFG.support_bars} PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT *, coalesce(move_pct <= {CFG.max_move_pct}, false) AS compressed, coalesce(low >= support, false) AS support_holds, coalesce(high <= resistance, false) AS resistance_holds, hour >= {CFG.close_hour} AS near_close,
  coalesce(rvol >= {CFG.min_rvol}, false) AS busy, coalesce(mfi >= 50 OR mfi > mfi_before, false) AS up, coalesce(mfi <= 50 OR mfi < mfi_before, false) AS down FROM f0),
f2 AS (SELECT *, busy AND compressed AND support_holds AND up AS bull_absorption, busy AND compressed AND resistance_holds AND down AS bear_absorption,
  30.0 * busy::INT + 30.0 * compressed::INT + 20.0 * support_holds::INT + 20.0 * up::INT AS absorption_score,
  mfi_gain >= {CFG.mfi_gain} AND compressed AND coalesce(rvol < {CFG.max_rvol}, false) AND support_holds AND NOT near_close AS pre_fire FROM f1),
f3 AS (SELECT *, CASE WHEN pre_fire THEN 17.5 * (least(1.0, mfi_gain / {2 * CFG.mfi_gain}) + greatest(0, least(1, 1 - move_pct / {CFG.max_move_pct})) + greatest(0, least(1, ({CFG.max_rvol} - rvol) / {CFG.max_rvol})) + 0.5) ELSE 0 END AS pre_score,
  max(high) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS high_so_far FROM f2),
f4 AS (SELECT *, last_value(CASE WHEN pre_fire THEN bar_ix END IGNORE NULLS) OVER q AS pre_ix, last_value(CASE WHEN pre_fire THEN high_so_far END IGNORE NULLS) OVER q AS break_level, last_value(CASE WHEN pre_fire THEN mfi END IGNORE NULLS) OVER q AS mfi_then
  FROM f3 WINDOW q AS ({_B} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f5 AS (SELECT *, coalesce(close > break_level, false) AS breakout FROM f4), f6 AS (SELECT *, min(CASE WHEN breakout THEN bar_ix END) OVER (PARTITION BY symbol, pre_ix ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS first_break FROM f5),
f7 AS (SELECT *, coalesce(max(CASE WHEN bar_ix > first_break AND bar_ix <= first_break + {CFG.reject_bars} THEN (close <= break_level)::INT END) OVER (PARTITION BY symbol, pre_ix ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) = 1, false) AS rejected FROM f6),
ff AS (SELECT *, breakout AND busy AND coalesce(mfi >= 50 OR mfi > mfi_then, false) AND NOT rejected AS fire,
  round(round(greatest(0, least(1, mfi_gain / {2 * CFG.mfi_gain})) * 20, 2) + round(compressed::INT * 15.0, 2) + round(absorption_score / 100 * 20, 2) + round(support_holds::INT * 10.0, 2) + round(CASE WHEN rvol IS NOT NULL THEN greatest(0, least(1, rvol / 2)) ELSE 0 END * 10, 2) + round(breakout::INT * 15.0, 2), 2) AS fire_score FROM f7)"""
IGNITION_SQL = IGNITION_CTE + """ SELECT symbol, session_date, CAST(hour AS INT) AS hour, bull_absorption, bear_absorption, absorption_score::DOUBLE AS absorption_score, pre_fire, round(pre_score, 4)::DOUBLE AS pre_score, breakout, rejected, fire, fire_score::DOUBLE AS fire_score,
  CASE WHEN fire_score < 40 THEN 'NO_SETUP' WHEN fire_score < 60 THEN 'WATCH' WHEN fire_score < 75 THEN 'PRE_FIRE' WHEN fire_score < 90 THEN 'STRONG_FIRE' ELSE 'EXTREME_FIRE' END AS rating FROM ff"""
CARRY_SQL = IGNITION_CTE + """, l AS (SELECT symbol, session_date AS setup_date, max(hour) AS setup_hour, max_by(close, hour) AS setup_close FROM ff WHERE hour >= 20 AND compressed AND mfi_gain > 0 GROUP BY symbol, session_date),
s AS (SELECT symbol, session_date, min_by(open, hour) AS open FROM ff GROUP BY symbol, session_date)
SELECT s.symbol, s.session_date, setup_date, CAST(setup_hour AS INT) AS setup_hour, round(100 * (open / setup_close - 1), 4) AS gap_pct FROM s ASOF LEFT JOIN l ON s.symbol = l.symbol AND s.session_date > l.setup_date"""
SESSION_SQL = INTRADAY_SQL + """, g AS (SELECT *, hour - lag(hour) OVER (PARTITION BY symbol, session_date ORDER BY hour) AS gap FROM intraday),
a AS (SELECT symbol, session_date, count(*) AS bars, CAST(max(gap) AS INT) AS max_gap, count(*) FILTER (WHERE volume = 0) AS zero_volume, count(*) FILTER (WHERE low <= 0) AS bad_price FROM g GROUP BY symbol, session_date)
SELECT *, array_to_string(list_filter([CASE WHEN bars < 0.95 * 24 THEN 'missing_bars' END, CASE WHEN max_gap > 3 THEN 'gap' END, CASE WHEN zero_volume > 0 THEN 'zero_volume' END, CASE WHEN bad_price > 0 THEN 'bad_price' END], lambda x: x IS NOT NULL), ',') AS issues,
  CASE WHEN bad_price > 0 THEN 'ANOMALY' WHEN bars < 0.95 * 24 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM a"""

#: Stems, themes and weights of the test corpus, whose prose is invented.
POSITIVE = {"heer": 2.0, "onre": 1.5, "tioned": 1.0, "erat": 0.5}
NEGATIVE = {"thst": 2.0, "erea": 1.5, "idiot": 3.0, "stupid": 3.0}
HIGH = ("tion", "ment")
THEMES = {"energy": ("ther", "heat"), "banking": ("and", "inth"), "transport": ("ouhe", "shre")}
GROUPS = {"sector": {"the": 1, "tion": 2, "ther": 3}, "macro": {"and": 1, "anti": 2}, "noise": {"idiot": -3, "clown": -3}}
SOURCE_BONUS, RELEVANT = {"src1": 2, "src2": 3}, 3
HEAD_CTE = """WITH ls AS (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT * FROM (SELECT doc_id, source, lang, CAST(unnest(range(len(ls))) AS INT) AS line, unnest(ls) AS title FROM ls) WHERE trim(title) <> '')"""
_cnt = lambda words: " + ".join(f"contains(lower(title), '{w}')::INT" for w in words)
_wsum = lambda d: " + ".join(f"CASE WHEN contains(lower(title), '{w}') THEN {v} ELSE 0 END" for w, v in d.items())
_any = lambda words: " OR ".join(f"contains(lower(title), '{w}')" for w in words)
CLASSIFY_SQL = HEAD_CTE + f", s AS (SELECT *, {_cnt(POSITIVE)} AS pos, {_cnt(NEGATIVE)} AS neg FROM h) SELECT doc_id, line, CAST(pos AS INT) AS pos, CAST(neg AS INT) AS neg, CASE WHEN pos > neg THEN 'POSITIVE' WHEN neg > pos THEN 'NEGATIVE' ELSE 'NEUTRAL / REVIEW' END AS direction, CASE WHEN {_any(HIGH)} THEN 'HIGH' ELSE 'MEDIUM' END AS materiality FROM s"
SENTIMENT_SQL = HEAD_CTE + f""", s AS (SELECT source, greatest(-4, least(4, ({_wsum(POSITIVE)}) - ({_wsum(NEGATIVE)}))) AS s FROM h), a AS (SELECT source, count(*) AS n, avg(s) AS avg FROM s GROUP BY source),
r AS (SELECT *, round(greatest(0, least(100, 50 + avg * 11 * least(1.0, n / 4.0))), 4) AS score FROM a) SELECT source, n, score::DOUBLE AS score, CASE WHEN score > 56 THEN 'positive' WHEN score < 44 THEN 'negative' ELSE 'neutral' END AS direction, CASE WHEN n >= 3 AND abs(score - 50) >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM r"""
THEME_SQL = HEAD_CTE + ", t AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{n}' AS theme FROM h WHERE {_any(w)}" for n, w in THEMES.items()) + ") SELECT theme, source, count(*) AS headlines FROM t GROUP BY theme, source"
_grp = ", ".join("greatest(" + ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {w} END" for t, w in terms.items()) + f") AS g_{g}" for g, terms in GROUPS.items())
RELEVANCE_SQL = HEAD_CTE + f""", l AS (SELECT doc_id, line, regexp_replace(lower(title), '[^a-z0-9\\- ]+', ' ', 'g') AS low, CASE source {' '.join(f"WHEN '{s}' THEN {b}" for s, b in SOURCE_BONUS.items())} ELSE 0 END AS bonus FROM h), g AS (SELECT *, {_grp} FROM l),
s AS (SELECT *, CASE WHEN coalesce(g_sector > 0 OR g_macro > 0 OR bonus >= 3, false) THEN coalesce(g_sector, 0) + coalesce(g_macro, 0) + coalesce(g_noise, 0) + bonus ELSE 0 END AS score FROM g)
SELECT doc_id, line, CAST(score AS INT) AS score, score >= {RELEVANT} AS relevant, array_to_string(list_filter([{', '.join(f"CASE WHEN g_{g} IS NOT NULL THEN '{g}:' || g_{g} END" for g in GROUPS)}, CASE WHEN bonus > 0 THEN 'source:+' || bonus END], lambda x: x IS NOT NULL), ';') AS reasons FROM s"""
GROUND_SQL = "SELECT doc_id, item_id FROM documents d JOIN (SELECT DISTINCT item_id, text AS quote FROM benchmark) b ON contains(d.text, b.quote)"

SPANS = "spans AS (SELECT o_orderpriority AS policy, CAST(o_orderstatus AS VARCHAR) AS grp, CAST(min(o_orderdate) AS DATE) + CAST(100 * (count(*) % 7) AS INT) AS valid_from, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE CAST(min(o_orderdate) AS DATE) + CAST(100 * (count(*) % 7) + 500 + 100 * (count(*) % 11) AS INT) END AS valid_to FROM orders GROUP BY o_orderpriority, o_orderstatus)"
TEMPORAL_SQL = f"WITH {SPANS} SELECT o.o_orderkey, s.policy, s.valid_from, s.valid_to FROM orders o JOIN spans s ON s.grp = o.o_orderstatus AND CAST(o.o_orderdate AS DATE) >= s.valid_from AND (s.valid_to IS NULL OR CAST(o.o_orderdate AS DATE) <= s.valid_to)"
OVERLAP_SQL = f"WITH {SPANS} SELECT x.grp, x.policy AS a, y.policy AS b FROM spans x JOIN spans y ON x.grp = y.grp AND x.policy < y.policy AND x.valid_from < coalesce(y.valid_to, DATE '9999-12-31') AND y.valid_from < coalesce(x.valid_to, DATE '9999-12-31')"
OVERLAY_SQL = """WITH c AS (SELECT l_orderkey, max_by(l_extendedprice, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS price, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey, round(coalesce(price, o_totalprice), 4) AS o_totalprice, coalesce(n, 0) AS corrections FROM orders LEFT JOIN c ON l_orderkey = o_orderkey"""
HAVING_SQL = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE NOT (o_totalprice > 1000)) = 0"
SEMI_SQL = """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS never_f FROM customer"""
HEALTH_SQL = "SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending, max(CAST(o_orderdate AS DATE)) AS last_seen FROM orders GROUP BY o_orderpriority"
REVIEW_SQL = """WITH d AS (SELECT doc_id, max_by(CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END, (quality, toxic)) AS decision FROM labels GROUP BY doc_id) SELECT documents.doc_id, coalesce(decision, 'needs_more_evidence') AS decision FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id"""
UPSERT_SQL = "SELECT user_id, event_type, event_id, ts, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
ARRAYS_SQL = BARS_SQL + " SELECT symbol, trade_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"
HTML_SQL = """WITH c AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS cells FROM pages)
SELECT page_id, CAST(unnest(range(len(cells))) AS INT) AS pos, trim(replace(regexp_replace(unnest(cells), '<[^>]*>', '', 'g'), '&amp;', '&')) AS cell FROM c"""
LATEST_SQL = BARS_SQL + ", c AS (SELECT symbol, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date, max_by(close, trade_date) AS last_close FROM bars GROUP BY symbol) SELECT symbol, n, first_date, last_date, round(last_close, 6) AS last_close FROM c"
LASTN_SQL = BARS_SQL + " SELECT symbol, trade_date, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 200"
TUMBLING_SQL = """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, n, round(total, 4) AS total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)"""
MINUTE_SQL = "SELECT event_type, count(DISTINCT date_trunc('minute', ts)) AS minutes FROM events GROUP BY event_type"
SESSION_WINDOW_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid"""

SLIDING_SQL = """WITH s AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
SELECT start, start + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n FROM s WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY start, event_type"""
PACE_SQL = """WITH u AS (SELECT event_type, hour(ts) AS hour, avg(value) AS usual FROM events GROUP BY 1, 2) SELECT event_id, e.event_type, CAST(u.hour AS INT) AS hour, round(value / usual, 6) AS pace FROM events e JOIN u ON u.event_type = e.event_type AND u.hour = hour(e.ts) WHERE value / usual >= 4.0"""
INSERT_SQL = """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) SELECT * FROM e WHERE day >= '2024-01-10' AND (user_id, event_type, day) NOT IN (SELECT user_id, event_type, day FROM e WHERE day < '2024-01-15')"""


def q_baseline(spark, sf):
    return I.time_of_day_baseline(intraday_bars(spark, sf))


def q_relative_volume(spark, sf):
    return I.relative_volume(intraday_bars(spark, sf)).select("symbol", "session_date", "hour", F.round("rvol", 6).alias("rvol"), "volume_class", F.round("rv_confidence", 6).alias("rv_confidence"))


def q_ignition(spark, sf):
    return I.ignition_frame(intraday_bars(spark, sf)).select("symbol", "session_date", "hour", "bull_absorption", "bear_absorption", "absorption_score", "pre_fire", F.round("pre_score", 4).alias("pre_score"), "breakout", "rejected", "fire", "fire_score", "rating")


def q_carried(spark, sf):
    return I.carried_setups(I.ignition_frame(intraday_bars(spark, sf))).select("symbol", "session_date", "setup_date", "setup_hour", F.round("gap_pct", 4).alias("gap_pct"))


def q_sessions(spark, sf):
    return I.session_checks(intraday_bars(spark, sf))


def _heads(spark, sf):
    return X.headlines(table(spark, sf, "documents"))


def q_classify(spark, sf):
    return X.classify(_heads(spark, sf), POSITIVE, NEGATIVE, HIGH).select("doc_id", "line", "pos", "neg", "direction", "materiality")


def q_sentiment(spark, sf):
    return X.score_sources(_heads(spark, sf), POSITIVE, NEGATIVE).drop("avg")


def q_themes(spark, sf):
    return X.themes(_heads(spark, sf), THEMES).groupBy("theme", "source").agg(F.count("*").alias("headlines"))


def q_relevance(spark, sf):
    return X.relevance(_heads(spark, sf), GROUPS, SOURCE_BONUS, RELEVANT)


def q_chunks(spark, sf):
    return X.chunks(table(spark, sf, "documents")).select("doc_id", "chunk", "of", "sha256", F.length("text").alias("chars"))


def q_grounded(spark, sf):
    return X.grounded(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _spans(spark, sf):
    o = table(spark, sf, "orders")
    n = F.count("*")
    first = F.min("o_orderdate").cast("date")
    return o.groupBy(F.col("o_orderpriority").alias("policy"), F.col("o_orderstatus").alias("grp")).agg(
        F.date_add(first, (100 * (n % 7)).cast("int")).alias("valid_from"), F.when(n % 5 != 0, F.date_add(first, (100 * (n % 7) + 500 + 100 * (n % 11)).cast("int"))).alias("valid_to"),
    )


def q_temporal(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_orderstatus").alias("grp"))
    return E.interval_join(o, _spans(spark, sf), "d", "valid_from", "valid_to", ["grp"]).select("o_orderkey", "policy", "valid_from", "valid_to")


def q_overlaps(spark, sf):
    return E.overlaps(_spans(spark, sf), "grp", "policy", "valid_from", "valid_to")


def q_overlay(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    c = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return E.latest_overlay(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), c, "o_orderkey", "at", ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


def q_all_hold(spark, sf):
    return E.all_hold(table(spark, sf, "orders"), "o_custkey", "o_totalprice > 1000")


def q_semi_anti(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    seen = o.groupBy("o_custkey").agg(F.lit(True).alias("has"), F.max(F.col("o_orderstatus") == "F").alias("f"))
    return c.join(seen, c.c_custkey == seen.o_custkey, "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_orders"), (~F.coalesce("f", F.lit(False))).alias("never_f"))


def q_health(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("ok"), F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("pending"), F.max("o_orderdate").cast("date").alias("last_seen"))


def q_review(spark, sf):
    d = table(spark, sf, "labels").groupBy("doc_id").agg(F.max_by(F.when(F.col("quality") == 1, "accepted").otherwise("rejected"), F.struct("quality", "toxic")).alias("decision"))
    return table(spark, sf, "documents").select("doc_id").join(d, "doc_id", "left").select("doc_id", F.coalesce("decision", F.lit("needs_more_evidence")).alias("decision"))


def q_upsert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    at = lambda d: d.withColumn("at", F.struct("ts", "event_id"))
    return E.upsert(at(old), at(new), ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))


def q_arrays(spark, sf):
    b = daily_bars(spark, sf)
    s = b.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("trade_date", "open", "high", "low", "close", "volume"))).alias("r"))
    get = lambda c: F.transform("r", lambda x: x[c])
    p = s.select("symbol", F.to_json(F.struct(F.lit("ok").alias("s"), F.transform("r", lambda x: F.unix_timestamp(x["trade_date"].cast("timestamp"))).alias("t"), *[get(n).alias(k) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])).alias("payload"))
    return readers.parse_arrays(p).select("symbol", "trade_date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


def q_html(spark, sf):
    return readers.html_cells(table(spark, sf, "pages"), "li")


def q_coverage(spark, sf):
    return daily_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.round(F.max_by("close", "trade_date"), 6).alias("last_close"))


def q_last_n(spark, sf):
    from pyspark.sql import Window

    b = daily_bars(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date"))))
    return b.filter("rn <= 200").select("symbol", "trade_date", F.round("close", 6).alias("close"))


def _run_stream(spark: SparkSession, sf: str, build) -> DataFrame:
    """A stream over the events, run to its end in the session's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp()
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return alerts.drain(build(alerts.event_stream(spark, f"{sf}/events.parquet")), f"{root}/out", f"{root}/state")


def q_tumbling(spark, sf):
    return _run_stream(spark, sf, alerts.tumbling).withColumn("total", F.round("total", 4))


def q_minutes(spark, sf):
    return _run_stream(spark, sf, alerts.first_per_minute).groupBy("event_type").agg(F.count("*").alias("minutes"))


def q_accumulator(spark, sf):
    return _run_stream(spark, sf, alerts.accumulator_alerts)


def q_sliding(spark, sf):
    return _run_stream(spark, sf, alerts.sliding)


def q_pace(spark, sf):
    e = table(spark, sf, "events")
    usual = e.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("usual"))
    out = _run_stream(spark, sf, lambda s: alerts.volume_pace(s, usual, threshold=4.0))
    return out.select("event_id", "event_type", F.col("hour").cast("int").alias("hour"), F.round("pace", 6).alias("pace"))


def q_insert_ignore(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    old, new = e.filter("day < '2024-01-15'").distinct(), e.filter("day >= '2024-01-10'")
    return E.insert_ignore(old, new, ["user_id", "event_type", "day"])


def q_session_windows(spark, sf):
    """The batch form of the session window."""
    e = table(spark, sf, "events")
    w = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


QUERIES = {
    "id_time_baseline": (q_baseline, BASELINE_SQL), "id_relative_volume": (q_relative_volume, RV_SQL), "id_ignition": (q_ignition, IGNITION_SQL), "id_carried_setups": (q_carried, CARRY_SQL), "id_session_checks": (q_sessions, SESSION_SQL),
    "txt_headline_direction": (q_classify, CLASSIFY_SQL), "txt_source_sentiment": (q_sentiment, SENTIMENT_SQL), "txt_themes": (q_themes, THEME_SQL), "txt_relevance": (q_relevance, RELEVANCE_SQL), "txt_chunks": (q_chunks, None), "txt_grounding": (q_grounded, GROUND_SQL),
    "ev_temporal_join": (q_temporal, TEMPORAL_SQL), "ev_overlaps": (q_overlaps, OVERLAP_SQL), "ev_latest_overlay": (q_overlay, OVERLAY_SQL), "ev_all_hold": (q_all_hold, HAVING_SQL), "ev_semi_anti": (q_semi_anti, SEMI_SQL), "ev_source_health": (q_health, HEALTH_SQL), "ev_review_queue": (q_review, REVIEW_SQL),
    "src_upsert": (q_upsert, UPSERT_SQL), "src_array_payloads": (q_arrays, ARRAYS_SQL), "src_html_cells": (q_html, HTML_SQL), "src_coverage": (q_coverage, LATEST_SQL), "src_last_n": (q_last_n, LASTN_SQL),
    "str_sliding": (q_sliding, SLIDING_SQL), "str_volume_pace": (q_pace, PACE_SQL), "src_insert_ignore": (q_insert_ignore, INSERT_SQL),
    "str_tumbling": (q_tumbling, TUMBLING_SQL), "str_first_per_minute": (q_minutes, MINUTE_SQL), "str_accumulator_alerts": (q_accumulator, None), "str_session_windows": (q_session_windows, SESSION_WINDOW_SQL),
}
