"""Detector, scoring and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import candles as K
from tapewright.operators import detectors as D
from tapewright.operators import indicators
from tapewright.operators import scoring as G
from tapewright.operators import signals as S
from tapewright.plans.indicator_queries import FRAMES, full, prior
from tapewright.plans.signal_queries import CANDLE_CTES, CANDLES_SQL, RECURSIVE_CTE, hits_sql
from tapewright.sources.panels import BARS_SQL, daily_bars

_B = "PARTITION BY symbol ORDER BY bar_ix"
VOLSIG_SQL = BARS_SQL + f""", v0 AS (SELECT *, coalesce(sign(close - lag(close) OVER b), 0) * volume AS obv_step, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS mfv,
  (high + low + close) / 3 AS tp, 100 * (volume / lag(volume, 14) OVER b - 1) AS vroc, round({full('sum(close * volume)', 20)} / sum(volume) OVER w20, 9) AS vwma FROM bars {FRAMES}),
v1 AS (SELECT *, sum(obv_step) OVER cum AS obv, sum(mfv) OVER cum AS adl, tp - lag(tp) OVER b AS dtp FROM v0 {FRAMES}),
v2 AS (SELECT *, {full('sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END)', 14, 'dtp')} AS pos, {full('sum(CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END)', 14, 'dtp')} AS neg FROM v1 {FRAMES}),
v3 AS (SELECT *, CASE WHEN neg <> 0 THEN 100 - 100 / (1 + pos / neg) END AS mfi FROM v2),
v4 AS (SELECT *, {', '.join(f'lag({x}) OVER b AS {x}_1' for x in ('mfi', 'obv', 'vroc', 'vwma', 'close'))}, lag(obv, 5) OVER b AS obv_5, lag(obv, 6) OVER b AS obv_6, lag(adl, 5) OVER b AS adl_5, lag(close, 5) OVER b AS close_5 FROM v3 {FRAMES})
""" + hits_sql("v4", D.VOLUME_SIGNALS, "symbol, trade_date")
PATTERN_CTE = BARS_SQL + CANDLE_CTES.replace(f"AS drift FROM bars {FRAMES}", f"""AS drift, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr,
  CASE WHEN count(close) OVER p5 = 5 THEN regr_slope(close, bar_ix) OVER p5 / avg(close) OVER p5 END AS slope5, {prior('avg(volume)', 20)} AS vol20, {prior('max(high)', 20)} AS high20, {prior('min(low)', 20)} AS low20,
  lag(close, 1) OVER b / lag(close, 10) OVER b - 1 AS rise10, date_diff('day', lag(trade_date, 2) OVER b, trade_date) AS d2 FROM bars {FRAMES}, p5 AS ({_B} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""") + f", pf AS (SELECT *, {full('avg(tr)', 14)} AS atr14 FROM cf {FRAMES})"
PATTERNS_SQL = PATTERN_CTE + ", hits AS (" + hits_sql("pf", D.PATTERNS, "symbol, trade_date, h, l, c, atr14") + """), lv AS (SELECT *, regexp_matches(signal, 'BEAR|EVENING|STRIKE') AS bear FROM hits), st AS (SELECT *, CASE WHEN bear THEN h + atr14 ELSE l - atr14 END AS stop FROM lv)
SELECT symbol, trade_date, signal, round(stop, 6) AS stop, round(c + CASE WHEN bear THEN -1 ELSE 1 END * abs(c - stop), 6) AS target1, round(c + CASE WHEN bear THEN -2 ELSE 2 END * abs(c - stop), 6) AS target2 FROM st"""
TREND_SQL = BARS_SQL + f""", t0 AS (SELECT *, CAST((close - low) / greatest(0.0001, high - low) >= 0.65 AS INT) AS near, greatest(0, least(high, lag(high) OVER b) - greatest(low, lag(low) OVER b)) / greatest(0.0001, high - low) AS overlap, lag(close, 9) OVER b AS first FROM bars {FRAMES}),
t1 AS (SELECT *, {full('sum(near)', 10)} AS near_n, avg(overlap) OVER w9 AS over_ FROM t0 {FRAMES})
SELECT symbol, trade_date, round(CASE WHEN near_n IS NOT NULL THEN 100 * (0.5 * near_n / 10 + 0.3 * (1 - least(1.0, over_)) + 0.2 * (close > first)::INT) END, 4) AS strength FROM t1"""
CONTRACT_SQL = BARS_SQL + f""", i0 AS (SELECT *, coalesce(high <= lag(high) OVER b AND low >= lag(low) OVER b, false) AS inside, {prior('avg(volume)', 20)} AS vol20 FROM bars {FRAMES}), i1 AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER cum AS island FROM i0 {FRAMES}),
r AS (SELECT symbol, island, count(*) FILTER (WHERE inside) AS n_in, max(bar_ix) AS ix, max(high) AS top, min(low) AS bottom FROM i1 GROUP BY symbol, island),
n AS (SELECT r.symbol, r.island, min(b.bar_ix) AS up FROM r JOIN bars b ON b.symbol = r.symbol AND b.bar_ix > r.ix AND b.bar_ix <= r.ix + 10 AND b.close > r.top GROUP BY r.symbol, r.island)
SELECT r.symbol, e.trade_date, CAST(r.n_in AS BIGINT) AS length, round((e.high - e.low) / e.close, 6) AS tightness, round(e.volume / e.vol20, 6) AS dryness, round(r.top, 6) AS top, round(r.bottom, 6) AS bottom, CAST(n.up - r.ix AS INT) AS breakout_after
FROM r JOIN i1 e ON e.symbol = r.symbol AND e.bar_ix = r.ix LEFT JOIN n ON n.symbol = r.symbol AND n.island = r.island WHERE r.n_in >= 2"""
IMPULSE_SQL = VOLSIG_SQL[: VOLSIG_SQL.index(",\nv4 AS (")] + f""", w0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, {prior('max(obv)', 20)} AS obv_max FROM v3 {FRAMES}),
w1 AS (SELECT *, CASE WHEN count(*) OVER a5 = 5 THEN avg(tr) OVER a5 END AS atr5, {full('avg(tr)', 20)} AS atr20 FROM w0 {FRAMES}, a5 AS ({_B} ROWS 4 PRECEDING)),
d0 AS (SELECT symbol AS s0, bar_ix AS ix0, close AS c0, low AS l0 FROM w1 WHERE mfi >= 60 AND obv > obv_max AND close > open)
SELECT symbol, trade_date, CAST(any_value(bar_ix) - max(ix0) AS INT) AS bars_after, round(max_by(c0, ix0), 6) AS impulse_close FROM w1 JOIN d0 ON symbol = s0 AND bar_ix - ix0 BETWEEN 3 AND 45
WHERE (c0 - close) / c0 BETWEEN 0.005 AND 0.05 AND close > l0 * 0.98 AND atr5 < atr20 GROUP BY symbol, trade_date"""
STEALTH_SQL = RECURSIVE_CTE + f""", k AS (SELECT bars.*, ema12 - ema26 AS macd, sig AS macd_signal, ema12 - ema26 - sig AS hist, atr FROM bars JOIN r ON r.symbol = bars.symbol AND r.bar_ix = bars.bar_ix),
s0 AS (SELECT *, coalesce(sign(close - lag(close) OVER b), 0) * volume AS step, {full('avg(volume)', 20)} AS v20, {full('max(high)', 20)} AS hi20, {full('min(low)', 20)} AS lo20, lag(hist) OVER b AS hist_1 FROM k {FRAMES}),
s1 AS (SELECT *, sum(step) OVER cum AS obv, CAST(volume < 0.7 * v20 AS INT) AS dry, coalesce(volume >= 1.5 * v20 AND abs(close - open) <= 0.5 * atr, false) AS absorb FROM s0 {FRAMES}),
s2 AS (SELECT *, {full('regr_slope(obv, bar_ix)', 20)} AS so, {full('stddev_pop(obv)', 20)} AS do_, {full('regr_slope(close, bar_ix)', 20)} AS sp, {full('stddev_pop(close)', 20)} AS dp, coalesce(sum(dry) OVER w10 >= 5, false) AS exhausted FROM s1 {FRAMES}),
s3 AS (SELECT *, coalesce((hi20 - lo20) / lo20 <= 0.12, false) AS cons, max(exhausted::INT) OVER m5 = 1 AS dry_supply, max(absorb::INT) OVER w10 = 1 AS absorption,
  coalesce(CASE WHEN do_ <> 0 THEN so / do_ END > 0.05 AND CASE WHEN dp <> 0 THEN sp / dp END <= 0.02, false) AS divergence, coalesce(macd > macd_signal OR (hist > 0 AND hist > hist_1), false) AS macd_ok FROM s2 {FRAMES}, m5 AS ({_B} ROWS 4 PRECEDING)),
s4 AS (SELECT *, 30 * dry_supply::INT + 30 * absorption::INT + 40 * divergence::INT AS score FROM s3)
SELECT symbol, trade_date, CAST(score AS INT) AS score, CASE WHEN cons AND macd_ok AND score >= 100 THEN 'EXTREME' WHEN cons AND macd_ok AND score >= 60 THEN 'READY' WHEN cons AND macd_ok AND score >= 30 THEN 'WATCH' ELSE 'NO_SIGNAL' END AS signal_type FROM s4"""
CHANGES_SQL = BARS_SQL + f""", a AS (SELECT *, close > ({full('avg(close)', 20)}) AS above20, ({full('max(high)', 9)}) + ({full('min(low)', 9)}) > ({full('max(high)', 26)}) + ({full('min(low)', 26)}) AS tk FROM bars {FRAMES}), l AS (SELECT *, lag(above20) OVER b AS a1, lag(tk) OVER b AS t1 FROM a {FRAMES})
SELECT symbol, trade_date, 'above20' AS state, above20 AS now FROM l WHERE above20 <> a1 UNION ALL SELECT symbol, trade_date, 'tk', tk FROM l WHERE tk <> t1"""
EDGE_SQL = BARS_SQL + f""", e0 AS (SELECT *, volume / ({prior('avg(volume)', 20)}) AS rvol, {prior('max(high)', 20)} AS hi20, lead(close, 1) OVER b AS n1, lead(close, 2) OVER b AS n2, lead(close, 3) OVER b AS n3 FROM bars {FRAMES}), e1 AS (SELECT *, {prior('quantile_cont(rvol, 0.9)', 60, 'rvol')} AS p90 FROM e0 {FRAMES})
SELECT symbol, trade_date, round(rvol, 6) AS rvol FROM e1 WHERE rvol > p90 + 1e-9 AND close > hi20 AND n1 > hi20 AND n2 > hi20 AND n3 > hi20"""
CLIFF_SQL = BARS_SQL + """, c AS (SELECT *, coalesce(close <= 0.97 * lag(close) OVER b AND volume > 1.5 * avg(volume) OVER p, false) AS cliff FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix), p AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN cliff THEN bar_ix END) OVER (PARTITION BY symbol) AS last FROM c) SELECT symbol, count(*) AS n_bars, min(trade_date) AS from_date FROM l WHERE last IS NULL OR bar_ix >= last GROUP BY symbol"""
SCORE_CTE = BARS_SQL + f""", g0 AS (SELECT *, close - lag(close) OVER b AS diff, coalesce(sign(close - lag(close) OVER b), 0) * volume AS obv_step, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS mfv,
  {full('avg(close)', 20)} AS sma20, {full('avg(close)', 50)} AS sma50, {full('avg(close)', 200)} AS sma200, {full('stddev_samp(close)', 20)} AS sd, close / lag(close, 10) OVER b - 1 AS roc10, {prior('max(high)', 20)} AS hi20, {prior('min(low)', 20)} AS lo20 FROM bars {FRAMES}),
g1 AS (SELECT *, {full('avg(greatest(diff, 0))', 14, 'diff')} AS gain, {full('avg(greatest(-diff, 0))', 14, 'diff')} AS loss, sum(obv_step) OVER cum AS obv, {full('sum(mfv)', 20)} / sum(volume) OVER w20 AS cmf20, CASE WHEN sd <> 0 THEN (close - sma20 + 2 * sd) / (4 * sd) END AS pct_b, 4 * sd / sma20 AS bandwidth FROM g0 {FRAMES}),
g AS (SELECT *, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi, lag(obv, 20) OVER b AS obv_20 FROM g1 {FRAMES})"""
_ramp = lambda x, a, b: f"greatest(0, least(1, ({x} - ({a})) / ({b} - ({a}))))"
_nn = lambda x, e: f"CASE WHEN {x} IS NOT NULL THEN {e} END"
_TECH = [(_nn("sma200", "(close > sma200)::INT"), 15), (_nn("rsi", _ramp("rsi", 30, 70)), 20), (_nn("roc10", _ramp("roc10", -0.05, 0.05)), 15), (_nn("pct_b", _ramp("pct_b", 0, 1)), 10), (_nn("cmf20", _ramp("cmf20", -0.2, 0.2)), 15), (_nn("obv_20", "(obv > obv_20)::INT"), 10), (_nn("hi20", "(close > hi20)::INT"), 15)]
TECH_SQL = SCORE_CTE + " SELECT symbol, trade_date, round(" + " + ".join(f"coalesce(({p}) * {w}, 0)" for p, w in _TECH) + ", 4)::DOUBLE AS score, round((" + " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN {w} ELSE 0 END" for p, w in _TECH) + ") / 100.0, 4)::DOUBLE AS coverage FROM g"
_sign = lambda u, d: f"CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END"
_COMP = {
    "trend": (_sign("close > sma50", "close < sma50"), "abs(close / sma50 - 1) / 0.05"), "momentum": (_sign("rsi > 55", "rsi < 45"), "abs(rsi - 50) / 30"), "volume": (_sign("cmf20 > 0.05", "cmf20 < -0.05"), "abs(cmf20) / 0.3"),
    "volatility": (_sign("bandwidth < 0.05", "bandwidth > 0.2"), "0.5"), "location": (_sign("pct_b < 0.2", "pct_b > 0.8"), "0.7"), "breakout": (_sign("close > hi20", "close < lo20"), "1.0"),
}
EVID_CTE = SCORE_CTE + ", h0 AS (SELECT *, " + ", ".join(f"{s} AS s_{n}, coalesce(({s}) * greatest(0, least(1, {x})) * {G.WEIGHTS[n]}, 0) AS p_{n}" for n, (s, x) in _COMP.items()) + ", CASE WHEN close <> lo20 THEN (hi20 - close) / (close - lo20) END AS rr FROM g), h1 AS (SELECT *, greatest(0, least(100, 50.0 + " + " + ".join(f"p_{n}" for n in _COMP) + ")) AS score, " + " + ".join(f"(s_{n} > 0)::INT" for n in _COMP) + " AS n_bull, " + " + ".join(f"(s_{n} < 0)::INT" for n in _COMP) + """ AS n_bear FROM h0),
h2 AS (SELECT *, CASE WHEN score >= 78 AND greatest(n_bull, n_bear) >= 4 THEN 'A' WHEN score >= 65 AND greatest(n_bull, n_bear) >= 3 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN n_bull > n_bear AND score >= 65 THEN 'BUY' WHEN n_bull > n_bear AND score >= 50 THEN 'WATCH FOR BUY' WHEN n_bear > n_bull AND score <= 35 THEN 'SELL / REDUCE' WHEN n_bear > n_bull AND score <= 45 THEN 'WATCH FOR SELL' ELSE 'NEUTRAL' END AS act FROM h1),
h AS (SELECT *, CASE WHEN act = 'BUY' AND rr < 1.5 THEN 'WATCH FOR BUY' ELSE act END AS action FROM h2)"""
EVID_SQL = EVID_CTE + " SELECT symbol, trade_date, round(score, 4)::DOUBLE AS score, CAST(n_bull AS INT) AS n_bull, CAST(n_bear AS INT) AS n_bear, grade, action FROM h"
DIFF_SQL = EVID_CTE + f""", d AS (SELECT *, lag(score) OVER b AS s1, lag(action) OVER b AS a1, lag(grade) OVER b AS g1x FROM h WINDOW b AS ({_B})), e AS (SELECT symbol, trade_date, array_to_string(list_filter([CASE WHEN abs(score - s1) >= 8 THEN 'score' END, CASE WHEN action <> a1 THEN 'action' END, CASE WHEN grade <> g1x THEN 'grade' END], lambda x: x IS NOT NULL), ',') AS changed FROM d WHERE a1 IS NOT NULL)
SELECT * FROM e WHERE changed <> ''"""
OUTCOME_SQL = EVID_CTE + """, o AS (SELECT a.symbol, a.trade_date, a.bar_ix, count(n.bar_ix) AS m, min(CASE WHEN n.high >= a.close * 1.03 THEN n.bar_ix END) AS up, min(CASE WHEN n.low <= a.close * (1 - 0.02) THEN n.bar_ix END) AS dn FROM h a LEFT JOIN bars n ON n.symbol = a.symbol AND n.bar_ix BETWEEN a.bar_ix + 1 AND a.bar_ix + 20 WHERE a.action = 'BUY' GROUP BY a.symbol, a.trade_date, a.bar_ix)
SELECT symbol, trade_date, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up <= dn) THEN 'win' WHEN dn IS NOT NULL THEN 'loss' WHEN m < 20 THEN 'pending' ELSE 'flat' END AS outcome FROM o"""
_CONV = [(_nn("volume", _ramp("log10(greatest(volume, 1))", 0, 3)), 20), (_nn("roc10", _ramp("roc10", -0.05, 0.05)), 20), (_nn("sma50", _ramp("close / sma50", 0.95, 1.05)), 30), (_nn("pct_b", _ramp("pct_b", 0, 1)), 30)]
CONVICTION_SQL = SCORE_CTE + " SELECT symbol, trade_date, round(" + " + ".join(f"coalesce(({p}) * {w}, 0)" for p, w in _CONV) + ", 4)::DOUBLE AS conviction, round((" + " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN {w} ELSE 0 END" for p, w in _CONV) + ") / 100.0, 4)::DOUBLE AS conviction_coverage FROM g"
HITS_SQL = CANDLES_SQL.replace("SELECT symbol, trade_date, signal, CASE", ", hb AS (SELECT symbol, trade_date, signal, CASE", 1) + ")"
CONFLUENCE_SQL = HITS_SQL + " SELECT symbol, trade_date, count(*) FILTER (WHERE bias = 'bullish') AS agree, count(*) FILTER (WHERE bias = 'bearish') AS disagree, string_agg(signal, ',' ORDER BY signal) AS signals, count(*) FILTER (WHERE bias = 'bullish') - count(*) FILTER (WHERE bias = 'bearish') AS net FROM hb GROUP BY symbol, trade_date"
REPORT_SQL = HITS_SQL + " SELECT symbol, bias, count(*) AS n, max(trade_date) AS last FROM hb GROUP BY ROLLUP (symbol, bias)"
BOARD_SQL = HITS_SQL + " SELECT symbol, count(*) FILTER (WHERE bias = 'bullish') AS bullish, count(*) FILTER (WHERE bias = 'bearish') AS bearish, count(*) FILTER (WHERE bias = 'neutral') AS neutral FROM hb GROUP BY symbol"
STRATEGY_SQL = BARS_SQL + f""", p AS (SELECT *, CASE WHEN close > ({full('avg(close)', 20)}) THEN 1.0 ELSE 0.0 END AS w FROM bars {FRAMES}), q AS (SELECT *, lag(w) OVER b * (close / lag(close) OVER b - 1) AS r FROM p {FRAMES}), e AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING) AS eq FROM q WHERE r IS NOT NULL),
d AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY symbol ORDER BY bar_ix ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT symbol, round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round(avg(r) / stddev_samp(r) * sqrt(252), 4) AS sharpe, round(sum(r) FILTER (WHERE r > 0) / -sum(r) FILTER (WHERE r < 0), 4) AS profit_factor, round(max(1 - exp(eq - peak)), 6) AS max_drawdown FROM d GROUP BY symbol"""


def q_volume_signals(spark, sf):
    return S.long_form(D.volume_signal_frame(daily_bars(spark, sf)), D.VOLUME_SIGNALS, ["symbol", "trade_date"])


def q_patterns(spark, sf):
    hits = S.long_form(D.pattern_frame(daily_bars(spark, sf)), D.PATTERNS, ["symbol", "trade_date", "h", "l", "c", "atr14"])
    return D.trade_levels(hits).select("symbol", "trade_date", "signal", *[F.round(c, 6).alias(c) for c in ("stop", "target1", "target2")])


def q_trend_strength(spark, sf):
    return D.trend_strength(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("strength", 4).alias("strength"))


def q_contractions(spark, sf):
    c = D.contractions(daily_bars(spark, sf))
    return c.select("symbol", "trade_date", "length", *[F.round(x, 6).alias(x) for x in ("tightness", "dryness", "top", "bottom")], F.col("breakout_after").cast("int").alias("breakout_after"))


def q_impulses(spark, sf):
    return D.impulse_pullbacks(daily_bars(spark, sf)).select("symbol", "trade_date", (F.col("bar_ix") - F.col("ix0")).cast("int").alias("bars_after"), F.round("c0", 6).alias("impulse_close"))


def q_stealth(spark, sf):
    return D.stealth_accumulation(daily_bars(spark, sf)).select("symbol", "trade_date", "score", "signal_type")


def q_stages(spark, sf):
    return D.stages(daily_bars(spark, sf))


def q_changes(spark, sf):
    return D.state_changes(daily_bars(spark, sf))


def q_edges(spark, sf):
    return D.edges(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("rvol", 6).alias("rvol"))


def q_cliffs(spark, sf):
    return D.cliffs(daily_bars(spark, sf)).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.min("trade_date").alias("from_date"))


def q_technical(spark, sf):
    return G.technical_score(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("score", 4).alias("score"), F.round("coverage", 4).alias("coverage"))


def q_evidence(spark, sf):
    return G.evidence(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("score", 4).alias("score"), "n_bull", "n_bear", "grade", "action")


def q_changes_of_decision(spark, sf):
    return G.decision_changes(G.evidence(daily_bars(spark, sf))).select("symbol", "trade_date", "changed")


def q_outcomes(spark, sf):
    return G.grade_outcomes(G.evidence(daily_bars(spark, sf))).select("symbol", "trade_date", "outcome")


def q_conviction(spark, sf):
    return G.conviction(indicators.trend(daily_bars(spark, sf))).select("symbol", "trade_date", F.round("conviction", 4).alias("conviction"), F.round("conviction_coverage", 4).alias("conviction_coverage"))


def _hits(spark, sf):
    return S.long_form(K.candle_frame(daily_bars(spark, sf)), K.CANDLES, ["symbol", "trade_date"]).withColumn("bias", K.bias(F.col("signal")))


def q_confluence(spark, sf):
    return G.confluence(_hits(spark, sf), F.col("bias") == "bullish", F.col("bias") == "bearish")


def q_report(spark, sf):
    return G.event_report(_hits(spark, sf))


def q_board(spark, sf):
    return G.leaderboard(_hits(spark, sf), ["bullish", "bearish", "neutral"])


def q_strategy(spark, sf):
    return G.own_return_strategy(daily_bars(spark, sf))


def q_admission(spark, sf):
    from tapewright.operators.cross_section import quotes
    from tapewright.sources.panels import weekly_bars

    q = quotes(weekly_bars(spark, sf), "week").select(F.lit("main").alias("book"), "symbol", "sector", F.round("score", 6).alias("score"), F.col("close").alias("price"), F.col("low").alias("stop"))
    return G.admit(q, "book")


QUERIES = {
    "pat_volume_signals": (q_volume_signals, VOLSIG_SQL), "pat_engulfing_star": (q_patterns, PATTERNS_SQL), "pat_trend_strength": (q_trend_strength, TREND_SQL), "pat_contractions": (q_contractions, CONTRACT_SQL), "pat_impulse_pullback": (q_impulses, IMPULSE_SQL),
    "pat_stealth_accumulation": (q_stealth, STEALTH_SQL), "pat_volatility_stages": (q_stages, None), "pat_state_changes": (q_changes, CHANGES_SQL), "pat_volume_edges": (q_edges, EDGE_SQL), "pat_cliffs": (q_cliffs, CLIFF_SQL),
    "dec_technical_score": (q_technical, TECH_SQL), "dec_evidence": (q_evidence, EVID_SQL), "dec_changes": (q_changes_of_decision, DIFF_SQL), "dec_outcomes": (q_outcomes, OUTCOME_SQL), "dec_conviction": (q_conviction, CONVICTION_SQL),
    "dec_confluence": (q_confluence, CONFLUENCE_SQL), "dec_event_report": (q_report, REPORT_SQL), "dec_leaderboard": (q_board, BOARD_SQL), "bt_strategy": (q_strategy, STRATEGY_SQL), "dec_admission": (q_admission, None),
}
