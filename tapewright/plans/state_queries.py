"""Queries whose values depend on the value before, as prefix folds, each with recursive SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import decision_states as D
from tapewright.operators import masked as M
from tapewright.operators import models
from tapewright.operators import replay as R
from tapewright.plans.decision_queries import SCORE_CTE, STEALTH_SQL, TECH_SQL
from tapewright.plans.indicator_queries import FRAMES, rounded
from tapewright.plans.study_queries import PIVOT_CTE
from tapewright.sources.panels import BARS_SQL, daily_bars

#: Every gate and the dead band on, so that each rule has rows to act on.
RULES = D.Rules(band=2.0, chase_guard=True, regime_gate=True, widen=1.5)

_TECH = TECH_SQL[len(SCORE_CTE) :].replace(" SELECT symbol, trade_date, round(", "SELECT *, (", 1).replace(", 4)::DOUBLE AS score, round(", ") AS score, (").replace(", 4)::DOUBLE AS coverage FROM g", ") AS coverage FROM g")
INPUTS_CTE = SCORE_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
q0 AS ({_TECH}),
q1 AS (
  SELECT symbol, trade_date, bar_ix, close AS price, score, 100 * coverage AS confidence, cmf20 AS flow, lo20, coalesce(avg(volume) OVER p20, 0) >= 20 AS eligible,
    close < lo20 AS breakdown, close > sma50 AND rsi >= 50 AS confirming, 100 * (close / lag(close, 20) OVER b - 1) AS momentum,
    CASE WHEN close <> lo20 THEN (hi20 - close) / (close - lo20) END < 0.25 AS poor_reward, rsi, obv > obv_20 AS obv_up
  FROM q0 {FRAMES}
),
d0 AS (SELECT trade_date, avg(ret) AS index_ret FROM (SELECT trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_ix) - 1 AS ret FROM bars) WHERE ret IS NOT NULL GROUP BY trade_date),
d1 AS (SELECT trade_date, 100 * exp(sum(ln(1 + index_ret)) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS level, row_number() OVER (ORDER BY trade_date) AS ix FROM d0),
d2 AS (
  SELECT trade_date, level, ix, level AS ema FROM d1 WHERE ix = 1
  UNION ALL SELECT n.trade_date, n.level, n.ix, d2.ema + (n.level - d2.ema) * (2.0 / 51) FROM d2 JOIN d1 n ON n.ix = d2.ix + 1
),
d AS (SELECT trade_date, 100 * (level / ema - 1) AS index_above, 100 * (level / lag(level, 20) OVER (ORDER BY trade_date) - 1) AS index_momentum FROM d2),
q2 AS (SELECT q1.*, index_above, momentum - index_momentum AS strength FROM q1 LEFT JOIN d ON d.trade_date = q1.trade_date),
e AS (
  SELECT symbol, bar_ix, price AS ema50, price AS ema12, price AS ema26, 0.0::DOUBLE AS sig FROM q2 WHERE bar_ix = 1
  UNION ALL
  SELECT symbol, bar_ix, ema50, ema12, ema26, sig + ((ema12 - ema26) - sig) * 0.2 FROM (
    SELECT n.symbol, n.bar_ix, e.ema50 + (n.price - e.ema50) * (2.0 / 51) AS ema50, e.ema12 + (n.price - e.ema12) * (2.0 / 13) AS ema12,
      e.ema26 + (n.price - e.ema26) * (2.0 / 27) AS ema26, e.sig AS sig FROM e JOIN q2 n ON n.symbol = e.symbol AND n.bar_ix = e.bar_ix + 1)
),
inputs AS (
  SELECT q2.*, ema50, ema12 - ema26 - sig AS macd_hist, 100 * (price / ema50 - 1) AS extension,
    CASE WHEN score >= 80 THEN 'Strong Buy' WHEN score >= 70 THEN 'Buy' WHEN score >= 60 THEN 'Watch' WHEN score >= 50 THEN 'Hold' ELSE 'Avoid' END AS band
  FROM q2 JOIN e ON e.symbol = q2.symbol AND e.bar_ix = q2.bar_ix
)"""

#: The rules one after the other, on the last signal itself: ranks from Avoid (0) to Strong Buy (4).
STATES_SQL = INPUTS_CTE + """,
ranked AS (
  SELECT *, CASE WHEN score >= 80 AND coalesce(confirming, false) THEN 4 WHEN score >= 70 THEN 3 WHEN score >= 60 THEN 2 WHEN score >= 50 THEN 1 ELSE 0 END AS r,
    CASE WHEN coalesce(index_above > 0, false) THEN 1 + 0.5 * greatest(0, least(1, index_above / 8)) ELSE 1 END AS wide,
    coalesce(poor_reward, false) OR coalesce(confidence < 45, false) OR coalesce(flow <= 0, false) OR coalesce(strength < -20, false) OR coalesce(index_above <= 0, false) AS gated
  FROM inputs
),
chased AS (SELECT *, coalesce(extension > 10 * wide, false) OR coalesce(momentum > 15 * wide, false) AS chase FROM ranked),
s AS (
  SELECT symbol, bar_ix, CAST('none' AS VARCHAR) AS last_signal, CASE WHEN NOT price > 0 THEN 'No data' WHEN coalesce(breakdown, false) THEN 'Avoid' WHEN NOT eligible THEN 'Avoid'
    ELSE (CASE WHEN gated AND r >= 3 THEN 'Watch' WHEN chase AND r >= 3 THEN 'Watch' ELSE ['Avoid', 'Hold', 'Watch', 'Buy', 'Buy'][r + 1] END) END AS signal
  FROM chased WHERE bar_ix = 1
  UNION ALL
  SELECT symbol, bar_ix, was, CASE WHEN NOT price > 0 THEN 'No data' WHEN coalesce(breakdown, false) THEN CASE WHEN was IN ('Buy', 'Strong Buy', 'Hold') THEN 'Exit' ELSE 'Avoid' END
    WHEN NOT eligible THEN 'Avoid' ELSE ['Avoid', 'Hold', 'Watch', 'Buy', 'Strong Buy'][CASE WHEN gated AND final >= 3 THEN 2 ELSE final END + 1] END
  FROM (SELECT *, CASE WHEN chase AND sure >= 3 THEN sure - 1 ELSE sure END AS final FROM (
    SELECT *, CASE WHEN held = 4 AND was <> 'Strong Buy' THEN 3 ELSE held END AS sure FROM (
      SELECT *, CASE WHEN p IS NULL THEN r WHEN p - r = 1 AND score >= [0, 50, 60, 70, 80][p + 1] THEN p WHEN r - p = 1 AND score < [0, 50, 60, 70, 80][r + 1] + 2 THEN p ELSE r END AS held
      FROM (SELECT n.*, s.signal AS was, CASE s.signal WHEN 'Strong Buy' THEN 4 WHEN 'Buy' THEN 3 WHEN 'Watch' THEN 2 WHEN 'Hold' THEN 1 WHEN 'Avoid' THEN 0 END AS p
        FROM s JOIN chased n ON n.symbol = s.symbol AND n.bar_ix = s.bar_ix + 1))))
)
SELECT s.symbol, i.trade_date, round(i.score, 4)::DOUBLE AS score, s.signal, CASE WHEN s.bar_ix > 1 THEN s.last_signal END AS last_signal,
  coalesce(flow > 0.05 AND score >= 55 AND score < 70 AND NOT coalesce(breakdown, false) AND price > lo20 AND coalesce(strength >= -20, true), false) AS early,
  array_to_string(list_filter([CASE WHEN price > ema50 THEN 'trend' END, CASE WHEN rsi BETWEEN 40 AND 74 AND macd_hist > 0 THEN 'momentum' END, CASE WHEN obv_up THEN 'volume' END,
    CASE WHEN price > lo20 AND NOT coalesce(breakdown, false) THEN 'structure' END], lambda x: x IS NOT NULL), ',') AS agrees
FROM s JOIN inputs i ON i.symbol = s.symbol AND i.bar_ix = s.bar_ix"""


#: One recursion for each symbol: ATR over unlocked bars (n counts them), and the gains and losses of the RSI.
MASKED_CTE = BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
m0 AS (
  SELECT bars.*, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, close - lag(close) OVER b AS diff,
    (SELECT median(volume) FROM bars x WHERE x.symbol = bars.symbol AND x.volume > 0) AS mid FROM bars {FRAMES}
),
m1 AS (SELECT *, high = low AND volume < CASE WHEN mid > 0 THEN 0.1 * mid ELSE 1 END AS locked FROM m0),
m AS (SELECT *, CASE WHEN NOT locked THEN tr END AS own, CASE WHEN NOT locked THEN volume END AS v FROM m1),
r AS (
  SELECT symbol, bar_ix, own AS atr, CASE WHEN own IS NULL THEN 0 ELSE 1 END AS n, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss FROM m WHERE bar_ix = 1
  UNION ALL
  SELECT m.symbol, m.bar_ix, CASE WHEN own IS NULL THEN atr WHEN atr IS NULL THEN own ELSE atr + (own - atr) / 14 END, n + CASE WHEN own IS NULL THEN 0 ELSE 1 END,
    CASE WHEN gain IS NULL THEN greatest(diff, 0) ELSE gain + (greatest(diff, 0) - gain) / 14 END, CASE WHEN loss IS NULL THEN greatest(-diff, 0) ELSE loss + (greatest(-diff, 0) - loss) / 14 END
  FROM r JOIN m ON m.symbol = r.symbol AND m.bar_ix = r.bar_ix + 1
)"""
LOCKED_SQL = MASKED_CTE + """
SELECT m.symbol, m.trade_date, locked AS is_locked, round(CASE WHEN n >= 14 THEN atr END, 6) AS atr_unlocked,
  round(CASE WHEN count(v) OVER w >= 10 THEN avg(v) OVER w END, 6) AS avg_volume_unlocked
FROM m JOIN r ON r.symbol = m.symbol AND r.bar_ix = m.bar_ix WINDOW w AS (PARTITION BY m.symbol ORDER BY m.bar_ix ROWS 19 PRECEDING)"""
RSI_SQL = MASKED_CTE + """
SELECT m.symbol, m.trade_date, round(CASE WHEN loss <> 0 THEN 100 - 100 / (1 + gain / loss) ELSE 50 END, 6) AS rsi_50,
  round(CASE WHEN m.bar_ix > 14 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END, 6) AS rsi_100
FROM m JOIN r ON r.symbol = m.symbol AND r.bar_ix = m.bar_ix"""
#: Each bar against the pivots that it may know, without frames.
TRIANGLE_SQL = PIVOT_CTE + """,
fit AS (
  SELECT b.symbol, b.bar_ix, p.kind, count(*) AS n, avg(p.price) AS mean, regr_slope(p.price, p.bar_ix) AS slope,
    CASE WHEN max(p.price) = min(p.price) THEN 1 ELSE regr_r2(p.price, p.bar_ix) END AS r2
  FROM bars b JOIN pv p ON p.symbol = b.symbol AND p.confirmed_ix <= b.bar_ix AND p.bar_ix >= b.bar_ix - 40 GROUP BY b.symbol, b.bar_ix, p.kind
)
SELECT b.symbol, b.trade_date, round(4000 * h.slope / h.mean, 4) AS high_drift, round(4000 * l.slope / l.mean, 4) AS low_drift, round(h.r2, 4) AS high_r2, round(l.r2, 4) AS low_r2,
  CAST(h.n AS INT) AS highs, CAST(l.n AS INT) AS lows, round(b.close, 6) AS entry, round(b.high * 1.01, 6) AS stop,
  round(CASE WHEN b.high * 1.01 > b.close THEN b.close - 3 * (b.high * 1.01 - b.close) END, 6) AS target
FROM bars b JOIN fit h ON h.symbol = b.symbol AND h.bar_ix = b.bar_ix AND h.kind = 'H' JOIN fit l ON l.symbol = b.symbol AND l.bar_ix = b.bar_ix AND l.kind = 'L'
WHERE b.bar_ix >= 51 AND h.n >= 2 AND l.n >= 2 AND 4000 * h.slope / h.mean <= 0.8 AND 4000 * l.slope / l.mean >= 2 AND h.r2 >= 0.7 AND l.r2 >= 0.7"""

REPLAY_CTE = STEALTH_SQL[: STEALTH_SQL.rindex("SELECT symbol, trade_date, CAST(score")] + """,
g AS (
  SELECT *, CASE WHEN cons AND macd_ok AND score >= 100 THEN 'EXTREME' WHEN cons AND macd_ok AND score >= 60 THEN 'READY' WHEN cons AND macd_ok AND score >= 30 THEN 'WATCH' ELSE 'NO_SIGNAL' END AS sig,
    close / lag(close) OVER b - 1 AS ret, abs(lead(close) OVER b / close - 1) AS jump, lead(open) OVER b AS entry FROM s4 WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix)
),
lim AS (
  SELECT coalesce((SELECT round(0.05 + bin * 0.0025, 4) FROM (
    SELECT least(CAST(floor((ret - 0.05) / 0.0025) AS INT), 23) AS bin, count(*) AS n FROM g WHERE ret > 0.05 AND ret <= 0.11 GROUP BY 1) ORDER BY n DESC, bin LIMIT 1), 0.1) AS circuit
),
h AS (SELECT g.*, circuit, coalesce(ret >= circuit - 0.005 AND ret <= 0.11 AND close >= 0.999 * high, false) AS uc FROM g, lim),
f AS (
  SELECT *, entry > 0 AND coalesce(max(jump) OVER n20 <= 0.11, true) AS ok, coalesce(max(uc::INT) OVER a20 = 1, false) AS uc20, lag(sig) OVER b AS sig_1, lag(uc) OVER b AS uc_1, lag(score) OVER b AS score_1,
    lead(close, 5) OVER b AS c5, lead(close, 10) OVER b AS c10, lead(close, 20) OVER b AS c20
  FROM h WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix), n20 AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), a20 AS (PARTITION BY symbol ORDER BY bar_ix ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)
)"""


def _share_sql(rows: str, name: str, flag: str) -> str:
    """Share of rows with a flag and its interval by dates, Wilson's with one date."""
    return f"""{name}_d AS (SELECT class, trade_date, count(*) AS m, count(*) FILTER (WHERE {flag}) AS k FROM {rows} WHERE ({flag}) IS NOT NULL GROUP BY class, trade_date),
{name}_t AS (SELECT class, sum(m) AS n, sum(k) AS k, sum(k) / sum(m) AS p, count(*) AS g FROM {name}_d GROUP BY class),
{name}_s AS (
  SELECT t.class, any_value(t.n) AS n, any_value(t.p) AS p, any_value(t.g) AS g, sum((d.k - t.p * d.m) ** 2) AS ss FROM {name}_d d JOIN {name}_t t ON t.class = d.class GROUP BY t.class
),
{name}_i AS (
  SELECT class, round(100 * p, 4) AS {name}, p, n, CASE WHEN g > 1 THEN 1.96 * sqrt(ss * g / (g - 1)) / n END AS half,
    1.96 * sqrt(p * (1 - p) / n + 1.96 ** 2 / (4 * n * n)) / (1 + 1.96 ** 2 / n) AS wh, (p + 1.96 ** 2 / (2 * n)) / (1 + 1.96 ** 2 / n) AS wm FROM {name}_s
)"""


_SHARES = [("up_5", "r5 > 0"), ("up_10", "r10 > 0"), ("up_20", "r20 > 0"), ("limit_up", "uc20")]
REPLAY_SQL = REPLAY_CTE + """,
e AS (
  SELECT trade_date, uc20, 100 * (c5 / entry - 1) AS r5, 100 * (c10 / entry - 1) AS r10, 100 * (c20 / entry - 1) AS r20, sig,
    sig <> 'NO_SIGNAL' AND (bar_ix = 31 OR (bar_ix > 31 AND sig_1 = 'NO_SIGNAL')) AS fresh, bar_ix >= 31 AND (bar_ix - 1) % 5 = 0 AS base FROM f WHERE ok
),
o AS (SELECT *, sig AS class FROM e WHERE fresh UNION ALL SELECT *, 'ALL' FROM e WHERE fresh UNION ALL SELECT *, 'BASE' FROM e WHERE base),
t AS (
  SELECT class, count(*) AS n, count(DISTINCT trade_date) AS n_dates, """ + ", ".join(
    f"round(avg(r{h}), 6) AS mean_{h}, round(quantile_cont(r{h}, 0.5), 6) AS median_{h}" for h in R.HORIZONS
) + " FROM o GROUP BY class\n),\n" + ",\n".join(_share_sql("o", n, x) for n, x in _SHARES) + """
SELECT t.*, """ + ", ".join(
    f"{n}, round(100 * coalesce(greatest(0, {n}_i.p - {n}_i.half), {n}_i.wm - {n}_i.wh), 4) AS {n}_low, round(100 * coalesce(least(1, {n}_i.p + {n}_i.half), {n}_i.wm + {n}_i.wh), 4) AS {n}_high" for n, _ in _SHARES
) + " FROM t " + " ".join(f"LEFT JOIN {n}_i ON {n}_i.class = t.class" for n, _ in _SHARES)
LIMIT_SQL = REPLAY_CTE + """,
u AS (SELECT symbol, bar_ix, bar_ix - row_number() OVER (PARTITION BY symbol ORDER BY bar_ix) AS island FROM f WHERE uc),
runs AS (SELECT symbol, min(bar_ix) AS start, count(*) AS locks FROM u GROUP BY symbol, island)
SELECT f.symbol, f.trade_date, round(100 * f.ret, 6) AS ret_pct, runs.locks, q.best > 0 AS caught, CASE q.best WHEN 1 THEN 'WATCH' WHEN 2 THEN 'READY' WHEN 3 THEN 'EXTREME' END AS best_class, CAST(f.score_1 AS INT) AS score_before,
  array_to_string(list_filter([CASE WHEN NOT p.cons THEN 'consolidation' END, CASE WHEN NOT p.macd_ok THEN 'MACD' END, CASE WHEN NOT p.dry_supply THEN 'supply' END, CASE WHEN NOT p.absorption THEN 'absorption' END,
    CASE WHEN NOT p.divergence THEN 'OBV' END], lambda x: x IS NOT NULL), ',') AS missing_before
FROM runs JOIN f ON f.symbol = runs.symbol AND f.bar_ix = runs.start JOIN f p ON p.symbol = f.symbol AND p.bar_ix = f.bar_ix - 1
JOIN LATERAL (SELECT max(CASE x.sig WHEN 'EXTREME' THEN 3 WHEN 'READY' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END) AS best FROM f x WHERE x.symbol = f.symbol AND x.bar_ix BETWEEN f.bar_ix - 20 AND f.bar_ix - 1) q ON true
WHERE f.bar_ix >= 41"""


#: Each bar against the bars after it, without arrays.
BARRIER_SQL = BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
t0 AS (SELECT bars.*, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr FROM bars {FRAMES}),
a AS (
  SELECT symbol, bar_ix, tr AS atr FROM t0 WHERE bar_ix = 1
  UNION ALL SELECT t0.symbol, t0.bar_ix, a.atr + (t0.tr - a.atr) / 14 FROM a JOIN t0 ON t0.symbol = a.symbol AND t0.bar_ix = a.bar_ix + 1
),
t AS (SELECT t0.*, CASE WHEN t0.bar_ix >= 14 THEN atr END AS atr FROM t0 JOIN a ON a.symbol = t0.symbol AND a.bar_ix = t0.bar_ix),
h AS (
  SELECT t.symbol, t.trade_date, t.bar_ix, t.atr, count(n.bar_ix) AS n, min(CASE WHEN n.high >= t.close + 2 * t.atr THEN n.bar_ix END) AS hit, min(CASE WHEN n.low <= t.close - 1.5 * t.atr THEN n.bar_ix END) AS stop
  FROM t LEFT JOIN t n ON n.symbol = t.symbol AND n.bar_ix > t.bar_ix AND n.bar_ix <= t.bar_ix + 15 GROUP BY t.symbol, t.trade_date, t.bar_ix, t.atr
)
SELECT symbol, trade_date, round(atr, 6) AS atr, CAST(CASE WHEN atr IS NULL THEN NULL WHEN stop IS NOT NULL AND (hit IS NULL OR stop <= hit) THEN -1 WHEN hit IS NOT NULL THEN 1 WHEN n = 15 THEN 0 END AS INT) AS label,
  CAST(least(hit, stop) - bar_ix AS INT) AS touch_bar FROM h"""


def q_signal_states(spark, sf):
    f = D.signal_states(D.signal_inputs(daily_bars(spark, sf)), RULES)
    early = D.early_watch(*[F.col(c) for c in ("score", "flow", "breakdown", "price", "lo20", "strength")])
    agrees = D.agreement(*[F.col(c) for c in ("price", "ema50", "rsi_simple_100", "macd_hist", "obv_up", "lo20", "breakdown")])
    return f.select("symbol", "trade_date", F.round("score", 4).alias("score"), "signal", "last_signal", early.alias("early"), F.array_join(agrees, ",").alias("agrees"))


def q_locked(spark, sf):
    f = M.locked_atr(daily_bars(spark, sf))
    return f.select("symbol", "trade_date", "is_locked", *[F.round(c, 6).alias(c) for c in ("atr_unlocked", "avg_volume_unlocked")])


def q_rsi(spark, sf):
    return rounded(M.rsi_variants(daily_bars(spark, sf)), ["rsi_50", "rsi_100"])


def q_triangles(spark, sf):
    f = M.regression_triangles(daily_bars(spark, sf))
    return f.select("symbol", "trade_date", *[F.round(c, 4).alias(c) for c in ("high_drift", "low_drift", "high_r2", "low_r2")], "highs", "lows", *[F.round(c, 6).alias(c) for c in ("entry", "stop", "target")])


def q_replay(spark, sf):
    return R.replay_summary(R.replayed(daily_bars(spark, sf)))


def q_limit_days(spark, sf):
    return R.limit_days(R.replayed(daily_bars(spark, sf)))


def q_barriers(spark, sf):
    return models.atr_barriers(daily_bars(spark, sf)).select("symbol", "trade_date", F.round("atr", 6).alias("atr"), "label", "touch_bar")


def q_model(spark, sf):
    _, report = models.train_time_split(models.barrier_features(daily_bars(spark, sf)), trees=60)
    return report.select("part", "name", "metric", F.round("value", 6).alias("value"))


QUERIES = {
    "st_atr_barriers": (q_barriers, BARRIER_SQL), "st_barrier_model": (q_model, None),
    "dec_signal_states": (q_signal_states, STATES_SQL), "ind_locked_atr": (q_locked, LOCKED_SQL), "ind_rsi_variants": (q_rsi, RSI_SQL),
    "pat_regression_triangle": (q_triangles, TRIANGLE_SQL), "bt_replay": (q_replay, REPLAY_SQL), "bt_limit_days": (q_limit_days, LIMIT_SQL),
}
