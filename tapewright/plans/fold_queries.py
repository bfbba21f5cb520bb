"""Volume lines, and recursive SQL for queries that fold rows one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import detectors as D
from tapewright.operators import signals as S
from tapewright.operators import volume_lines as V
from tapewright.plans import advice_queries, decision_queries
from tapewright.plans.cross_queries import QUOTES_CTE
from tapewright.plans.indicator_queries import FRAMES, full, prior
from tapewright.plans.signal_queries import hits_sql
from tapewright.sources.panels import BARS_SQL, daily_bars

_RECURSIVE = BARS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
LINES_SQL = _RECURSIVE + f""",
l0 AS (SELECT *, 100 * (close / lag(close) OVER b - 1) * volume AS step, (close - lag(close) OVER b) * volume AS raw FROM bars {FRAMES}),
l1 AS (SELECT *, sum(step) OVER cum AS pvt FROM l0 {FRAMES}),
r AS (
  SELECT symbol, bar_ix, pvt AS pvt_mean, raw AS force, volume AS fast, volume AS slow, 0.0::DOUBLE AS klinger_mean FROM l1 WHERE bar_ix = 1
  UNION ALL
  SELECT symbol, bar_ix, pvt_mean, force, fast, slow, klinger_mean + ((fast - slow) - klinger_mean) / 7 FROM (
    SELECT n.symbol, n.bar_ix, CASE WHEN r.pvt_mean IS NULL THEN n.pvt ELSE r.pvt_mean + (n.pvt - r.pvt_mean) * (2.0 / 21) END AS pvt_mean,
      CASE WHEN r.force IS NULL THEN n.raw ELSE r.force + (n.raw - r.force) / 7 END AS force, r.fast + (n.volume - r.fast) * (2.0 / 35) AS fast,
      r.slow + (n.volume - r.slow) * (2.0 / 56) AS slow, r.klinger_mean FROM r JOIN l1 n ON n.symbol = r.symbol AND n.bar_ix = r.bar_ix + 1)
),
l2 AS (SELECT l1.symbol, l1.trade_date, l1.bar_ix, l1.pvt, r.pvt_mean, r.force, fast - slow AS klinger, r.klinger_mean FROM l1 JOIN r ON r.symbol = l1.symbol AND r.bar_ix = l1.bar_ix),
l3 AS (SELECT *, """ + ", ".join(f"lag({c}) OVER b AS {c}_1" for c in V.LINES) + " FROM l2 WINDOW b AS (PARTITION BY symbol ORDER BY bar_ix))\n" + hits_sql("l3", V.VOLUME_LINE_SIGNALS, "symbol, trade_date")

#: One bar after the other: state, the level that is tried, and how long the state lasts.
STAGES_SQL = _RECURSIVE + f""",
g0 AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, {full('stddev_samp(close)', 20)} AS sd, {full('stddev_pop(close)', 20)} AS sdp, {full('avg(close)', 20)} AS sma20,
    {prior('max(high)', 20)} AS hi20, volume / ({prior('avg(volume)', 20)}) AS rvol FROM bars {FRAMES}
),
g AS (SELECT *, coalesce(4 * sd / sma20 < 0.06, false) AS tight, coalesce(2 * sdp < 1.5 * ({full('avg(tr)', 20)}), false) AS squeezed FROM g0 {FRAMES}),
st AS (
  SELECT symbol, 0::BIGINT AS bar_ix, 0 AS state, 0.0::DOUBLE AS level, 0 AS age FROM g WHERE bar_ix = 1
  UNION ALL
  SELECT symbol, bar_ix, new, CASE WHEN new = 3 AND state <> 3 THEN hi20 ELSE level END, CASE WHEN new <> state THEN 0 ELSE older END FROM (
    SELECT *, CASE WHEN state IN (1, 2) AND coalesce(close > hi20, false) AND coalesce(rvol, 0) >= 1.2 THEN 3 WHEN state = 3 AND close < level THEN 5 WHEN state = 3 AND older >= 3 THEN 4
      WHEN state IN (4, 5) AND older >= 10 THEN 0 WHEN state IN (0, 1, 2) THEN CASE WHEN squeezed AND tight THEN 2 WHEN tight THEN 1 ELSE 0 END ELSE state END AS new
    FROM (SELECT n.symbol, n.bar_ix, n.close, n.hi20, n.rvol, n.tight, n.squeezed, s.state, s.level, s.age + 1 AS older FROM st s JOIN g n ON n.symbol = s.symbol AND n.bar_ix = s.bar_ix + 1))
)
SELECT g.symbol, g.trade_date, ['none', 'compression', 'squeeze', 'attempt', 'confirmed', 'failed'][st.state + 1] AS stage FROM st JOIN g ON g.symbol = st.symbol AND g.bar_ix = st.bar_ix"""

#: The longest flat stretch from each bar on, then from the first bar: take it and go on behind it, or go one bar on.
FLAT_SQL = _RECURSIVE + """,
w AS (
  SELECT b.symbol, b.bar_ix, n.bar_ix - b.bar_ix + 1 AS n, max(n.high) OVER w AS top, min(n.low) OVER w AS bottom, n.trade_date AS end_date
  FROM bars b JOIN bars n ON n.symbol = b.symbol AND n.bar_ix BETWEEN b.bar_ix AND b.bar_ix + 34 WINDOW w AS (PARTITION BY b.symbol, b.bar_ix ORDER BY n.bar_ix ROWS UNBOUNDED PRECEDING)
),
best AS (SELECT symbol, bar_ix, max(n) AS n, max_by(top, n) AS top, max_by(bottom, n) AS bottom, max_by(end_date, n) AS end_date FROM w WHERE n >= 12 AND top / bottom - 1 <= 0.06 GROUP BY symbol, bar_ix),
ends AS (SELECT symbol, max(bar_ix) AS last FROM bars GROUP BY symbol),
nx AS (SELECT b.symbol, b.bar_ix, b.trade_date, f.n, f.top, f.bottom, f.end_date, b.bar_ix + coalesce(f.n, 1) AS next FROM bars b LEFT JOIN best f ON f.symbol = b.symbol AND f.bar_ix = b.bar_ix),
walk AS (
  SELECT symbol, 1::BIGINT AS at FROM ends
  UNION ALL SELECT k.symbol, nx.next FROM walk k JOIN nx ON nx.symbol = k.symbol AND nx.bar_ix = k.at
)
SELECT nx.symbol, nx.trade_date AS start_date, nx.end_date, CAST(nx.n AS INT) AS length, nx.top, nx.bottom FROM walk k JOIN nx ON nx.symbol = k.symbol AND nx.bar_ix = k.at WHERE nx.n IS NOT NULL"""

#: One candidate after the other, with what was taken before.
ADMIT_SQL = QUOTES_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS (SELECT 'main' AS book, symbol, sector, close AS price, low AS stop, row_number() OVER (ORDER BY round(score, 6) DESC, symbol) AS ix FROM q),
a AS (
  SELECT 0::BIGINT AS ix, CAST(NULL AS VARCHAR) AS book, CAST(NULL AS VARCHAR) AS symbol, false AS admitted, CAST('' AS VARCHAR) AS reason, 0::DOUBLE AS risk, CAST([] AS VARCHAR[]) AS taken
  UNION ALL
  SELECT ix, book, symbol, why = '', why, risk, CASE WHEN why = '' THEN list_append(taken, sector) ELSE taken END FROM (
    SELECT c.ix, c.book, c.symbol, c.sector, c.price - c.stop AS risk, a.taken,
      CASE WHEN NOT coalesce(c.price - c.stop > 0, false) THEN 'no_risk' WHEN len(a.taken) >= 6 THEN 'positions' WHEN len(list_filter(a.taken, lambda s: s = c.sector)) >= 2 THEN 'sector'
        WHEN len(a.taken) * 0.01 + 0.01 > 0.05 + 1e-12 THEN 'heat' ELSE '' END AS why
    FROM a JOIN c ON c.ix = a.ix + 1)
)
SELECT book, symbol, admitted, reason, CAST(CASE WHEN admitted THEN floor(1e6 * 0.01 / risk) ELSE 0 END AS BIGINT) AS shares FROM a WHERE ix > 0"""


#: The bars named one by one.
STRIKE_SQL = BARS_SQL + f""",
s AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER b), abs(low - lag(close) OVER b)) AS tr, {prior('avg(volume)', 20)} AS vol20, lag(close, 13) OVER b AS before,
    """ + ", ".join(f"lag({c}, {n}) OVER b AS {c}_{n}" for c in ("open", "low", "close") for n in (1, 2, 3)) + f""" FROM bars {FRAMES}
),
a AS (SELECT *, {full('avg(tr)', 14)} AS atr14, least(low, low_1, low_2, low_3) AS bottom FROM s {FRAMES})
SELECT symbol, trade_date, coalesce(volume >= 1.3 * vol20, false) AS is_valid, round(close, 6) AS entry, round(bottom - greatest(0.5 * atr14, 0.005 * close), 6) AS stop,
  round(close + high - bottom, 6) AS target1, round(close + 2 * (high - bottom), 6) AS target2
FROM a WHERE close_3 < open_3 AND close_2 < open_2 AND close_2 < close_3 AND close_1 < open_1 AND close_1 < close_2 AND close > open AND open <= close_1 AND close >= open_3
  AND (open_3 - before) / before >= -0.5"""


def q_strikes(spark, sf):
    """After any move: the shape is rare in these bars."""
    return D.three_line_strikes(daily_bars(spark, sf), rise=-0.5).select("symbol", "trade_date", "is_valid", *[F.round(c, 6).alias(c) for c in ("entry", "stop", "target1", "target2")])


def q_lines(spark, sf):
    return S.long_form(V.volume_lines(daily_bars(spark, sf)), V.VOLUME_LINE_SIGNALS, ["symbol", "trade_date"])


QUERIES = {
    "pat_volume_lines": (q_lines, LINES_SQL), "pat_three_line_strike": (q_strikes, STRIKE_SQL), "pat_volatility_stages": (decision_queries.q_stages, STAGES_SQL), "dec_admission": (decision_queries.q_admission, ADMIT_SQL),
    "pat_flat_bases": (advice_queries.q_flat, FLAT_SQL),
}
