"""Chart pattern and accumulation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import chart_patterns as C
from tapewright.plans.study_queries import PIVOT_CTE
from tapewright.sources.panels import BARS_SQL, daily_bars

SEQ_CTE = PIVOT_CTE + ", sq AS (SELECT symbol, kind, " + ", ".join(
    f"lead({c}, {n}) OVER w AS {k}{n}" for n in range(5) for k, c in (("p", "price"), ("b", "bar_ix"), ("k", "confirmed_ix"))
) + " FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY bar_ix, kind)), ch AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{name}' AS pattern, b0 AS start_ix, b{n - 1} AS end_ix, k{n - 1} AS known_ix, {level} AS level, {1 if side == 'up' else -1} AS side, "
    f"greatest({', '.join(f'p{i}' for i in range(n))}) - least({', '.join(f'p{i}' for i in range(n))}) AS height FROM sq WHERE kind = '{kind}' AND p{n - 1} IS NOT NULL AND {rule}"
    for name, (n, kind, rule, level, side) in C.CHARTS.items()
) + ")"
CHART_SQL = SEQ_CTE + f""" SELECT ch.symbol, pattern, CAST(start_ix AS INT) AS start_ix, CAST(end_ix AS INT) AS end_ix, round(any_value(level), 6) AS level, min(b.trade_date) AS breakout_date, round(any_value(level + side * height), 6) AS target
FROM ch JOIN bars b ON b.symbol = ch.symbol AND b.bar_ix > known_ix AND b.bar_ix <= known_ix + {C.WAIT} AND (b.close - level) * side > 0 GROUP BY ch.symbol, pattern, start_ix, end_ix"""
ACC_SQL = BARS_SQL + """, y AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_all, row_number() OVER (PARTITION BY symbol ORDER BY bar_ix DESC) AS back FROM bars),
w0 AS (SELECT symbol, s.side, trade_date, volume, back, least(n_all, 120) + 1 - back AS i, least(n_all, 120) AS n, open * s.side AS open, close * s.side AS close,
  CASE WHEN s.side = 1 THEN low ELSE -high END AS low, CASE WHEN s.side = 1 THEN high ELSE -low END AS high FROM y, (VALUES (1), (-1)) s(side) WHERE n_all >= 60 AND back <= 120),
w AS (SELECT *, high - low AS spread, avg(volume) OVER q AS avgv, avg(high - low) OVER q AS avgs, count(*) OVER q AS n20, min(low) OVER f AS lo, max(high) OVER f AS hi FROM w0
  WINDOW q AS (PARTITION BY symbol, side ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol, side)),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY volume / avgv * coalesce((hi - low) / nullif(hi - lo, 0), 1) DESC, i) AS rn FROM w
  WHERE n20 = 20 AND volume / avgv >= 1.6 AND spread >= 1.2 * avgs AND close < open AND close - low <= 0.4 * spread),
sc AS (SELECT * FROM c WHERE rn = 1 AND i < n - 4),
j AS (SELECT w.*, sc.i AS sci, sc.low AS sclow, sc.volume AS scvol, least(40, w.n - sc.i + 1) AS bars FROM w JOIN sc ON sc.symbol = w.symbol AND sc.side = w.side),
ps AS (SELECT symbol, side, arg_max(trade_date, i) AS d, arg_max(close, i) AS p FROM j WHERE n20 = 20 AND i < sci AND volume / avgv >= 1.25 AND close < open AND low > sclow GROUP BY symbol, side),
ar AS (SELECT symbol, side, i, trade_date AS d, high AS p FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY high DESC, i) AS rn FROM j WHERE i BETWEEN sci + 1 AND sci + 25) WHERE rn = 1),
st AS (SELECT j.symbol, j.side, arg_min(j.trade_date, j.i) AS d, arg_min(j.close, j.i) AS p FROM j JOIN ar ON ar.symbol = j.symbol AND ar.side = j.side
  WHERE j.i BETWEEN ar.i + 4 AND ar.i + 29 AND low <= sclow * (1 + 0.025 * j.side) AND volume < 0.85 * scvol AND volume < 0.85 * avgv GROUP BY j.symbol, j.side),
tr AS (SELECT symbol, side, least(min(low), any_value(sclow)) AS sup, max(high) AS res FROM j WHERE bars >= 20 AND i > n - bars AND i <= n - 3 GROUP BY symbol, side),
k AS (SELECT j.*, sup, res FROM j JOIN tr ON tr.symbol = j.symbol AND tr.side = j.side),
sp AS (SELECT symbol, side, arg_max(trade_date, i) AS d, arg_max(close, i) AS p, max(i) AS spi, arg_max(low, i) AS splow, arg_max(avgv, i) AS spv FROM k WHERE i >= greatest(sci, n - 19) AND low < sup AND close > sup GROUP BY symbol, side),
m AS (SELECT k.*, spi, splow, spv FROM k JOIN sp ON sp.symbol = k.symbol AND sp.side = k.side),
te AS (SELECT symbol, side, arg_min(trade_date, i) AS d, arg_min(close, i) AS p FROM m WHERE i BETWEEN spi + 1 AND spi + 8 AND low > splow AND volume < 0.8 * spv GROUP BY symbol, side),
so AS (SELECT symbol, side, arg_max(trade_date, i) AS d, arg_max(close, i) AS p, max(i) AS soi FROM m WHERE i > spi AND close > res AND volume > 1.3 * spv GROUP BY symbol, side),
lp AS (SELECT m.symbol, m.side, arg_min(m.trade_date, m.i) AS d, arg_min(m.close, m.i) AS p FROM m JOIN so ON so.symbol = m.symbol AND so.side = m.side
  WHERE m.i BETWEEN soi + 1 AND soi + 10 AND m.close > res * (1 - 0.02 * m.side) AND m.close < so.p GROUP BY m.symbol, m.side),
every AS (SELECT symbol, side, 'PS' AS a, 'PSY' AS b, d, p FROM ps UNION ALL SELECT symbol, side, 'SC', 'BC', trade_date, close FROM sc UNION ALL SELECT symbol, side, 'AR', 'AR', d, p FROM ar
  UNION ALL SELECT symbol, side, 'ST', 'ST', d, p FROM st UNION ALL SELECT symbol, side, 'SPRING', 'UT', d, p FROM sp UNION ALL SELECT symbol, side, 'TEST', NULL, d, p FROM te
  UNION ALL SELECT symbol, side, 'SOS', 'SOW', d, p FROM so UNION ALL SELECT symbol, side, 'LPS', 'LPSY', d, p FROM lp)
SELECT symbol, CASE WHEN side = 1 THEN 'accumulation' ELSE 'distribution' END AS campaign, CASE WHEN side = 1 THEN a ELSE b END AS event, d AS trade_date, round(p * side, 6) AS price
FROM every WHERE side = 1 OR b IS NOT NULL"""


def q_charts(spark, sf):
    c = C.chart_patterns(daily_bars(spark, sf))
    return c.select("symbol", "pattern", F.col("start_ix").cast("int").alias("start_ix"), F.col("end_ix").cast("int").alias("end_ix"), F.round("level", 6).alias("level"), "breakout_date", F.round("target", 6).alias("target"))


def q_accumulation(spark, sf):
    return C.campaign_events(daily_bars(spark, sf)).withColumn("price", F.round("price", 6))


QUERIES = {"piv_chart_patterns": (q_charts, CHART_SQL), "pat_accumulation_events": (q_accumulation, ACC_SQL)}
