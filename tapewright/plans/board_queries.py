"""The evidence board over the weekly panel, with recursive SQL for its means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import evidence_board as B
from tapewright.sources.panels import WEEKLY_SQL, weekly_bars

_W = "PARTITION BY symbol ORDER BY bar_ix"
_COMPONENTS = {
    "regime": ("CASE WHEN label IN ('RISK-ON', 'CONSTRUCTIVE') THEN 1 WHEN label = 'RISK-OFF' THEN -1 ELSE 0 END", "CASE WHEN label IN ('RISK-ON', 'RISK-OFF') THEN 1.0 ELSE 0.5 END"),
    "sector": ("CASE WHEN sb > 55 AND sa > 0 THEN 1 WHEN sb < 45 AND sa < 0 THEN -1 ELSE 0 END", "abs(sb - 50) / 30"),
    "effort": (
        "CASE WHEN effort IS NOT NULL THEN CASE WHEN (effort >= 1.5 AND progress < 0.5) OR (effort >= 1.2 AND spread >= 1.2) OR (effort < 0.8 AND progress >= 1) THEN 1 ELSE 0 END END",
        "CASE WHEN effort >= 1.5 AND progress < 0.5 THEN 0.5 WHEN effort >= 1.2 AND spread >= 1.2 THEN 0.7 WHEN effort < 0.8 AND progress >= 1 THEN 0.6 ELSE 0 END",
    ),
    "relative": ("CASE WHEN pct - (sa + ma) / 2 > 0.3 THEN 1 WHEN pct - (sa + ma) / 2 < -0.3 THEN -1 ELSE 0 END", "abs(pct - (sa + ma) / 2) / 3"),
    "momentum": ("CASE WHEN rsi > 55 THEN 1 WHEN rsi < 45 THEN -1 WHEN rsi IS NOT NULL THEN 0 END", "abs(rsi - 50) / 30"),
    "macd": ("CASE WHEN hist > 0 THEN 1 WHEN hist < 0 THEN -1 ELSE 0 END", "abs(hist) / greatest(0.01, 0.01 * abs(close))"),
    "obv": ("CASE WHEN obv_10 IS NOT NULL THEN CASE WHEN obv > obv_10 THEN 1 ELSE -1 END END", "CASE WHEN close <= close_10 AND obv > obv_10 THEN 0.7 ELSE 0.3 END"),
    "reward": ("CASE WHEN rr >= 1.5 THEN 1 WHEN rr < 1 THEN -1 WHEN rr IS NOT NULL THEN 0 END", "rr / 3"),
    "structure": ("CASE WHEN sma_4 IS NOT NULL THEN CASE WHEN close > sma AND sma > sma_4 THEN 1 WHEN close < sma AND sma < sma_4 THEN -1 ELSE 0 END END", "0.6"),
}
BOARD_SQL = WEEKLY_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
r AS (
  SELECT symbol, bar_ix, close AS e12, close AS e26, 0.0::DOUBLE AS sig, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, close AS c FROM weekly WHERE bar_ix = 1
  UNION ALL
  SELECT symbol, bar_ix, e12, e26, sig + ((e12 - e26) - sig) * 0.2, CASE WHEN gain IS NULL THEN up ELSE gain + (up - gain) / 14 END, CASE WHEN loss IS NULL THEN down ELSE loss + (down - loss) / 14 END, c
  FROM (SELECT n.symbol, n.bar_ix, r.e12 + (n.close - r.e12) * (2.0 / 13) AS e12, r.e26 + (n.close - r.e26) * (2.0 / 27) AS e26, r.sig, r.gain, r.loss, greatest(n.close - r.c, 0) AS up,
    greatest(r.c - n.close, 0) AS down, n.close AS c FROM r JOIN weekly n ON n.symbol = r.symbol AND n.bar_ix = r.bar_ix + 1)
),
a AS (
  SELECT w.*, e12 - e26 - sig AS hist, CASE WHEN w.bar_ix > 14 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi, greatest(1e-6, w.high - w.low) AS sp,
    coalesce(sign(w.close - lag(w.close) OVER (PARTITION BY w.symbol ORDER BY w.bar_ix)), 0) * w.volume AS step
  FROM weekly w JOIN r ON r.symbol = w.symbol AND r.bar_ix = w.bar_ix
),
b AS (
  SELECT *, 100 * (close / lag(close) OVER b - 1) AS pct, sum(step) OVER cum AS obv, CASE WHEN count(*) OVER w22 = 22 THEN volume / greatest(1, avg(volume) OVER p19) END AS effort,
    CASE WHEN count(*) OVER w22 = 22 THEN sp / greatest(1e-6, avg(sp) OVER p19) END AS spread, CASE WHEN count(*) OVER w22 = 22 THEN abs(close - lag(close) OVER b) / greatest(1e-6, avg(sp) OVER p19) END AS progress,
    lag(close, 10) OVER b AS close_10, CASE WHEN count(*) OVER p20 = 20 THEN max(high) OVER p20 END AS hi, CASE WHEN count(*) OVER p20 = 20 THEN min(low) OVER p20 END AS lo,
    CASE WHEN count(*) OVER w26 = 26 THEN avg(close) OVER w26 END AS sma, avg(close * volume) OVER w20 AS turnover
  FROM a WINDOW b AS ({_W}), cum AS ({_W} ROWS UNBOUNDED PRECEDING), w22 AS ({_W} ROWS 21 PRECEDING), p19 AS ({_W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), p20 AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    w26 AS ({_W} ROWS 25 PRECEDING), w20 AS ({_W} ROWS 19 PRECEDING)
),
c AS (SELECT *, lag(obv, 10) OVER ({_W}) AS obv_10, lag(sma, 4) OVER ({_W}) AS sma_4, CASE WHEN close <> lo THEN (hi - close) / (close - lo) END AS rr FROM b),
d AS (SELECT * FROM c WHERE pct IS NOT NULL),
m AS (SELECT week, 100.0 * count(*) FILTER (WHERE pct > 0) / greatest(1, count(*) FILTER (WHERE pct <> 0)) AS mb, avg(pct) AS ma FROM d GROUP BY week),
s AS (SELECT week, sector, 100.0 * count(*) FILTER (WHERE pct > 0) / greatest(1, count(*) FILTER (WHERE pct <> 0)) AS sb, avg(pct) AS sa FROM d GROUP BY week, sector),
j AS (
  SELECT d.*, mb, ma, sb, sa, greatest(0, least(100, 0.6 * mb + 0.4 * greatest(0, least(100, 50 + 10 * ma)))) AS ms FROM d JOIN m ON m.week = d.week JOIN s ON s.week = d.week AND s.sector = d.sector
),
k AS (SELECT *, CASE WHEN ms < 45 THEN 'RISK-OFF' WHEN ms < 55 THEN 'MIXED' WHEN ms < 65 THEN 'CONSTRUCTIVE' ELSE 'RISK-ON' END AS label FROM j),
x AS (SELECT *, """ + ", ".join(f"{s} AS s_{n}, coalesce(({s}) * greatest(0, least(1, {t})) * {B.WEIGHTS[n]}, 0) AS p_{n}" for n, (s, t) in _COMPONENTS.items()) + """ FROM k),
y AS (
  SELECT *, greatest(0, least(100, 50.0 + """ + " + ".join(f"p_{n}" for n in _COMPONENTS) + ")) AS score, " + ", ".join(
    " + ".join(f"coalesce(({test.format(n)})::INT, 0)" for n in _COMPONENTS) + f" AS {name}" for name, test in (("n_bull", "s_{0} > 0"), ("n_bear", "s_{0} < 0"), ("n_known", "s_{0} IS NOT NULL"))
) + """ FROM x
),
z AS (
  SELECT *, CASE WHEN n_bull > n_bear AND score >= 78 AND rr >= 2 AND turnover >= 2000 THEN 4 WHEN n_bull > n_bear AND score >= 65 THEN 3 WHEN n_bull > n_bear AND score >= 50 THEN 1 ELSE 0 END AS claim,
    greatest(n_bull, n_bear) AS most FROM y
)
SELECT symbol, week, round(score, 4)::DOUBLE AS score, CAST(n_bull AS INT) AS n_bull, CAST(n_bear AS INT) AS n_bear, CAST(n_known AS INT) AS n_known,
  CASE WHEN score >= 88 AND most >= 7 THEN 'A+' WHEN score >= 78 AND most >= 6 THEN 'A' WHEN score >= 65 AND most >= 4 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN claim > 0 AND turnover < 500 THEN 'AVOID' WHEN claim > 0 THEN ['WATCH FOR BUY', 'ACCUMULATE', 'BUY', 'STRONG BUY'][CASE WHEN coalesce(rr < 1.5, false) OR turnover < 2000 THEN least(claim, 1) ELSE claim END]
    WHEN n_bear > n_bull AND score <= 35 THEN 'SELL / REDUCE' WHEN n_bear > n_bull AND score <= 45 THEN 'WATCH FOR SELL' WHEN turnover < 2000 THEN 'AVOID' ELSE 'NEUTRAL' END AS action,
  """ + ", ".join(f"round(p_{n}, 4)::DOUBLE AS p_{n}" for n in _COMPONENTS) + " FROM z"


def q_board(spark, sf):
    f = B.evidence_board(weekly_bars(spark, sf))
    return f.select("symbol", "week", F.round("score", 4).alias("score"), "n_bull", "n_bear", "n_known", "grade", "action", *[F.round(f"p_{n}", 4).alias(f"p_{n}") for n in B.WEIGHTS])


QUERIES = {"dec_evidence_board": (q_board, BOARD_SQL)}
