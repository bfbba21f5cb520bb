"""Candlestick patterns: shapes of single bars, and formations of two to five.

A bar is read as shares of its range: its body, the wick above and the tail below.  Every bar has at most one shape.
A formation is a rule on sizes, which holds for both directions, and a rule on directions, which is written for
the bullish side; the bearish side is the same rule upside down."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P

BACK = 4
#: Fixed values: limits of shapes as shares of the range or of the body, of formations as ratios of bodies,
#: of twins and of the trend as shares of the price; names of patterns.
SHAPES: dict[str, str] = {
    "gravestone": "body < 0.05 AND wick > 0.6 AND tail < 0.1",
    "dragonfly": "body < 0.05 AND tail > 0.6 AND wick < 0.1",
    "rickshaw": "body < 0.05 AND least(wick, tail) > 0.35",
    "cross": "body < 0.05",
    "full": "body > 0.9",
    "tailed": "tail > 2 * body AND wick < 0.5 * body",
    "wicked": "wick > 2 * body AND tail < 0.5 * body",
    "top": "body < 0.35 AND least(wick, tail) > 0.4 * body",
}
#: Pattern: its shape, and the trend before it where that tells it from another.
SINGLE: dict[str, tuple[str, str | None]] = {
    "Doji": ("cross", None), "Long-Legged Doji": ("rickshaw", None), "Dragonfly Doji": ("dragonfly", None), "Gravestone Doji": ("gravestone", None),
    "Spinning Top": ("top", None), "Marubozu": ("full", None),
    "Hammer": ("tailed", "down"), "Inverted Hammer": ("wicked", "down"), "Hanging Man": ("tailed", "up"), "Shooting Star": ("wicked", "up"),
}
#: (bullish name, bearish name, rule on sizes, rule on directions).
FORMATIONS: list[tuple[str, str, str, str]] = [
    ("Bullish engulfing", "Bearish engulfing", "true", "black1 AND white AND o <= c1 AND c >= o1"),
    ("Morning Star", "Evening Star", "len1 < 0.4 * len2 AND body1 >= 0.1", "black2 AND white AND c > mid2"),
    ("Morning Doji Star", "Evening Doji Star", "len1 < 0.4 * len2 AND body1 < 0.1", "black2 AND white AND c > mid2"),
    ("Three Inside Up", "Three Inside Down", "len1 < 0.6 * len2 AND top1 < top2 AND bot1 > bot2", "black2 AND c > o2"),
    ("Three White Soldiers", "Three Black Crows", "true", "rose2 AND rose1 AND white AND c2 < c1 AND c1 < c AND o2 < o1 AND o1 < o"),
    ("Rising Three Methods", "Falling Three Methods", "pause", "white4 AND white AND c > c4"),
]
ONE_WAY: dict[str, str] = {
    "Piercing Pattern": "black1 AND white AND o < l1 AND c > mid1 AND c < o1",
    "Dark Cloud Cover": "white1 AND black AND o > c1 AND c < mid1 AND c > o1",
    "Harami": "top < top1 AND bot > bot1 AND body >= 0.05",
    "Harami Cross": "top < top1 AND bot > bot1 AND body < 0.05",
    "Tweezer Top": "abs(h - h1) < 0.003 * h1",
    "Tweezer Bottom": "abs(l - l1) < 0.003 * l1",
}
TREND, TREND_BARS = 0.02, 10
_OTHER = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "white": "black", "black": "white", "rose": "fell", "fell": "rose"}


def upside_down(rule: str) -> str:
    """A rule on directions for the mirrored chart."""
    return re.sub("<=|>=|[<>]|white|black|rose|fell", lambda m: _OTHER[m[0]], rule)


CANDLES: dict[str, str] = {name: f"shape = '{shape}'" + (f" AND trend = '{trend}'" if trend else "") for name, (shape, trend) in SINGLE.items()} | ONE_WAY
for _bull, _bear, _sizes, _directions in FORMATIONS:
    CANDLES |= {_bull: f"{_sizes} AND {_directions}", _bear: f"{_sizes} AND {upside_down(_directions)}"}
BULLISH = frozenset([f[0] for f in FORMATIONS] + ["Hammer", "Inverted Hammer", "Dragonfly Doji", "Piercing Pattern", "Tweezer Bottom"])
BEARISH = frozenset([f[1] for f in FORMATIONS] + ["Hanging Man", "Shooting Star", "Gravestone Doji", "Dark Cloud Cover", "Tweezer Top"])


def geometry() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Columns that the rules name, in three steps, each over those before: SQL text over o, h, l, c and the same of
    1 to BACK bars before."""
    at = lambda x, n: f"{x}{n or ''}"
    bars = range(BACK + 1)
    first = {at("top", n): f"greatest({at('o', n)}, {at('c', n)})" for n in bars} | {at("bot", n): f"least({at('o', n)}, {at('c', n)})" for n in bars}
    first |= {at("r", n): f"{at('h', n)} - {at('l', n)}" for n in (0, 1)} | {at("mid", n): f"({at('o', n)} + {at('c', n)}) / 2" for n in (1, 2)}
    for n in bars:
        first |= {at("white", n): f"{at('c', n)} > {at('o', n)}", at("black", n): f"NOT {at('c', n)} > {at('o', n)}"}
        first |= {at("rose", n): f"{at('c', n)} > {at('o', n)}", at("fell", n): f"{at('c', n)} < {at('o', n)}"}
    second = {at("len", n): f"{at('top', n)} - {at('bot', n)}" for n in bars} | {at("body", n): f"coalesce(({at('top', n)} - {at('bot', n)}) / nullif({at('r', n)}, 0), 0)" for n in (0, 1)}
    second |= {"wick": "coalesce((h - top) / nullif(r, 0), 0)", "tail": "coalesce((bot - l) / nullif(r, 0), 0)"}
    second |= {"trend": f"CASE WHEN drift > {TREND} THEN 'up' WHEN drift < -{TREND} THEN 'down' WHEN drift IS NOT NULL THEN 'flat' ELSE 'unknown' END"}
    third = {"shape": "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in SHAPES.items()) + " END"}
    third |= {"pause": " AND ".join(f"len{n} < 0.6 * len4 AND top{n} <= top4 AND bot{n} >= bot4" for n in (1, 2, 3))}
    return first, second, third


def candle_frame(bars: DataFrame) -> DataFrame:
    """Bars with the columns that CANDLES name."""
    lags = {f"{k}{n or ''}": P.lag(x, n) if n else F.col(x) for k, x in zip("ohlc", ("open", "high", "low", "close")) for n in range(BACK + 1)}
    out = bars.withColumns(lags | {"drift": P.lag("close", 1) / P.lag("close", TREND_BARS) - 1})
    for step in geometry():
        out = out.withColumns({name: F.expr(rule) for name, rule in step.items()})
    return out


def bias(signal: Column) -> Column:
    return F.when(signal.isin(*sorted(BULLISH)), "bullish").when(signal.isin(*sorted(BEARISH)), "bearish").otherwise("neutral")
