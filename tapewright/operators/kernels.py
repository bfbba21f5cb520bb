"""Indicators whose value depends on their own previous value.

No frame function can express these, so each symbol's bars go once through a grouped map that
computes all of them in one pass over NumPy arrays.  A symbol's daily history is bounded
(a few thousand bars), and symbols spread over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ewma(x: np.ndarray, alpha: float) -> np.ndarray:
    """y = y' + alpha (x - y'), started with the first value."""
    out = np.empty(len(x))
    y = x[0] if len(x) else np.nan
    for i, value in enumerate(x):
        y = y + alpha * (value - y) if i else value
        out[i] = y
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def recursive_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    close, high, low = (pdf[x].to_numpy(float) for x in ("close", "high", "low"))
    step = np.diff(close, prepend=close[:1])
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = ewma(np.where((up > down) & (up > 0), up, 0.0), 1 / 14)
    minus = ewma(np.where((down > up) & (down > 0), down, 0.0), 1 / 14)
    atr = ewma(true_range(high, low, close), 1 / 14)
    gain, loss = ewma(np.maximum(step, 0), 1 / 14), ewma(np.maximum(-step, 0), 1 / 14)
    ema12, ema26 = ewma(close, 2 / 13), ewma(close, 2 / 27)
    signal = ewma(ema12 - ema26, 0.2)
    with np.errstate(divide="ignore", invalid="ignore"):
        dx = np.where(plus + minus > 0, 100 * np.abs(plus - minus) / (plus + minus), 0.0)
        out = pdf.assign(
            ema12=ema12, ema26=ema26, ema20=ewma(close, 2 / 21), ema50=ewma(close, 2 / 51), ema200=ewma(close, 2 / 201),
            macd=ema12 - ema26, macd_signal=signal, macd_hist=ema12 - ema26 - signal,
            rsi_wilder=np.where(loss > 0, 100 - 100 / (1 + gain / loss), np.nan), atr_wilder=atr, adx=ewma(dx, 1 / 14),
            plus_di=np.where(atr > 0, 100 * plus / atr, np.nan), minus_di=np.where(atr > 0, 100 * minus / atr, np.nan),
        )
    return out


RECURSIVE = ["ema12", "ema26", "ema20", "ema50", "ema200", "macd", "macd_signal", "macd_hist", "rsi_wilder", "atr_wilder", "adx", "plus_di", "minus_di"]


def _per_symbol(bars: DataFrame, fn, extra: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + ", " + extra
    names = [x.strip().split()[0] for x in extra.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values("bar_ix", ignore_index=True))
        # null, not NaN, where a value is not defined
        out[names] = out[names].astype(object).where(out[names].notna(), None)
        return out

    return bars.groupBy("symbol").applyInPandas(run, schema)


def recursive(bars: DataFrame) -> DataFrame:
    """EMAs, MACD, Wilder's RSI, ATR and ADX."""
    return _per_symbol(bars, recursive_columns, ", ".join(f"{x} double" for x in RECURSIVE))


def supertrend_columns(pdf: pd.DataFrame, n: int = 10, width: float = 3.0) -> pd.DataFrame:
    """Bands that only tighten while the price stays inside, and the side of the trend."""
    close, high, low = (pdf[x].to_numpy(float) for x in ("close", "high", "low"))
    atr, mid = ewma(true_range(high, low, close), 1 / n), (high + low) / 2
    line, side = np.empty(len(close)), np.empty(len(close), int)
    up = down = 0.0
    d = 1
    for i in range(len(close)):
        top, bottom = mid[i] + width * atr[i], mid[i] - width * atr[i]
        if i:
            d = 1 if close[i] > up else -1 if close[i] < down else d
            top = min(top, up) if close[i - 1] <= up else top
            bottom = max(bottom, down) if close[i - 1] >= down else bottom
        up, down = top, bottom
        line[i], side[i] = (down if d == 1 else up), d
    return pdf.assign(direction=side, supertrend=line)


def supertrend(bars: DataFrame) -> DataFrame:
    return _per_symbol(bars, supertrend_columns, "direction int, supertrend double")
