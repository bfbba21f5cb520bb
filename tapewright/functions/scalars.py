"""Scalar column helpers: clamps, ramps, bands, parsing, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """``greatest`` and ``least`` skip nulls, so a missing value is kept missing here."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high`` (either may be larger), linear between."""
    return clamp((x - F.lit(float(low))) / F.lit(float(high - low)), 0.0, 1.0)


def plateau(x: Column, low: float, good_low: float, good_high: float, high: float) -> Column:
    """1 between the good limits, falling to 0 at the outer ones."""
    return F.least(ramp(x, low, good_low), ramp(x, high, good_high))


def bands(x: Column, table: list[tuple[float, str]], beyond: str) -> Column:
    """Label of the first upper limit that ``x`` lies below."""
    out = None
    for limit, label in table:
        out = F.when(x < limit, label) if out is None else out.when(x < limit, label)
    return F.when(x.isNotNull(), out.otherwise(beyond))


def weighted(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted sum in which missing parts count 0, and the share of weight that was there."""
    total = sum(w for _, w in parts)
    score = sum((F.coalesce(p * F.lit(float(w)), F.lit(0.0)) for p, w in parts), F.lit(0.0))
    there = sum((F.when(p.isNotNull(), F.lit(float(w))).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return score, there / F.lit(float(total))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, null without trials."""
    p = hits / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    return F.when(n > 0, low), F.when(n > 0, high)


def parse_number(text: Column) -> Column:
    """'1,234.5', '(1,234)' and blanks as numbers or null."""
    bare = F.regexp_replace(F.trim(text), "[,$\\s]", "")
    negative = bare.rlike("^\\(.*\\)$")
    value = F.regexp_replace(bare, "[()]", "").try_cast("double")
    return F.when(negative, -value).otherwise(value)


def clean_symbol(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(text), "[^A-Za-z0-9]", ""))


def luhn_valid(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def monotone_quantile(values: Column, p: float) -> Column:
    """Quantile of an array with linear interpolation, null for an empty one."""
    ordered = F.array_sort(values)
    n = F.size(values)
    at = (n - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a = F.try_element_at(ordered, low + 1)
    b = F.try_element_at(ordered, F.least(low + 2, n))
    return F.when(n > 0, a + (b - a) * (at - low))
