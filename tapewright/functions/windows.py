"""Window idioms over per-symbol panels, written once.

``W(n)`` is the last n bars with this one, ``WP(n)`` the n bars before this one, ``CUM`` all
bars so far, ``FWD(n)`` the n bars after this one.  All share one (symbol, order) sort, so a
projection of many of them costs a single exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    """Key and order of a panel."""

    key: str = "symbol"
    order: str = "bar_ix"

    @property
    def base(self):
        return Window.partitionBy(self.key).orderBy(self.order)

    def W(self, n: int):
        return self.base.rowsBetween(-(n - 1), 0)

    def WP(self, n: int):
        return self.base.rowsBetween(-n, -1)

    def FWD(self, n: int):
        return self.base.rowsBetween(1, n)

    @property
    def CUM(self):
        return self.base.rowsBetween(Window.unboundedPreceding, 0)

    def full(self, agg: Column, n: int, seen: str | Column = "close") -> Column:
        """``agg`` over W(n), null until n values of ``seen`` are there."""
        return F.when(F.count(seen).over(self.W(n)) == n, agg.over(self.W(n)))

    def prior(self, agg: Column, n: int, seen: str | Column = "close") -> Column:
        return F.when(F.count(seen).over(self.WP(n)) == n, agg.over(self.WP(n)))

    def ahead(self, agg: Column, n: int, seen: str | Column = "close") -> Column:
        return F.when(F.count(seen).over(self.FWD(n)) == n, agg.over(self.FWD(n)))

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.base)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.base)

    def cum(self, agg: Column) -> Column:
        return agg.over(self.CUM)

    def memory(self, flag: Column, n: int) -> Column:
        """Was the flag true in any of the last n bars?"""
        return F.max(flag.cast("int")).over(self.W(n)) == 1

    def last_where(self, cond: Column, value: Column) -> Column:
        """Value of the latest bar so far on which the condition held."""
        return F.last(F.when(cond, value), ignorenulls=True).over(self.CUM)


BARS = Panel()


def run_length(df: DataFrame, flag: Column, name: str, panel: Panel = BARS) -> DataFrame:
    """Adds how many bars in a row, up to this one, the flag has been true."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    island = marked.withColumn("__island", F.sum((~F.col("__flag")).cast("int")).over(panel.CUM))
    own = Window.partitionBy(panel.key, "__island").orderBy(panel.order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(name, F.sum(F.col("__flag").cast("int")).over(own).cast("long")).drop("__flag", "__island")


def corr(x: str, y: str, w) -> Column:
    """Correlation over a window, null where one side does not vary (the built-in fails on that)."""
    return F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def cross_above(panel: Panel, a: Column, b: Column) -> Column:
    return (a > b) & (panel.lag(a) <= panel.lag(b))


def cross_below(panel: Panel, a: Column, b: Column) -> Column:
    return (a < b) & (panel.lag(a) >= panel.lag(b))


def asof_backward(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], take: list[str], strict: bool = False
) -> DataFrame:
    """Each left row with the values of the latest right row at or before it (``strict``: before).

    Both sides are stacked and sorted once by (by, time): linear, one shuffle, no range join.
    Without ``by`` a series for all would need one task, so ``by`` may not be empty: market-wide
    series are joined on their few dates instead."""
    if not by:
        raise ValueError("asof_backward needs a key")
    row = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(*[F.col(c) for c in take])
    sides = left.select(*by, F.col(left_on).alias("__t"), F.lit(0 if strict else 1).alias("__side"), row.alias("__row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__value"))
    sides = sides.unionByName(
        right.select(*by, F.col(right_on).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(sides.schema["__row"].dataType).alias("__row"), value.alias("__value"))
    )
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = sides.withColumn("__value", F.last("__value", ignorenulls=True).over(w)).filter("__row is not null")
    return out.select("__row.*", *[F.col(f"__value.{c}").alias(c) for c in take])


def asof_forward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], take: list[str]) -> DataFrame:
    """Each left row with the values of the first right row at or after it."""
    row, value = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in take])
    l = left.select(*by, F.col(left_on).alias("__t"), F.lit(0).alias("__side"), row.alias("__row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__value"))
    r = right.select(*by, F.col(right_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), value.alias("__value"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(0, Window.unboundedFollowing)
    out = l.unionByName(r).withColumn("__value", F.first("__value", ignorenulls=True).over(w)).filter("__row is not null")
    return out.select("__row.*", *[F.col(f"__value.{c}").alias(c) for c in take])
