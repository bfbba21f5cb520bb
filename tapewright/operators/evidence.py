"""Relational operators of the evidence store: temporal and overlap joins, corrections, coverage, review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(events: DataFrame, spans: DataFrame, at: str, start: str, end: str, on: list[str], bin_days: int = 32, horizon: str = "2100-01-01") -> DataFrame:
    """Events with the spans of their key that hold their date; an open end holds for ever.

    Dates are cut into bins and a span is copied to each of its bins, so the range condition becomes an
    equi-join on (key, bin) with a check: no nested loop, however many events there are.  Spans without an
    end are not copied to bins without end: they join on the key alone."""
    bin_of = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bin_days)
    e = events.withColumn("__bin", bin_of(F.col(at)))
    closed = spans.filter(F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end)))))
    inside = F.col(at).between(F.col(start), F.col(end))
    a = e.join(closed, [*on, "__bin"]).filter(inside).drop("__bin")
    b = events.join(spans.filter(F.col(end).isNull()), on).filter(F.col(at) >= F.col(start))
    return a.unionByName(b.select(a.columns))


def overlaps(spans: DataFrame, by: str, key: str, start: str, end: str) -> DataFrame:
    """Pairs of spans of one group that overlap (x before y by key); an open end overlaps all that follow."""
    far = F.lit("9999-12-31").cast("date")
    x, y = spans.alias("x"), spans.alias("y")
    meet = (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col(f"x.{key}") < F.col(f"y.{key}"))
    meet &= (F.col(f"x.{start}") < F.coalesce(F.col(f"y.{end}"), far)) & (F.col(f"y.{start}") < F.coalesce(F.col(f"x.{end}"), far))
    return x.join(y, meet).select(F.col(f"x.{by}").alias(by), F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"))


def latest_overlay(base: DataFrame, corrections: DataFrame, on: str, order: str, cols: list[str]) -> DataFrame:
    """Base rows with the values of their latest correction where it has one, and how many there are."""
    last = corrections.groupBy(on).agg(F.max_by(F.struct(*cols), order).alias("__c"), F.count("*").alias("corrections"))
    j = base.join(last, on, "left")
    kept = [c for c in base.columns if c not in cols]
    return j.select(*kept, *[F.coalesce(F.col(f"__c.{c}"), F.col(c)).alias(c) for c in cols], F.coalesce("corrections", F.lit(0)).alias("corrections"))


def all_hold(df: DataFrame, by: str, cond: str) -> DataFrame:
    """Groups in which no row breaks the condition, with their size."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.expr(cond)).alias("broken")).filter("broken = 0").select(by, "n")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the latest row of each key over both sides; on equal order the change wins."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    cols = [c for c in current.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, "__new")).alias("r")).select(*keys, "r.*")


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one for each key."""
    return new.dropDuplicates(keys).join(current, keys, "left_anti")
