"""Filters, overlays, fallbacks and checks on stored records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes of the day in which a session is open, by weekday (Monday is 0); Friday has two.
SESSIONS = {**{day: [(570, 930)] for day in range(4)}, 4: [(555, 720), (855, 965)]}


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every condition that is given: ``column=value``, ``column__from``, ``column__until`` (before it),
    ``column__least``, ``column__in``, ``column__not_in`` (keeps nulls), ``column__contains``.  None asks for nothing."""
    tests = {
        "": lambda c, v: c == v, "from": lambda c, v: c >= v, "until": lambda c, v: c < v, "least": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v),
        "not_in": lambda c, v: c.isNull() | ~c.isin(*v), "contains": lambda c, v: c.contains(v),
    }
    for key, value in wanted.items():
        if value is not None:
            name, _, test = key.partition("__")
            df = df.filter(tests[test](F.col(name), F.lit(value) if not isinstance(value, (list, tuple)) else value))
    return df


def containing(df: DataFrame, column: str, text: str, newest: str, limit: int = 200) -> DataFrame:
    """The newest rows whose column contains a text: a top-k, not a sort of all."""
    return matching(df, **{f"{column}__contains": text}).orderBy(F.desc(newest)).limit(limit)


def ungraded(df: DataFrame, made: str, grade: str, as_of: date, days: int) -> DataFrame:
    """Rows without a grade that are at least so many days old."""
    return df.filter((F.datediff(F.lit(as_of), F.col(made)) >= days) & (F.col(grade).isNull() | (F.col(grade) == "")))


def without(df: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    """Rows whose key is on no list of exclusions; rows without a key stay, and a null on the list removes nothing."""
    return df.join(excluded.filter(F.col(on).isNotNull()).select(on).distinct(), on, "left_anti")


def overlay(cached: DataFrame, quotes: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Cached rows with newer fields where a quote has them."""
    fresh = quotes.select(on, *[F.col(x).alias(f"__{x}") for x in fields])
    return overlaid(cached.join(fresh, on, "left"), fields)


def overlaid(j: DataFrame, fields: list[str]) -> DataFrame:
    """``overlay`` of rows that hold their quote already, each field beside its ``__field``."""
    live = F.lit(False)
    for x in fields:
        live = live | F.col(f"__{x}").isNotNull()
    return j.withColumn("live", live).withColumns({x: F.coalesce(f"__{x}", x) for x in fields}).drop(*[f"__{x}" for x in fields])


def first_non_empty(sources: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """For each key the rows of the first source that has any, and that source's name."""
    tagged = None
    for rank, (name, df) in enumerate(sources):
        one = df.withColumns({"__rank": F.lit(rank), "source": F.lit(name)})
        tagged = one if tagged is None else tagged.unionByName(one)
    best = tagged.groupBy(by).agg(F.min("__rank").alias("__rank"))
    return tagged.join(best, [by, "__rank"], "left_semi").drop("__rank")


def in_session(ts: Column, sessions: dict[int, list[tuple[int, int]]] | None = None) -> Column:
    """Does a time lie within a session, both ends included?"""
    minute = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0
    out = F.lit(False)
    for day, windows in (SESSIONS if sessions is None else sessions).items():
        for start, end in windows:
            out = out | ((F.weekday(ts) == day) & minute.between(start, end))
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def gates(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """Is each table as large as it has to be?  A table that was not counted fails."""
    wanted = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    rows = counts.sparkSession.createDataFrame([(name,) for name in least], "table_name string") if least else counts.select("table_name").limit(0)
    j = rows.join(counts, "table_name", "left")
    return j.select("table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) >= wanted[F.col("table_name")]).alias("ready"))


def latest_members(df: DataFrame, day: str) -> DataFrame:
    """Rows of the latest day on record."""
    newest = df.agg(F.max(day).alias(day))
    return df.join(F.broadcast(newest), day)


def rescans(cached: DataFrame, quotes: DataFrame, move: float = 2.0, near: float = 1.0) -> DataFrame:
    """Why a symbol is scanned again: its price moved so many percent, or is within so many percent of a level."""
    return rescan_reasons(cached.join(quotes.select("symbol", F.col("close").alias("live_price")), "symbol"), move, near)


def rescan_reasons(j: DataFrame, move: float = 2.0, near: float = 1.0) -> DataFrame:
    """``rescans`` of rows that hold their ``live_price`` already."""
    far = 100 * F.abs(F.col("live_price") / F.col("price") - 1)
    reason = F.when(far >= move, "moved")
    for level in ("entry", "stop", "target"):
        reason = reason.when(100 * F.abs(F.col("live_price") / F.nullif(F.col(level), F.lit(0.0)) - 1) <= near, level)
    return j.withColumn("reason", reason).filter("reason IS NOT NULL")
