"""Prefix folds along a key: values that depend on the value before, without a task that holds the key's history.

A step is a function of the value before, written so that two steps in a row are one step of the same form:
an affine map (a, b) for ``y = a * y' + b``, or for a finite set of states the list of where each of them goes.  The
history of a key is cut into blocks of ``BLOCK`` rows.  Blocks are reduced to one step each, the few steps of a key give
every block the value it starts from, and each block is then run through by itself.  All of it are built-in functions
over arrays; a row of the plan holds one block, or one step for each block of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 64


def prefix_fold(
    df: DataFrame, step: Column, start: Column, compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column],
    name: str, key: str = "symbol", order: str = "bar_ix", block: int = BLOCK,
) -> DataFrame:
    """Adds the value after each row: ``apply(value before, step)``, from ``start`` on.  ``compose(f, g)`` is first f, then g.
    Order values are unique within a key; a null order comes first; every row keeps all its columns."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(order))
    cells = F.struct(*[F.col(c) for c in df.columns])
    own = df.select(F.col(key).alias("__key"), row.alias("__row"), step.alias("__step"), cells.alias("__cells"))
    one = F.struct(F.col("__row").alias("row"), F.col("__step").alias("step"), F.col("__cells").alias("cells"))
    at = F.floor((F.col("__row") - 1) / block).cast("int").alias("__block")
    blocks = own.groupBy("__key", at).agg(F.sort_array(F.collect_list(one)).alias("__steps"))
    first = F.element_at("__steps", 1)["step"]
    rest = F.slice("__steps", 2, block)
    total = F.aggregate(rest, first, lambda f, s: compose(f, s["step"]))
    totals = blocks.select("__key", F.struct(F.col("__block").alias("block"), total.alias("total")).alias("t"))
    of_key = totals.groupBy("__key").agg(F.sort_array(F.collect_list("t")).alias("t"))
    value, kind = F.col("__from"), own.select(start.alias("v")).schema["v"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    entry = F.aggregate(
        "t", F.struct(start.cast(kind).alias("now"), none.alias("out")),
        lambda a, t: F.struct(apply(a["now"], t["total"]).cast(kind).alias("now"), F.array_append(a["out"], a["now"]).alias("out")),
    )["out"]
    starts = of_key.select("__key", F.posexplode(entry).alias("__block", "__from"))
    run = F.aggregate(
        "__steps", F.struct(value.cast(kind).alias("now"), none.alias("out")),
        lambda a, s: F.struct(apply(a["now"], s["step"]).cast(kind).alias("now"), F.array_append(a["out"], apply(a["now"], s["step"]).cast(kind)).alias("out")),
    )["out"]
    joined = blocks.join(starts, blocks["__key"].eqNullSafe(starts["__key"]) & (blocks["__block"] == starts["__block"])).select("__steps", "__from")
    long = joined.select(F.explode(F.arrays_zip(F.col("__steps").alias("s"), run.alias("v"))).alias("z"))
    return long.select("z.s.cells.*", F.col("z.v").alias(name))


def affine(df: DataFrame, maps: dict[str, tuple[Column, Column]], key: str = "symbol", order: str = "bar_ix", block: int = BLOCK) -> DataFrame:
    """Adds each ``y = a * y' + b`` (started from 0), for maps by name."""
    step = F.array(*[F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")) for a, b in maps.values()])
    start = F.array(*[F.lit(0.0)] * len(maps))
    then = lambda f, g: F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"))
    out = prefix_fold(
        df, step, start, lambda f, g: F.zip_with(f, g, then), lambda y, s: F.zip_with(y, s, lambda v, m: m["a"] * v + m["b"]), "__y", key, order, block
    )
    return out.select(*df.columns, *[F.col("__y")[i].alias(n) for i, n in enumerate(maps)])


def ewma_maps(values: dict[str, tuple[Column, float]], key: str = "symbol", order: str = "bar_ix") -> tuple[dict, dict]:
    """Maps of ``y' + alpha (x - y')`` that skip null values and carry what was there, started by the first value; and how
    many values were seen so far, by name."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    maps, seen = {}, {}
    for name, (x, alpha) in values.items():
        seen[name] = n = F.count(x).over(so_far)
        first = x.isNotNull() & (n == 1)
        maps[name] = (F.when(x.isNull(), 1.0).when(first, 0.0).otherwise(1 - alpha), F.when(x.isNull(), 0.0).when(first, x).otherwise(alpha * x))
    return maps, seen


def ewma(df: DataFrame, values: dict[str, tuple[Column, float]], least: int = 1, key: str = "symbol", order: str = "bar_ix", block: int = BLOCK) -> DataFrame:
    """Adds exponential means by name -> (values, alpha): null values are skipped and the mean is carried over them; null until
    ``least`` values were seen."""
    maps, seen = ewma_maps(values, key, order)
    counted = df.withColumns({f"__n_{n}": c for n, c in seen.items()} | {f"__{k}_{n}": m for n, ab in maps.items() for k, m in zip("ab", ab)})
    out = affine(counted, {n: (F.col(f"__a_{n}"), F.col(f"__b_{n}")) for n in maps}, key, order, block)
    return out.select(*df.columns, *[F.when(F.col(f"__n_{n}") >= least, F.col(n)).alias(n) for n in maps])


def automaton(df: DataFrame, goes_to: Column, start: int, name: str, key: str = "symbol", order: str = "bar_ix", block: int = BLOCK) -> DataFrame:
    """Adds the state after each row of a finite automaton: ``goes_to`` is an array that says where this row sends each state."""
    return prefix_fold(
        df, goes_to.cast("array<int>"), F.lit(start).cast("int"), lambda f, g: F.transform(f, lambda s: F.get(g, s)), lambda s, f: F.get(f, s), name, key, order, block
    )
