"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is ``weight * budget / size``; each document draws how
often it repeats by inverting the Poisson distribution of its source at a uniform number
hashed from (seed, doc_id, text).  Documents are exploded by that count and shuffled by a
hash of (document, replica).  The main path is DataFrame functions only.

Without weights, every source found in the corpus gets the same one: the hot source is thinned, others
repeat.  The only data that reach the driver are the sizes of the sources that the weights name, or
of at most ``MAX_CONSTANTS`` sources found; those become constants of the plan.  The rates of more sources
are a table, joined on (source, salt), so no source is ever gathered into one task.

Defined results: sources that given weights leave out, and null sources, keep their natural share (rate
``rest_rate``); a named source without rows or bytes adds nothing; null texts count as no
bytes; repeated rows draw the same number and so repeat alike; an empty table gives no
rows; other columns are carried along, but for ``replica`` and ``mix_key``, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import SALTS, salt_of, utf8

#: Up to so many sources, rates are constants of the plan; more are joined as a table.
MAX_CONSTANTS = 200
#: The distribution is tabled until what lies beyond is under this.
TAIL = 1e-13
#: A larger mean is the sum of equal parts of at most this mean, each drawn on its own.
MAX_TABLED = 50.0
#: Rows whose count has more parts than this draw them in blocks of so many, spread over tasks.
PARTS_AT_ONCE = 64


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the rest is negligible."""
    steps, total, k = [], 0.0, 0
    log_rate = math.log(rate) if rate > 0 else 0.0
    while rate > 0:
        total += math.exp(k * log_rate - rate - math.lgamma(k + 1))
        steps.append(total)
        if k > rate and total > 1 - TAIL or k > rate + 60 * math.sqrt(rate) + 60:
            break
        k += 1
    return steps or [1.0]


def hash_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) with 52 bits, from an MD5 of the columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float], epochs: float, most_epochs: float = math.inf) -> dict[str, float]:
    """Mean repetitions of each named source; the budget is ``epochs`` times the bytes of
    the named sources together."""
    named = source_sizes(docs.filter(F.col("source").isin(list(weights))))
    return rates_of({r["source"]: r["bytes"] for r in named.collect()}, weights, epochs, most_epochs)


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.octet_length(utf8(F.col("text"))).cast("long")).alias("bytes"))


def rates_of(sizes: dict[str, int], weights: dict[str, float], epochs: float, most_epochs: float = math.inf) -> dict[str, float]:
    budget, weight = epochs * sum(sizes.values()), sum(w for s, w in weights.items() if sizes.get(s))
    return {s: min(weights[s] / weight * budget / n, most_epochs) for s, n in sizes.items() if n and weight > 0}


def step_table(sizes: DataFrame, epochs: float, most_epochs: float = math.inf) -> DataFrame:
    """(source, parts, steps) of every source at the same weight: :func:`poisson_steps` of rate / parts, as columns."""
    sizes = sizes.filter("bytes > 0")
    total, n = sizes.agg(F.sum("bytes"), F.count("*")).first()
    rate = F.least(F.lit(epochs * (total or 0) / max(n, 1)) / F.col("bytes"), F.lit(most_epochs))
    table = sizes.withColumn("parts", F.greatest(F.lit(1), F.ceil(rate / MAX_TABLED)).cast("int")).withColumn("mean", rate / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + p)).alias("steps"))

    return table.select("source", "parts", F.aggregate(F.sequence(F.lit(1), last), first, step)["steps"].alias("steps"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7, rest_rate: float = 1.0,
    replica: str = "replica", mix_key: str = "mix_key", most_epochs: float = math.inf,
) -> DataFrame:
    """``docs`` with each row repeated by its count, plus ``replica`` (from 0) and ``mix_key``
    (its place in the global shuffle: rows are dealt to partitions and sorted by it), which replace columns of these
    names; all other columns are kept.  ``most_epochs`` bounds the mean repetitions of a source; without it a tiny source beside a huge
    one repeats as often as its weight asks for."""
    if weights is not None and not (all(w >= 0 and math.isfinite(w) for w in weights.values()) and any(weights.values())):
        raise ValueError("weights must be finite, not negative, and not all zero")
    own = "__"  # of helper columns: a prefix that no column of the table has
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    steps_by_source = None
    if weights is None:
        found = source_sizes(docs)
        some = found.limit(MAX_CONSTANTS + 1).collect()
        if len(some) > MAX_CONSTANTS:
            rates, steps_by_source = {}, step_table(found, epochs, most_epochs)
        else:
            sizes = {r["source"]: r["bytes"] for r in some}
            rates = rates_of(sizes, dict.fromkeys(sizes, 1 / max(sum(n > 0 for n in sizes.values()), 1)), epochs, most_epochs)
    else:
        rates = source_rates(docs, weights, epochs, most_epochs)
    key = (F.col("doc_id"), F.md5(utf8(F.col("text"))))
    draw = hash_unit(seed, *key)

    def below(steps: Column, parts: Column) -> Column:
        one = F.size(F.filter(steps, lambda s: s <= F.col(own + "draw")))
        many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + F.size(F.filter(steps, lambda s: s <= hash_unit(seed, i, *key))))
        return F.when(parts == 1, one).otherwise(many)

    def steps_below(rate: float) -> Column:
        """The inverse: how many steps of the source's distribution lie at or below the draw."""
        parts = max(1, math.ceil(rate / MAX_TABLED))
        steps = F.array(*[F.lit(s) for s in poisson_steps(rate / parts)])
        if parts == 1:
            return F.size(F.filter(steps, lambda s: s <= F.col(own + "draw")))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(parts)), F.lit(0),
            lambda n, i: n + F.size(F.filter(steps, lambda s: s <= hash_unit(seed, i, *key))),
        )

    count = F.lit(None).cast("int")
    for source, rate in sorted(rates.items()):
        count = F.when(F.col("source") == source, steps_below(rate)).otherwise(count)
    count = F.coalesce(count, steps_below(rest_rate) if rest_rate != 1.0 else F.lit(1))
    kept = [c for c in docs.columns if c.lower() not in (replica.lower(), mix_key.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(own + "draw", draw)
    if steps_by_source is not None:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        table = steps_by_source.select(F.col("source").alias(own + "source"), salts.alias(own + "salt_of"), F.col("parts").alias(own + "parts"), F.col("steps").alias(own + "steps"))
        rows = rows.withColumn(own + "salt", salt_of(F.col(own + "draw")))
        rows = rows.join(table, (F.col("source") == F.col(own + "source")) & (F.col(own + "salt") == F.col(own + "salt_of")), "left").drop(own + "source", own + "salt", own + "salt_of")
        count = F.coalesce(F.when(F.col(own + "parts").isNotNull(), below(F.col(own + "steps"), F.col(own + "parts"))), count)
    many = {s: max(1, math.ceil(r / MAX_TABLED)) for s, r in rates.items()}
    many = {s: n for s, n in many.items() if n > PARTS_AT_ONCE}
    often = F.lit(False)
    if steps_by_source is not None:
        most = steps_by_source.agg(F.max("parts")).first()[0] or 0
        often = F.coalesce(F.col(own + "parts") > PARTS_AT_ONCE, F.lit(False)) if most > PARTS_AT_ONCE else often
    elif many:
        often = F.coalesce(F.col("source").isin(list(many)), F.lit(False))
    in_blocks = bool(many) or steps_by_source is not None and most > PARTS_AT_ONCE
    counted = (rows.filter(~often) if in_blocks else rows).withColumn(own + "count", count).filter(F.col(own + "count") > 0)
    out = counted.withColumn(replica, F.explode(F.sequence(F.lit(0), F.col(own + "count") - 1))).drop(own + "parts", own + "steps", own + "count")
    if in_blocks:
        out = out.unionByName(_in_blocks(rows.filter(often), rates, many, seed, key, replica, own))
    place = F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), F.col(own + "draw").cast("string"), F.col("doc_id").cast("string"), F.col(replica).cast("string")))
    out = out.withColumn(mix_key, place).drop(own + "draw")
    return out.repartition(F.col(mix_key)).sortWithinPartitions(mix_key)


def _in_blocks(rows: DataFrame, rates: dict[str, float], many: dict[str, int], seed: int, key: tuple[Column, Column], replica: str, own: str) -> DataFrame:
    """Rows with very many parts, repeated: each (row, block of parts) draws in some task, and replicas go on where those of the blocks before end.
    No row makes more of them at once than a block's."""
    if not many:
        parts, steps = F.col(own + "parts"), F.col(own + "steps")
    else:
        parts, steps = F.lit(None).cast("int"), F.lit(None).cast("array<double>")
        for source, n in sorted(many.items()):
            parts = F.when(F.col("source") == source, n).otherwise(parts)
            steps = F.when(F.col("source") == source, F.array(*[F.lit(s) for s in poisson_steps(rates[source] / n)])).otherwise(steps)
    row, block, first = own + "row", own + "block", own + "first"
    of_row = rows.withColumns({row: F.monotonically_increasing_id(), own + "parts": parts, own + "steps": steps})
    blocks = of_row.withColumn(block, F.explode(F.sequence(F.lit(0), F.ceil(F.col(own + "parts") / PARTS_AT_ONCE).cast("int") - 1)))
    blocks = blocks.repartition(F.col(row), F.col(block))
    ids = F.sequence(F.col(block) * PARTS_AT_ONCE + 1, F.least(F.col(own + "parts"), (F.col(block) + 1) * PARTS_AT_ONCE))
    drawn = F.aggregate(ids, F.lit(0), lambda n, i: n + F.size(F.filter(own + "steps", lambda s: s <= hash_unit(seed, i, *key))))
    before = Window.partitionBy(row).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    small = blocks.withColumn(own + "count", drawn).drop(own + "steps", own + "parts").withColumn(first, F.coalesce(F.sum(own + "count").over(before), F.lit(0)))
    spread = small.filter(F.col(own + "count") > 0).repartition(F.col(row), F.col(block))
    each = F.explode(F.sequence(F.col(first), F.col(first) + F.col(own + "count") - 1))
    return spread.withColumn(replica, each).withColumn(replica, F.col(replica).cast("int")).drop(row, block, first, own + "count")
