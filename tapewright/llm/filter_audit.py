"""How five filters interact: what each removes in every order they can be applied in.

A row fails A with under 100 words, B with 100 * distinct words under 80 * words, C with 100 * capital letters
(A-Z) over 10 * code points, D with any of ``#$%&*|``, and E if its text is that of a smaller doc_id anywhere
in the table.  Words are maximal runs of other than ASCII white space, case-sensitive.

Duplicates come from a sort.  Rows are dealt by range of (fingerprint, doc_id) and sorted in each task by
fingerprint, full text and doc_id; each row is compared to its predecessor, and a run of equal texts starts where
fingerprint or text changes.  A row is a duplicate if its doc_id is larger than that of its run's head.  doc_id is
part of the range, so a text that a third of all rows share is cut over many tasks; the full text is not, so no
text reaches the driver with the sample that finds the ranges.  A run that is cut goes on in later tasks: each task
writes the heads of the runs of its first and last fingerprint beside its rows, the smallest head for each text
is found over these few, and the rows of a task's first fingerprint are compared to it again.

The five marks of a row are a mask.  Rows become counters, (part, mask) with documents, good and toxic ones; only
these are folded over the 120 orders, by a fixed table of what each mask adds to each step.

Defined results: null texts are empty; a null lang is the part ``''``, as an empty one is; rows without doc_id fail E
never and carry no label; repeated rows (of equal doc_id and text) are equal in E, for none is smaller; a document
is good or toxic if any of the labels of its doc_id says so; null labels say nothing; an empty table
has no parts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: What parts words, and the symbols of D.
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def text_mask(text: Column) -> Column:
    """The bits of A to D that a text fails."""
    words = F.array_remove(F.split(text, WHITE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    n = F.size(words)
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]
    return sum(((F.when(f, 1 << k).otherwise(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


class _Runs:
    """Runs of equal texts in a sorted partition, batch by batch."""

    def __init__(self) -> None:
        self.fingerprint = self.text = self.head = None
        self.run = -1

    def heads(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the rows' runs start in this batch (-1: before it), the number of each row's run, and their doc_ids' order."""
        fingerprint, text = batch.column("fingerprint"), batch.column("text")
        n = batch.num_rows
        new = np.ones(n, bool)
        if n > 1:
            same = fingerprint.to_numpy()[1:] == fingerprint.to_numpy()[:-1]
            at = np.flatnonzero(same)  # texts are compared only where fingerprints are equal
            equal = pc.equal(text.take(pa.array(at + 1)), text.take(pa.array(at))).to_numpy(zero_copy_only=False)
            new[at[equal] + 1] = False
        if self.run >= 0:
            new[0] = fingerprint[0].as_py() != self.fingerprint or text[0].as_py() != self.text
        starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        runs = self.run + np.cumsum(new)
        return starts, runs, new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0) with the bit of E as far as this task can tell, and the heads of the runs of the first and last
    fingerprint (kind 1)."""
    pid = TaskContext.get().partitionId()
    state, first, edges = _Runs(), None, []
    names = ["kind", "pid", "run", "fingerprint", "text", "doc_id", "part", "mask"]
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, runs, new = state.heads(batch)
        doc_id, fingerprint, text = batch.column("doc_id"), batch.column("fingerprint").to_numpy(), batch.column("text")
        if first is None:
            first = int(fingerprint[0])
        ids = doc_id.fill_null(0).to_numpy()
        known = ~doc_id.is_null().to_numpy(zero_copy_only=False)
        carried = state.head
        # nulls are last in a run, so a run without a known head has no known row
        head = np.where(starts >= 0, ids[np.maximum(starts, 0)], carried if carried is not None else 0)
        later = known & (ids > head)
        mask = batch.column("mask").to_numpy() | np.where(later, DUPLICATE, 0).astype(np.int32)
        own = np.where(fingerprint == first, runs, -1)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(runs), pa.int32()).fill_null(0), pa.array(np.full(len(runs), pid), pa.int32()), pa.array(own, pa.int64()), pa.nulls(len(runs), pa.int64()),
            pa.nulls(len(runs), pa.string()), doc_id, batch.column("part"), pa.array(mask, pa.int32()),
        ], names)
        last = int(fingerprint[-1])
        edges = [e for e in edges if e[1] in (first, last)]
        for at in np.flatnonzero(new & ((fingerprint == first) | (fingerprint == last))):
            edges.append((int(runs[at]), int(fingerprint[at]), text[int(at)].as_py(), doc_id[int(at)].as_py()))
        if starts[-1] >= 0:
            state.head = doc_id[int(starts[-1])].as_py()
        state.fingerprint, state.text, state.run = last, text[batch.num_rows - 1].as_py(), int(runs[-1])
    if edges:
        run, fingerprint, text, head = zip(*edges)
        k = len(edges)
        yield pa.RecordBatch.from_arrays([
            pa.array([1] * k, pa.int32()), pa.array([pid] * k, pa.int32()), pa.array(run, pa.int64()), pa.array(fingerprint, pa.int64()),
            pa.array(text, pa.string()), pa.array(head, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()),
        ], names)


def failure_masks(docs: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """(doc_id, part, mask), a row for each input row.  ``fingerprint`` of the column ``text`` defaults to a 64-bit hash; any other
    gives the same masks."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("fingerprint", (F.xxhash64("text") if fingerprint is None else fingerprint).cast("long"))
    ranged = own.repartitionByRange(F.col("fingerprint").asc(), F.col("doc_id").asc_nulls_last())
    ranged = ranged.sortWithinPartitions(F.col("fingerprint").asc(), F.col("text").asc(), F.col("doc_id").asc_nulls_last())
    marked = ranged.select("fingerprint", "text", "doc_id", "part", text_mask(F.col("text")).alias("mask"))
    schema = "kind int, pid int, run long, fingerprint long, text string, doc_id long, part string, mask int"
    written = cut(marked.mapInArrow(_compare, schema), "audit-rows")
    edges = written.filter("kind = 1")
    least = edges.groupBy("fingerprint", "text").agg(F.min("doc_id").alias("least"))
    # one row for each run of the first fingerprint of a task, whatever the table's size
    cut_runs = edges.join(least, ["fingerprint", "text"]).filter("least < doc_id").select("pid", "run", "least")
    rows = written.filter("kind = 0").select("pid", "run", "doc_id", "part", "mask")
    rows = rows.join(F.broadcast(cut_runs), ["pid", "run"], "left")
    late = F.when(F.col("doc_id") > F.col("least"), DUPLICATE).otherwise(0)
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(late).alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): sums that add up over any split of the table."""
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    by_doc = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("docs"))  # so no doc_id is a hot key of the join
    each = by_doc.join(told, "doc_id", "left")
    of = lambda c: F.sum(F.col("docs") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), of("good"), of("toxic"))


def order_table() -> list[tuple]:
    """(mask, filter_order, step, kept, removed, redundant, unique_fails, shapley): what a document of each mask adds to each step."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        for mask in range(1 << len(FILTERS)):
            gone = False
            for step, bit in enumerate(bits, 1):
                fails = bool(mask & bit)
                # of the orders, an equal share has each failed filter first
                share = 120 // bin(mask).count("1") if fails else 0
                rows.append((mask, order, step, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit), share))
                gone |= fails
    return rows


def audit_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    counters = part_counters(failure_masks(docs), labels)
    adds = ["kept", "removed", "redundant", "unique_fails", "shapley"]
    fixed = docs.sparkSession.createDataFrame(order_table(), "mask int, filter_order string, step int, " + ", ".join(f"add_{a} int" for a in adds))
    total = lambda n, a: F.sum(F.col(n) * F.col(f"add_{a}")).cast("long")
    return (
        counters.join(F.broadcast(fixed), "mask").groupBy("part", "filter_order", "step")
        .agg(*[total("docs", a).alias(a) for a in adds], total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"))
    )
