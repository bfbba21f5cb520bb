"""Vector bin packing of documents into training shards.

Bytes, tokens and rows are balanced jointly.  The unit of placement is a group of equal
texts.  Units go, largest first, to the shard whose residual capacity has the highest dot
product with the unit's own (bytes, tokens, rows) vector, all as shares of the totals.

How the greedy order scales: only units above ``1 / (shards * FINE)`` of some total can
unbalance a shard by themselves, and there are fewer than ``3 * shards * FINE`` of those
whatever the input (24,000 rows of five numbers for 8 shards, 3 million for 1,024); one task places them.  The small units are dealt by hash into cells;
every cell is packed by its own task against its share of what the large units left free.

Defined results: a null text has no bytes and groups with the empty text; rows with a null
``doc_id`` are placed like others; fully repeated rows stay in one group and get slots of
their own; an empty table gives no rows; other columns of the input are ignored.  Groups stay whole but for those
with more than ``1 / shards`` of the bytes, tokens or rows: no shard could take such a group and stay level, so
it is split by a hash of doc_id (of the row where that is null) into up to 64 pieces, whose number is in ``piece``;
``piece`` is null for groups that stay whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapewright.llm.common import SALTS, cut, salt_of, text_key, utf8

#: A unit is large if it has more than 1 / (shards * FINE) of the bytes, tokens or rows.
FINE = 1000
#: Small units that one task packs.
CELL_UNITS = 20_000
#: Rows that one task numbers.
SLOT_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"
DIMS = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, room: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shard of each vector (rows of ``vectors``, already in placing order): the one whose
    ``room`` has the highest dot product with it.  ``room`` (shards x dims) is used up;
    ``turn`` says which shard wins ties."""
    n = len(room)
    order = np.roll(np.arange(n), -turn)
    left = room[order].copy()
    picked = np.empty(len(vectors), dtype=np.int64)
    for i, v in enumerate(vectors):
        j = int(np.argmax(left @ v))
        left[j] -= v
        picked[i] = j
    room[order] = left
    return order[picked]


def _pack(pdf: pd.DataFrame, totals: list[float], shares: np.ndarray, turn: int) -> pd.DataFrame:
    """``shares``: what each shard may still take, as shares of what this call places."""
    v = pdf[list(DIMS)].to_numpy(float) / np.maximum(np.array(totals), 1.0)
    first = np.lexsort((pdf["piece"].to_numpy(), pdf["k"].to_numpy().astype("S16"), -v.max(axis=1)))
    room = shares * v.sum(axis=0)
    out = pdf[["k", "piece", *DIMS]].iloc[first].copy()
    out["shard"] = place(v[first], room, turn).astype("int32")
    return out


def plan_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens, piece), one row for each
    input row.  ``law`` is ``bytes``: shards hold nearly the same number of bytes."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = cut(
        docs.select("doc_id", "text").select(
            "doc_id",
            (F.octet_length(utf8(text)).cast("long") + 1).alias("size"),
            F.crc32(utf8(text)).alias("text_crc32"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("tokens"),
            text_key(text).alias("k"),
            # of the row, for rows of one doc_id and text may be many; written once with the rows
            salt_of(F.monotonically_increasing_id()).alias("salt"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    totals = [float(x or 0) for x in total]
    sums = (F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    pieces = rows.groupBy("k", "salt").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    )
    groups = pieces.groupBy("k").agg(*sums)

    def share_over(limit: float):
        return F.greatest(*(F.col(d) / max(t, 1.0) for d, t in zip(DIMS, totals))) > limit

    # at most 3 * n_shards groups can be that large
    heavy = groups.filter(share_over(1 / n_shards)).select("k")
    units = cut(
        groups.join(F.broadcast(heavy), "k", "left_anti").select("k", F.lit(-1).alias("piece"), *DIMS)
        .unionByName(pieces.join(F.broadcast(heavy), "k", "left_semi").select("k", F.col("salt").alias("piece"), *DIMS)),
        "shard-units",
    )
    is_large = share_over(1 / (n_shards * FINE))
    kinds = {r["large"]: r for r in units.groupBy(is_large.alias("large")).agg(F.count("*").alias("n"), *sums).collect()}
    even = np.full((n_shards, len(DIMS)), 1.0 / n_shards)
    schema = f"k binary, piece int, {', '.join(f'{d} long' for d in DIMS)}, shard int"
    loads = np.zeros((n_shards, len(DIMS)))
    placed = []
    if True in kinds:
        large = cut(
            units.filter(is_large).withColumn("cell", F.lit(0)).groupBy("cell").applyInPandas(lambda pdf: _pack(pdf, totals, even, 0), schema),
            "shard-large",
        )
        for r in large.groupBy("shard").agg(*sums).collect():  # a row for each shard
            loads[r["shard"]] = [r[d] for d in DIMS]
        placed.append(large)
    if False in kinds:
        small = np.array([float(kinds[False][d] or 0) for d in DIMS])
        n_cells = max(1, -(-kinds[False]["n"] // CELL_UNITS))
        shares = (np.array(totals) / n_shards - loads) / np.maximum(small, 1.0)
        placed.append(
            units.filter(~is_large)
            .withColumn("cell", F.pmod(F.xxhash64("k", F.lit(17)), F.lit(n_cells)).cast("int"))
            .groupBy("cell")
            .applyInPandas(lambda key, pdf: _pack(pdf, totals, shares, int(key[0]) % n_shards), schema)
        )
    if not placed:
        placed = [spark.createDataFrame([], schema)]
    where = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    where = cut(where.select("k", "piece", "shard"), "shard-where")
    # every (text, salt) learns its shard first: at most SALTS rows for a text, so no text is hot
    at = pieces.select("k", "salt").join(where, "k").filter("piece = -1 or piece = salt").select("k", "salt", "shard", "piece")
    n_buckets = max(32, -(-int(totals[2]) // SLOT_ROWS))
    dealt = rows.join(at, ["k", "salt"]).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "k", "salt", F.lit(29)), F.lit(n_buckets)).cast("int")
    )
    # slots: rows are numbered within (shard, bucket), and buckets start where the one before ends
    dealt = cut(dealt.drop("salt"), "shard-dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "k")
    return (
        dealt.withColumn("rank", F.row_number().over(own))
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "tokens", F.when(F.col("piece") >= 0, F.col("piece")).alias("piece"),
        )
    )
