"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``MIN_MATCH`` words (a seed) are tiled:
the longest match of words that neither side has used yet is marked, again and again, down
to ``MIN_MATCH`` words.  Matches are found by running Karp-Rabin hashes over the unmarked
runs and compared word by word.  The share of the item's words under tiles is its coverage;
since tiles need not keep their order, a passage cut up and put together anew is still
covered.  Items with fewer than ``MIN_MATCH`` words form one seed of their whole length.

Plan: a benchmark of ``BLOCK_BYTES`` at most, by its measured size, goes to the tasks whole, so a document never
moves.  A larger one is joined to the documents by the hashes of seeds, and pairs that share one are tiled; nothing
but keys is shuffled before, and both ways find the same leaks.

Defined results: null and empty texts match nothing; items without words are ignored;
repeated documents are reported each; repeated items (the same item_id and words) once;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import column_or_null, cut, unused, utf8
from tapewright.llm.word_hash import word_hashes

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20
#: Seeds that are handed on at once.
SEEDS = 1 << 18
WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LEAKS = "doc_id long, item_id long, coverage double, covered_words int, item_words int, n_tiles int, first_word int"
_NAMES = [x.split()[0] for x in LEAKS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` word ids, mod 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * _BASE + mixed[k : k + n]
    return out


class ItemIndex:
    """Items: their words as ids, and the seeds of all of them, sorted."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        seen = set()
        hashes, owners, widths = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if not words or (item_id, *words) in seen:
                continue
            seen.add((item_id, *words))
            own = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64)
            h = window_hashes(own, min(MIN_MATCH, len(own)))
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            widths.append(np.full(len(h), min(MIN_MATCH, len(own))))
            self.items.append((item_id, own))
        self.seeds = {}
        if self.items:
            hashes, owners, widths = map(np.concatenate, (hashes, owners, widths))
            for width in np.unique(widths):
                at = widths == width
                order = np.argsort(hashes[at], kind="stable")
                self.seeds[int(width)] = (hashes[at][order], owners[at][order])

    def doc_ids(self, words: list[str]) -> np.ndarray:
        """Word ids; words that no item has are -1."""
        get = self.ids.get
        return np.array([get(w, -1) for w in words], np.int64)

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items that share a seed with the document."""
        found = set()
        for width, (hashes, owners) in self.seeds.items():
            known = ids >= 0
            if width > 1 and len(known) >= width:  # a seed has no unknown word
                runs = np.convolve(known, np.ones(width, int), "valid") == width
            else:
                runs = known
            starts = np.flatnonzero(runs[: max(0, len(ids) - width + 1)])
            if not len(starts):
                continue
            h = np.unique(window_hashes(ids, width)[starts])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, b in zip(lo[hi > lo], hi[hi > lo]):
                found.update(owners[a:b].tolist())
        return sorted(found)


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, length), longest first; among equally long
    ones the first in the item, then in the document."""
    min_match = min(min_match, len(item))
    in_item = np.isin(doc, item)
    spots = np.flatnonzero(in_item)
    if not len(spots):
        return []
    # only runs of shared words matter: keep them, with one stop word between runs
    gaps = np.flatnonzero(np.diff(spots) > 1) + 1
    parts, places = [], []
    for run in np.split(spots, gaps):
        if len(run) >= min_match:
            parts += [doc[run], np.array([-1])]
            places += [run, np.array([-1])]
    if not parts:
        return []
    words, at = np.concatenate(parts), np.concatenate(places)
    free_item, free_doc = np.ones(len(item), bool), words >= 0
    tiles: list[tuple[int, int, int]] = []
    high = len(item)
    while high >= min_match:
        low, width = min_match, 0
        while low <= high:  # a match of n words holds matches of fewer
            middle = (low + high + 1) // 2
            if _meet(item, words, free_item, free_doc, middle):
                low, width = middle + 1, middle
            else:
                high = middle - 1
        if not width:
            break
        tiles += [(i, int(at[j]), width) for i, j in _mark(item, words, free_item, free_doc, width)]
        high = width - 1
    return tiles


def _runs(ids: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the unmarked runs of ``width`` words and their hashes, by hash and then by place."""
    if len(ids) < width:
        return np.empty(0, int), np.empty(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[width:] == taken[:-width])
    hashes = window_hashes(ids, width)[starts]
    order = np.argsort(hashes, kind="stable")
    return starts[order], hashes[order]


def _meet(item, words, free_item, free_doc, width: int) -> bool:
    """Whether an unmarked run of ``width`` words is shared."""
    a, ha = _runs(item, free_item, width)
    b, hb = _runs(words, free_doc, width)
    for h in np.intersect1d(ha, hb):
        same = lambda starts, hashes: starts[np.searchsorted(hashes, h, "left") : np.searchsorted(hashes, h, "right")]
        i = same(a, ha)[0]
        if any(np.array_equal(item[i : i + width], words[j : j + width]) for j in same(b, hb)):
            return True
    return False


def _mark(item, words, free_item, free_doc, width: int) -> list[tuple[int, int]]:
    """Mark matches of ``width`` words, each run of the item with its first unmarked place in the document.  A place
    once taken stays so, so each hash goes through its places once however often a run is repeated."""
    a, ha = _runs(item, free_item, width)
    b, hb = _runs(words, free_doc, width)
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    nearest = dict(zip(lo.tolist(), lo.tolist()))  # by group of equal hashes: its first place that may be unmarked
    found = []
    for k in np.argsort(a):
        i, x, y = int(a[k]), int(lo[k]), int(hi[k])
        if x == y or not free_item[i : i + width].all():
            continue
        while nearest[x] < y and not free_doc[b[nearest[x]] : b[nearest[x]] + width].all():
            nearest[x] += 1
        for j in b[nearest[x] : y].tolist():
            if free_doc[j : j + width].all() and np.array_equal(item[i : i + width], words[j : j + width]):
                free_item[i : i + width] = free_doc[j : j + width] = False
                found.append((i, j))
                break
    return found


def leaks_in(index: ItemIndex, text: str | None, coverage: float) -> list[tuple]:
    """(item_id, coverage, covered words, item words, tiles, first word) of the items that a
    text covers far enough."""
    ids = index.doc_ids(words_of(text))
    found = []
    for k in index.candidates(ids) if len(ids) else ():
        item_id, item = index.items[k]
        tiles = greedy_tiles(item, ids)
        covered = sum(t[2] for t in tiles)
        if tiles and covered >= coverage * len(item):
            found.append((item_id, covered / len(item), covered, len(item), len(tiles), min(t[1] for t in tiles)))
    return found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()


def _fits(benchmark: DataFrame, block_bytes: int) -> list[tuple[int, str]] | None:
    """The items, if they have ``block_bytes`` at most."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length(utf8(F.col("text"))).cast("long") + 16)).first()[0] or 0
    return [(r[0], r[1]) for r in items.collect()] if size <= block_bytes else None


def _scan(docs: DataFrame, block, coverage: float, columns: list[str], schema: str, whole: bool) -> DataFrame:
    """One pass of a block over ``docs``: its leaks or, with ``whole``, the rows without any."""
    items = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [leaks_in(index, t, coverage) for t in texts]
            if whole:
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))
                continue
            rows = [(d, *f) for d, fs in zip(batch.column("doc_id").to_pylist(), found) for f in fs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    return docs.select(*columns).mapInArrow(scan, schema)


def _shuffled(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """Leaks of ``docs`` (row, doc_id, text) as (row, doc_id, ...), by a join on the hashes of seeds: neither table is sent
    whole, and only documents that share a seed with an item meet it."""
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([" ".join(words_of(t)) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), text], ["item_id", "text"])

    items = _items(benchmark).mapInArrow(plain, "item_id long, text string").filter("text <> ''").distinct()
    items = cut(items.withColumn("item", F.monotonically_increasing_id()), "decontam-items")

    def seeds_of(key: str, widths: list[int] | None):
        def together(keys, sizes, seeds, width):
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, sizes)), pa.array(np.repeat(np.array(width, np.int32), sizes)), pa.array(np.concatenate(seeds))], [key, "width", "seed"])

        def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sizes, found, width, total = [], [], [], [], 0
            for batch in batches:
                for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                    h = word_hashes(text)
                    for w in ([min(MIN_MATCH, len(h))] if len(h) else []) if widths is None else widths:
                        found.append(np.unique(window_hashes(h, w)).view(np.int64))
                        keys.append(k)
                        sizes.append(len(found[-1]))
                        width.append(w)
                        total += sizes[-1]
                    if total > SEEDS:
                        yield together(keys, sizes, found, width)
                        keys, sizes, found, width, total = [], [], [], [], 0
            if keys:
                yield together(keys, sizes, found, width)

        return seeds

    own = cut(items.select("item", "text").mapInArrow(seeds_of("item", None), "item long, width int, seed long"), "decontam-seeds")
    widths = sorted(r[0] for r in own.select("width").distinct().collect())  # MIN_MATCH at most
    of_docs = docs.select("row", "text").mapInArrow(seeds_of("row", widths), "row long, width int, seed long")
    pairs = of_docs.join(own, ["width", "seed"]).select("row", "item").distinct()
    met = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(docs, "row")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "text", "item_id", "item_text")]
            rows = [(row, doc, *f) for row, doc, text, item, words in zip(*columns) for f in leaks_in(ItemIndex([(item, words)]), text, coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), *_KINDS))], ["row", *_NAMES])

    return met.select("row", "doc_id", "text", "item_id", "item_text").mapInArrow(tile, "row long, " + LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item whose coverage reaches the threshold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    items = _fits(benchmark, block_bytes)
    if items is not None:
        return _scan(docs, items, coverage, ["doc_id", "text"], LEAKS, whole=False)
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    return _shuffled(docs, benchmark, coverage).drop("row")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    items = _fits(benchmark, block_bytes)
    if items is not None:
        return _scan(docs, items, coverage, [f"`{c}`" for c in docs.columns], docs.schema, whole=True)
    row = unused("row", docs.columns)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
    plain = numbered.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    leaks = _shuffled(plain, benchmark, coverage).select(F.col("row").alias(row)).distinct()
    return numbered.join(leaks, row, "left_anti").drop(row)
