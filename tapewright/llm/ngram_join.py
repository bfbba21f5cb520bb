"""Documents linked by the Jaccard similarity of their n-grams, as a blocked sparse product of the incidence matrix.

The matrix has a row for each distinct text and a column for each n-gram (three words by default).  What is wanted of its product with
its own transpose are the overlaps of rows with 100 * overlap >= 90 * union; the rest is never made.

Column blocks.  Rows x and y link only if they differ in at most (1 - t) / (1 + t) * (|x| + |y|) columns.  Columns are
cut, by hash, into one block more than the largest such number for the sizes at hand, so linked rows agree in every column of at least
one block.  A row's part of each block has a key; rows are multiplied only where a key agrees, and a pair
that agrees in no block is discarded by its sizes alone.  A key stands for some eight columns at once, so a line, passage or
word that very many documents share does not bring these together.  Sizes fall into classes, each with its number
of blocks; a row takes part in the classes of all rows that it may link to.  Where a row has no column in a block, that says
little: its key is then each of the row's keys under a second cut of the columns, for rows that agree in one block agree in a block of that cut too.

Products.  ``Incidence.overlap`` adds up the overlap of two rows over blocks of columns in ascending order, and gives a pair up as
soon as what is left cannot reach the bound.  Within a bucket every row is multiplied with the bucket's hub first; rows that stay in
different components are compared by what they have more or less than the hub, which decides exactly (see
:mod:`tapewright.llm.icws`, whose candidate and component steps serve both).  No pair of texts that reaches the threshold is lost, and no
bucket is expanded into all its pairs.

Defined results: null texts are empty; empty texts and texts without words have no n-gram and no link, so each row is its
own component; a text with fewer words is one n-gram; equal sets link; component_id is the smallest doc_id
of the component, null only where no member has one; repeated rows are rows of one component; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import salt_of
from tapewright.llm.icws import linked_classes
from tapewright.llm.word_hash import A, B, C, hashed_runs, mix

WIDTH = 3
#: Link where 100 * overlap >= PERCENT * union.
PERCENT = 90
#: The largest size of a class over its smallest.
GROWTH = 1.3
#: Columns added up before a pair's bound is tested again.
BLOCK = 256


def folded_words(text: str | None) -> np.ndarray:
    """A hash of each run of other than ASCII white space, with A-Z lower-cased, in order."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes + np.uint32(32) * ((codes >= 65) & (codes <= 90)).astype(np.uint32)
    return hashed_runs(codes, ~((codes == 32) | (codes >= 9) & (codes <= 13)))


def ngrams(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words; of all the words where there are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * A + words[k : k + len(out)]
    return np.unique(mix(out))


class Incidence:
    """Rows of the matrix, their block keys and their products."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent

    def weighted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        x = ngrams(folded_words(text), self.width)
        return x, np.ones(len(x))

    def most_differing(self, total: int) -> int:
        """In how many columns linked rows of ``total`` n-grams together can differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    @cache
    def classes(self, size: int) -> tuple[tuple[int, int], ...]:
        """(number, blocks) of the size classes whose rows a row of this size may link to.  Class c serves the pairs whose smaller row
        has ``low`` to ``high`` columns."""
        found, low, number = [], 1, 0
        while low <= size:
            high = max(low, int(low * GROWTH))
            largest = 100 * high // self.percent  # no larger row links to one of ``high`` columns
            if size <= largest:
                found.append((number, self.most_differing(high + largest) + 1))
            low, number = high + 1, number + 1
        return tuple(found)

    def bands(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        keys = []
        for number, blocks in self.classes(len(x)):
            first = self._blocks(x, blocks, A ^ np.uint64(number))
            empty = np.flatnonzero(first == 0)
            keys.append(first[first != 0])
            if len(empty):
                second = self._blocks(x, blocks, B ^ np.uint64(number))
                with np.errstate(over="ignore"):
                    keys.append(mix((empty.astype(np.uint64) * C)[:, None] + mix(second + np.arange(blocks, dtype=np.uint64) * A)[None, :] + np.uint64(number)).ravel())
        return np.unique(np.concatenate(keys)).view(np.int64)

    @staticmethod
    def _blocks(x: np.ndarray, blocks: int, seed: np.uint64) -> np.ndarray:
        """A key of what a row has in each block of columns; 0 where it has nothing."""
        h = mix(x ^ seed)
        at = (h % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        start = np.flatnonzero(np.diff(at[order], prepend=-1))
        out = np.zeros(blocks, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(h * B + seed)[order], start)
            place = at[order][start]
            out[place] = mix(sums + (place.astype(np.uint64) + np.uint64(1)) * C + np.uint64(blocks) * A) | np.uint64(1)
        return out

    def overlap(self, x: np.ndarray, y: np.ndarray, least: int) -> int | None:
        """How many columns two rows share; None as soon as it cannot be ``least``."""
        found = i = j = 0
        while i < len(x) and j < len(y):
            if found + min(len(x) - i, len(y) - j) < least:
                return None
            end = x[min(i + BLOCK, len(x)) - 1]
            to_i, to_j = min(i + BLOCK, len(x)), int(np.searchsorted(y, end, "right"))
            both = np.sort(np.concatenate([x[i:to_i], y[j:to_j]]), kind="stable")
            found += int((both[1:] == both[:-1]).sum())
            i, j = to_i, to_j
        return found if found >= least else None

    def linked(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
        total = len(a[0]) + len(b[0])
        # 100 * o >= percent * (total - o)
        least = -(-self.percent * total // (100 + self.percent))
        return total > 0 and self.overlap(a[0], b[0], least) is not None


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each input row."""
    rows, classes = linked_classes(docs, Incidence, (width, percent), percent / 100)
    # each (text, salt) learns its component first, so a text that very many rows share is spread
    rows = rows.withColumn("salt", salt_of("doc_id"))
    at = rows.select("k", "salt").distinct().join(classes.select("k", "class_id"), "k")
    return rows.join(at, ["k", "salt"]).select(
        "doc_id", F.col("mass").cast("long").alias("n_shingles"), F.when(F.col("mass") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
