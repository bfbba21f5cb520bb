"""Quality scores by Bradley-Terry ranking of document pairs.

A good document is preferred to a bad one.  The chance of a preference is the logistic
function of the difference of the two scores, each a linear function of the text's
features, so the fit is logistic loss on feature differences.  The cut between good and bad
is the quantile of the training scores at the share of bad labels; the score returned is a
monotone map of the rank score that passes ``CUT`` there.

Every labelled document outside the held-out fold is used, for knots, scales, weights and cut alike.
Texts are measured once, where they lie, and only their features are kept.  Training documents are dealt by a hash of
doc_id into blocks of both labels, and within a block every good one meets every bad one; blocks weigh the same.
A Newton step adds up one gradient and one Hessian over all blocks, so the driver holds a few thousand numbers
however many labels there are.  Sums are of multiples of a small power of two, so they do not depend on the partitions.

Defined results: null and empty texts get the features of an empty text; repeated and
conflicting labels of a document are averaged; without labels of both kinds every score is
the share of good labels (a half without any); a null doc_id is held out if crc32 of the empty text
says so; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.llm.common import cut
from tapewright.llm.fertility import base_figures

CUT = 0.3
RIDGE = 1e-3
FEATURES = 16
#: Knots of a feature, at these shares of its values, which are cut to 10 bits behind the first.
SHARES = (0.1, 0.5, 0.9, 0.98)
SPARE_BITS = 42
#: Least mean number of documents of a label in a block, where the table has as many.
BLOCK = 128
#: Steps of the numbers that are summed; sums of them are exact up to 2^53 steps.
GRAIN = 2.0**-24
#: Bins of a pass that looks for a rank among the scores, and scores that are sorted at once.
BINS, AT_ONCE = 4096, 4096
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_STOP = re.compile(r"[.!?…]")


def features(text: str | None) -> np.ndarray:
    """Shape of a text, independent of its language."""
    text = text or ""
    n_words, chars, symbols, dup_lines, repeats = base_figures(text)
    if not n_words:
        return np.zeros(FEATURES)
    words = text.split() or [text]
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    twins = sum(a == b for a, b in zip(words, words[1:]))
    letters, upper = len(_LETTER.findall(text)), len(_UPPER.findall(text))
    return np.array([
        np.log1p(n_words), np.log1p(chars / n_words), lengths.std(), symbols / chars * 10, text.count("!") / n_words,
        text.count("|") / n_words, letters / chars, upper / max(letters, 1) * 2, sum(map(str.isdigit, text)) / chars * 5,
        dup_lines / max(len(lines), 1), repeats / n_words, len(counts) / n_words, max(counts.values()) / n_words,
        twins / n_words, np.log1p(n_words / max(len(lines), 1)), len(_STOP.findall(text)) / n_words,
    ])


def expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature, and how far it lies above each of its knots: piecewise linear scores."""
    hinges = np.maximum(x[:, None, :] - knots[None, :, :], 0.0).reshape(len(x), -1)
    return np.hstack([x, hinges])


def pair_terms(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean gradient and Hessian of the logistic loss of every good row over every bad one, without their differences."""
    p = 1.0 / (1.0 + np.exp(-np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
    lost, curve, n = 1.0 - p, p * (1.0 - p) + 1e-6, p.size
    cross = good.T @ curve @ bad
    hess = (good * curve.sum(1)[:, None]).T @ good + (bad * curve.sum(0)[:, None]).T @ bad - cross - cross.T
    return (lost.sum(0) @ bad - lost.sum(1) @ good) / n, hess / n


def newton(terms: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights at which the gradient of the loss with its ridge is zero."""
    w = np.zeros(width)
    for _ in range(25):
        grad, hess = terms(w)
        step = np.linalg.solve(hess + ridge * np.eye(width), grad + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the logistic loss of good over bad, over all pairs of one block."""
    return newton(lambda w: pair_terms(good, bad, w), good.shape[1], ridge)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


class RankModel:
    """Knots, scale, weights, the cut and the slope of the map to (0, 1)."""

    def __init__(self, knots: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.knots, self.mean, self.scale = knots, mean, scale
        self.weights, self.cut, self.slope = np.zeros(len(mean)), 0.0, 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        return (expand(x, self.knots) - self.mean) / self.scale

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.expand(x) @ self.weights, 9)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.rank(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """(doc_id, y) of every document with a label in the training fold."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("l"))
        .filter(F.col("doc_id").isNotNull() & F.col("l").isNotNull() & train)
        .groupBy("doc_id").agg((F.avg("l") >= 0.5).cast("int").alias("y"))
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row, written once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(own.mapInArrow(measure, "doc_id long, x array<double>"), "rank-features")


def knots_of(rows: DataFrame) -> np.ndarray:
    """A row of knots for each of SHARES.  Values are counted by their leading bits, of which a feature has few."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (_rows(batch.column("x")) + 0.0).view(np.int64) >> SPARE_BITS  # no feature is negative, so bits are in the order of values
            for i in range(FEATURES):
                key, n = np.unique(bits[:, i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(key), pa.int32()), pa.array(key), pa.array(n)], ["i", "key", "n"])

    counts = rows.select("x").mapInArrow(count, "i int, key long, n long").groupBy("i", "key").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("i")
    so_far = counts.withColumns({"below": F.sum("n").over(w.orderBy("key")), "total": F.sum("n").over(w)})
    least = so_far.groupBy("i").agg(*[F.min(F.when(F.col("below") >= q * F.col("total"), F.col("key"))).alias(f"q{k}") for k, q in enumerate(SHARES)])
    keys = np.array([r[1:] for r in sorted(least.collect())], np.int64)
    return (keys << SPARE_BITS).view(np.float64).T


def _grains(x: np.ndarray) -> np.ndarray:
    return np.round(x / GRAIN) * GRAIN


def _sums(rows: DataFrame, columns: list[str], part: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """Sum of the arrays that ``part`` gives: each task adds up its own, and Spark adds up the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(size), False
        for batch in batches:
            for x in part(batch):
                total, found = total + _grains(x), True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in rows.select(*columns).mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def blocks_of(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(good, bad), the features of a block's documents of either label, one after the other.  The commoner label is dealt
    once; blocks of the rarer one are repeated for as many of the commoner as they meet, which at most doubles the rows or so."""
    rare = 0 if n[0] <= n[1] else 1
    few, many = (1 << max(0, (n[y] // BLOCK).bit_length() - 1) for y in (rare, 1 - rare))
    place = F.xxhash64("doc_id")
    common = rows.filter(F.col("y") != rare).withColumn("block", F.pmod(place, F.lit(many)))
    rarer = rows.filter(F.col("y") == rare).withColumn("block", F.explode(F.sequence(F.pmod(place, F.lit(few)), F.lit(many - 1).cast("long"), F.lit(few).cast("long"))))
    of = lambda y: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("y") == y, F.struct("doc_id", "x")))), lambda r: r["x"]))
    return cut(common.unionByName(rarer).groupBy("block").agg(of(1).alias("good"), of(0).alias("bad")).select("good", "bad"), "rank-blocks")


def value_at(df: DataFrame, column: str, rank: int) -> float:
    """The value of that rank (from 0) among all rows: bins are counted and the one that holds it is cut anew, until few rows are left."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    v = F.col(column)
    while low < high:
        inside = df.filter(v.between(low, high))
        bins = F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1))
        for _, n, low, high in sorted(inside.groupBy(bins.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()):
            if rank < n:
                break
            rank -= n
        if n <= AT_ONCE:
            return sorted(r[0] for r in df.filter(v.between(low, high)).select(column).collect())[rank]
    return low


def fit_rank_model(texts: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> RankModel | float:
    """A RankModel from all measured ``texts`` with a training label, or the score of every text where those are of one kind only."""
    own = training_labels(labels, label, train)
    # one row for each document, however often it is repeated
    rows = cut(texts.join(own, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")), "rank-training")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = own.agg(F.avg("y")).first()[0]
        return 0.5 if share is None else share
    knots = knots_of(rows)
    width = FEATURES * (1 + len(SHARES))

    def moments(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        e, y = expand(_rows(batch.column("x")), knots), batch.column("y").to_numpy()
        e = _grains(e)
        yield np.concatenate([e[y == 0].sum(0), e[y == 1].sum(0), _grains(e * e).sum(0)])

    sums = _sums(rows, ["y", "x"], moments, 3 * width).reshape(3, width)
    total = n[0] + n[1]
    mean = (sums[0] + sums[1]) / total
    model = RankModel(knots, mean, np.sqrt(np.maximum(sums[2] / total - mean * mean, 0.0)) + 1e-6)
    blocks = blocks_of(rows, n)
    n_blocks = blocks.count()

    def terms(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for good, bad in zip(batch.column("good"), batch.column("bad")):
                grad, hess = pair_terms(*(model.expand(side.values.to_numpy().reshape(-1, FEATURES)) for side in (good, bad)), w)
                yield np.concatenate([grad, hess.ravel()])

        found = _sums(blocks, ["good", "bad"], part, width + width * width) / n_blocks
        return found[:width], found[width:].reshape(width, width)

    model.weights = newton(terms, width)
    apart = float(((sums[1] / n[1] - sums[0] / n[0]) / model.scale) @ model.weights)
    model.slope = 4.0 / max(apart, 1e-6)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.rank(_rows(batch.column("x"))))], ["s"])

    ranks = cut(rows.select("x").mapInArrow(rank, "s double"), "rank-scores")
    model.cut = (value_at(ranks, "s", n[0] - 1) + value_at(ranks, "s", n[0])) / 2
    return model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels are learned outside the
    held-out fold only."""
    texts = measured(docs)
    model = fit_rank_model(texts, labels, fold(F.col("doc_id"), folds) != held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            scores = model.score(_rows(batch.column("x"))) if isinstance(model, RankModel) else np.full(n, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = texts.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
