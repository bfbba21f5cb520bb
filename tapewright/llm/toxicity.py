"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all their terms: words, and the first letters of longer words, each by a hash of 64 bits.
A term's weight is (1 + ln tf) times its inverse document frequency over the whole corpus, times
the square root of 1 + G2, its log-likelihood ratio against the labels of the examples: terms that
tell the labels apart count for more, and no term is left out.  Terms that no example holds
cannot be shared with one; they count in a text's length, each with the weight of a term of one
document.  The labelled examples (a sample of documented size) are searched whole: their
``DENSE`` most frequent terms are a matrix, the others an inverted index of blocks, together they
give every cosine within a proven error, and what is left near the ``NEIGHBOURS`` best is computed
anew in full precision, so the neighbours are exact.  Their votes are weighted by similarity,
and a logistic map fitted on the examples turns the vote into a probability.  A labelled document
is never its own neighbour, neither in the fit nor in its score.  The neighbours found are returned as evidence.

Plan: the sample's terms, a pass that counts them over the documents where they lie, and a pass
that scores; nothing but the sample's vectors and terms is sent to tasks, and they depend on
the sample only.

Defined results: null and empty texts, and texts without a term of any example, have no
neighbours and get the score of an empty vote; repeated and conflicting labels of a document
are averaged; without labels of both kinds every score is the share of toxic labels (0 without
any); equal similarities are broken by a hash of the example's terms, and examples of equal terms
vote with their mean label, so no score depends on a doc_id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.pairwise_rank import CUT, fold, training_labels
from tapewright.llm.word_hash import letters, word_hashes

SAMPLE = 4000
STEM = 7
NEIGHBOURS = 15
#: Terms held as a matrix; all others are looked up by their examples.
DENSE = 256
#: Entries of a block of the inverted index.  Terms of fewer examples are not padded to one.
BLOCK = 16
#: Relative error of a cosine in single precision: sums of at most DENSE products, and the rounding of what is added.
ERROR = (DENSE + 16) * 2.0**-23
#: Texts searched at once, and entries of the inverted index read for them at once.
BATCH, ENTRIES = 32, 1 << 20
PRIOR = 0.25
SCORES = "doc_id long, score double, evidence array<long>, similarity array<double>"


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms, as hashes in order, and how often each occurs: its words, and the first STEM letters of
    longer words."""
    return np.unique(word_hashes(text, letters(), STEM), return_counts=True)


class Examples(NamedTuple):
    """The sample: example i holds ``terms[starts[i] : starts[i + 1]]`` (places in ``known``, the hashes of all
    terms in order) so many ``times``."""

    known: np.ndarray
    ids: list[int]
    y: list[int]
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray


class BlockMaxIndex:
    """Examples as unit vectors, one for equal ones.  ``weights``: the factor of each known term; ``other``: that
    of unknown terms."""

    def __init__(self, weights: np.ndarray, examples: Examples, other: float = 1.0):
        self.known, self.weights, self.other = examples.known, weights, other
        self.ids, self.y = np.array(examples.ids, np.int64), np.array(examples.y, float)
        seen: dict[bytes, int] = {}
        self.of, rows, digests = np.zeros(len(self.ids), int), [], []
        for i, (a, b) in enumerate(zip(examples.starts[:-1].tolist(), examples.starts[1:].tolist())):
            no, w = self.weigh(examples.terms[a:b], examples.times[a:b], examples.times[:0])
            digest = hashlib.sha256(no.tobytes() + w.tobytes()).digest()
            self.of[i] = u = seen.setdefault(digest, len(rows))
            if u == len(rows):
                rows.append((no, w))
                digests.append(digest)
        self.rank = np.argsort(sorted(range(len(rows)), key=digests.__getitem__)) if rows else np.empty(0, int)
        self.starts = np.cumsum([0] + [len(no) for no, _ in rows])
        self.terms = np.concatenate([no for no, _ in rows]) if rows else np.empty(0, np.int32)
        self.values = np.concatenate([w for _, w in rows]) if rows else np.empty(0)
        self._invert()

    def _invert(self) -> None:
        """What follows from the vectors: the matrix of frequent terms, the inverted index of the others, equal examples."""
        n, v = len(self.starts) - 1, len(self.weights)
        row = np.repeat(np.arange(n), np.diff(self.starts))
        df = np.bincount(self.terms, minlength=v)
        frequent = np.argsort(-df, kind="stable")[:DENSE]
        self.column = np.full(v, -1)
        self.column[frequent] = np.arange(len(frequent))
        at = self.column[self.terms]
        self.matrix = np.zeros((len(frequent), n), np.float32)
        self.matrix[at[at >= 0], row[at >= 0]] = self.values[at >= 0]
        # postings of the other terms: whole blocks for those of many examples, a plain list for the rest
        blocked = (at < 0) & (df[self.terms] >= BLOCK)
        n_blocks = np.where((self.column < 0) & (df >= BLOCK), -(-df // BLOCK), 0)
        self.block_start = np.concatenate([[0], np.cumsum(n_blocks)])
        self.block_row = np.full((self.block_start[-1], BLOCK), n, np.intp)  # n: padding
        self.block_value = np.zeros((self.block_start[-1], BLOCK))
        term, entry = self._by_term(blocked)
        place = np.arange(len(term)) - np.searchsorted(term, term) + self.block_start[term] * BLOCK
        self.block_row.ravel()[place], self.block_value.ravel()[place] = row[entry], self.values[entry]
        term, entry = self._by_term((at < 0) & ~blocked)
        self.post_row, self.post_value = row[entry].astype(np.int32), self.values[entry]
        self.post_start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=v))])
        self.n_members = np.bincount(self.of, minlength=n)
        self.toxic_members = np.bincount(self.of, self.y, minlength=n)
        self.example = {d: i for i, d in enumerate(self.ids.tolist())}
        order = np.lexsort((self.ids, self.of))
        self.members, self.member_start = order, np.concatenate([[0], np.cumsum(self.n_members)])

    def _by_term(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the entries asked for, in order, and the places of the entries."""
        entry = np.flatnonzero(which)
        entry = entry[np.argsort(self.terms[entry], kind="stable")]
        return self.terms[entry], entry

    def __getstate__(self) -> dict:
        kept = ("known", "weights", "other", "ids", "y", "of", "starts", "terms", "values", "rank")
        return {k: self.__dict__[k] for k in kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._invert()

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.terms[self.starts[u] : self.starts[u + 1]], self.values[self.starts[u] : self.starts[u + 1]]) for u in self.of]

    def vector(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known terms and their TF-IDF weights, of unit length together with the unknown terms."""
        at = np.searchsorted(self.known, terms)
        known = self.known[np.minimum(at, len(self.known) - 1)] == terms if len(self.known) else np.zeros(len(terms), bool)
        return self.weigh(at[known], n[known], n[~known])

    def weigh(self, no: np.ndarray, n: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for terms by place, and how often these and the unknown ones occur."""
        w, rest = (1.0 + np.log(n)) * self.weights[no], (1.0 + np.log(unknown)) * self.other
        norm = math.sqrt(float(w @ w) + float(rest @ rest))
        return no, w / norm if norm else w

    def nearest(self, no: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine above 0, best first: exact."""
        return next(self.nearest_of([(no, w)], k, [without]))

    def nearest_of(self, queries: list, k: int = NEIGHBOURS, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(queries):
            stop, entries = at, 0
            while stop < len(queries) and stop - at < BATCH and (stop == at or entries < ENTRIES):
                no = queries[stop][0]
                entries += sum(int((x[no + 1] - x[no]).sum()) * size for x, size in ((self.post_start, 1), (self.block_start, BLOCK))) if len(no) else 0
                stop += 1
            yield from self._nearest(queries[at:stop], k, without[at:stop] if without else [-1] * (stop - at))
            at = stop

    def _nearest(self, queries: list, k: int, without: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.starts) - 1, len(queries)
        if not n:
            yield from [(np.empty(0, int), np.empty(0))] * m
            return
        no, w = np.concatenate([q[0] for q in queries]).astype(int), np.concatenate([q[1] for q in queries])
        row = np.repeat(np.arange(m), [len(q[0]) for q in queries])
        at = self.column[no]
        dense = np.zeros((m, len(self.matrix)), np.float32)
        dense[row[at >= 0], at[at >= 0]] = w[at >= 0]
        near = dense @ self.matrix
        entry, size = _ranges(self.post_start, no)
        if len(entry):
            near += np.bincount(np.repeat(row * n, size) + self.post_row[entry], np.repeat(w, size) * self.post_value[entry], m * n).reshape(m, n)
        block, size = _ranges(self.block_start, no)
        factor, ends = np.repeat(w, size)[:, None], np.cumsum(np.bincount(row, size, m)).astype(int).tolist()
        for r, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                value = self.block_value.take(block[a:b], axis=0)
                value *= factor[a:b]
                near[r] += np.bincount(self.block_row.take(block[a:b], axis=0).ravel(), value.ravel(), n + 1)[:n]
        depth = min(k + 1, n)  # one more, for the example that is left out
        least = np.partition(near, n - depth, axis=1)[:, n - depth] * (1 - 4 * ERROR)
        full = np.zeros(len(self.weights))
        for r, (no, w) in enumerate(queries):
            if not len(no):
                yield np.empty(0, int), np.empty(0)
                continue
            rows = np.flatnonzero((near[r] >= least[r]) & (near[r] > 0))
            full[no] = w
            entry, size = _ranges(self.starts, rows)
            sims = np.add.reduceat(full.take(self.terms.take(entry)) * self.values.take(entry), np.cumsum(size) - size) if len(rows) else np.empty(0)
            full[no] = 0.0
            at, size = _ranges(self.member_start, rows)
            i, s = self.members[at], np.repeat(sims, size)
            if without[r] >= 0:
                i, s = i[i != without[r]], s[i != without[r]]
            order = np.lexsort((self.ids[i], self.rank[self.of[i]], -np.round(s, 12)))[:k]
            yield i[order], s[order]

    def vote(self, i: np.ndarray, s: np.ndarray, base: float, without: int = -1) -> float:
        """Share of toxic neighbours by similarity; PRIOR of weight goes to the base rate.  Equal
        examples vote with their mean label, that of ``without`` not counted."""
        u = self.of[i]
        n, toxic = self.n_members[u], self.toxic_members[u]
        if without >= 0:
            own = u == self.of[without]
            n, toxic = n - own, toxic - own * self.y[without]
        return float((s @ (toxic / n) + PRIOR * base) / (s.sum() + PRIOR))


def _ranges(bounds: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from ``bounds[i]`` to ``bounds[i + 1]`` of every i in ``no``, one after the other, and how many each has."""
    start, size = bounds[no], bounds[no + 1] - bounds[no]
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size), size


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic map of votes, with a small ridge."""
    a, b = 1.0, 0.0
    z = np.log(np.clip(x, 1e-3, 1 - 1e-3) / (1 - np.clip(x, 1e-3, 1 - 1e-3)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
        h = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def label_evidence(examples: Examples) -> np.ndarray:
    """Log-likelihood ratio (G squared) of every term of the examples against their labels."""
    y = np.array(examples.y)
    label = np.repeat(y, np.diff(examples.starts))
    c = [np.bincount(examples.terms[label == v], minlength=len(examples.known)).astype(float) for v in (0, 1)]
    total, both, g2 = float(len(y)), c[0] + c[1], np.zeros(len(examples.known))
    for v in (0, 1):
        n = float((y == v).sum())
        for got, expected in ((c[v], both * n / total), (n - c[v], (total - both) * n / total)):
            g2 += 2 * got * np.log(np.where(got > 0, got, 1) / np.where(expected > 0, expected, 1))
    return np.maximum(g2, 0.0)


def corpus_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents of the whole corpus that hold each known term, and their number."""
    sent, size = docs.sparkSession.sparkContext.broadcast(known), len(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                terms = np.unique(word_hashes(text, letters(), STEM))
                at = np.searchsorted(sent.value, terms)
                total[at[sent.value[np.minimum(at, size - 1)] == terms]] += 1
        total[size] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "docs"])

    rows = docs.select("text").mapInArrow(count, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("docs").to_numpy()
    return out[:size], int(out[size])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``sample`` rows of each label, and how many labels of each
    kind the whole training fold has.  What is broadcast has at most 2 * ``sample`` rows."""
    own = training_labels(labels, label, train)
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id"), counts


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, similarity) of every row; labels are
    learned outside the held-out fold only."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, counts = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held, sample)
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.0
    index = slope = offset = None
    if len(counts) == 2:
        examples = collect_examples(rows)
        if len(set(examples.y)) == 2:
            index, slope, offset = _index(docs, examples, base)
    empty = 1 / (1 + math.exp(-max(-30, min(30, slope * math.log(max(base, 1e-3) / max(1 - base, 1e-3)) + offset)))) if index else base
    sent = docs.sparkSession.sparkContext.broadcast((index, slope, offset))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, slope, offset = sent.value
        for batch in batches:
            out = []
            texts = batch.column("text").to_pylist()
            own = [index.example.get(d, -1) for d in batch.column("doc_id").to_pylist()] if index else [-1] * len(texts)
            parts = (slice(at, at + BATCH) for at in range(0, len(texts), BATCH))
            found = (x for p in parts for x in index.nearest_of([index.vector(*counts_of(t)) for t in texts[p]], without=own[p])) if index else (((), ()) for _ in texts)
            for (near, sims), me in zip(found, own):
                i, s, p = [], [], empty
                if len(near):
                    v = min(max(index.vote(near, sims, base, me), 1e-3), 1 - 1e-3)
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * math.log(v / (1 - v)) + offset))))
                    i, s = index.ids[near].tolist(), sims.tolist()
                out.append((p, i, s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                ["doc_id", "score", "evidence", "similarity"],
            )

    scored = docs.mapInArrow(score, SCORES)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence", "similarity"
    )


def collect_examples(rows: DataFrame) -> Examples:
    """The sample, one example for each document."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t) for t in batch.column("text").to_pylist()]
            terms, times = (pa.array([x.astype(np.uint64).tobytes() for x in y], pa.binary()) for y in zip(*found)) if found else (pa.array([], pa.binary()),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), terms, times], ["doc_id", "y", "terms", "times"])

    got = rows.mapInArrow(collect, "doc_id long, y int, terms binary, times binary")
    # repeated rows of a document would otherwise break the bound on what is collected
    got = got.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct("terms", "times")).alias("c")).orderBy("doc_id").select("doc_id", "y", "c.*").toArrow()
    terms, times = ([np.frombuffer(x, np.uint64) for x in got.column(c).to_pylist()] for c in ("terms", "times"))
    known, at = np.unique(np.concatenate([*terms, np.empty(0, np.uint64)]), return_inverse=True)
    return Examples(
        known, got.column("doc_id").to_pylist(), got.column("y").to_pylist(), np.cumsum([0] + [len(x) for x in terms]),
        at.astype(np.int32), np.concatenate([*times, np.empty(0, np.uint64)]).astype(np.int64),
    )


def _index(docs: DataFrame, examples: Examples, base: float) -> tuple[BlockMaxIndex, float, float]:
    df, n_docs = corpus_frequencies(docs, examples.known)
    weights = (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0) * np.sqrt(1.0 + label_evidence(examples))
    index = BlockMaxIndex(weights, examples, math.log((1.0 + n_docs) / 2.0) + 1.0)
    near = index.nearest_of(index.vectors, without=list(range(len(examples.ids))))
    votes = np.array([index.vote(*x, base, i) for i, x in enumerate(near)])
    # the sample may be balanced otherwise than the labels: weigh it back
    n1 = index.y.sum()
    slope, offset = fit_logistic(votes, index.y)
    offset += math.log(max(base, 1e-6) / max(1 - base, 1e-6)) - math.log(max(n1, 1) / max(len(index.y) - n1, 1))
    return index, slope, offset
