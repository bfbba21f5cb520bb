"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of its runs of five words (lower-cased): weight = (1 + ln tf) times a
smoothed inverse document frequency.  The rarity of a run is the mean of its words' inverse document
frequencies, which are exact counts over the whole corpus: the share of documents that hold a word does not
depend on the size of the corpus, so a pair of texts is as similar in a large corpus as in a small one.
Words in fewer than ``RARE`` of the documents are equally rare, so the words sent to the tasks are at most
the mean number of different words in a document divided by ``RARE``, however many documents there are.  The smoothing keeps weights within a factor of two (``IDF_SHARE``), for otherwise the
very copies in a large group would push down the weight of what they share.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each text; two texts
agree on a sample with probability equal to their weighted Jaccard similarity.  Texts that
agree on a band are candidates, and candidates are verified by the exact weighted Jaccard
similarity of their whole texts.  Classes are the connected components of verified links.

How candidates are verified without all pairs of a bucket.  First every member of a bucket is
compared to the bucket's hub, the member with most company over all its buckets.  Where members
are still in different classes, they are described by their deltas to the hub: what they add
and what they lack.  Two members x, y with masses Wx, Wy and delta sizes ax, ay reach the
threshold t only if their deltas share at least (ax + ay - c (Wx + Wy)) / 2 of weight, with
c = (1 - t) / (1 + t).  One of the two is unlike the hub, which makes that amount positive, so they must share an
element within a prefix of each delta (elements in a fixed order, additions first); an equi-join
on those elements, with the weight that follows them as a second filter, finds every pair
that can still be a link, and these are verified.  No pair of a bucket goes untested unless one
of these bounds rules it out or its members are in one class already.  The texts of hubs are copied to
salted keys, so a hub with very many members is no hot key.

Defined results: equal texts (null and empty ones too) are one class from the start; texts
under five words are one shingle; texts without words equal nothing but their own copies;
the class id is the smallest doc_id of the class (null only where no member has one);
repeated rows are rows of the same class; other columns are ignored by ``near_duplicates``
and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut, salt_of, text_key, unused
from tapewright.llm.word_hash import A as _A
from tapewright.llm.word_hash import B as _B
from tapewright.llm.word_hash import C as _C
from tapewright.llm.word_hash import mix as _mix
from tapewright.llm.word_hash import word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
IDF_SHARE = 0.5
RARE = 2.0**-12
#: Words that a task counts before it hands them on.
PENDING = 1 << 21
#: Members of a bucket beyond which its rows are not sent to the task of their key.
HOT = 4096
#: Most buckets that count as hot: what is broadcast to spread them.
HOT_KEYS = 1 << 15
HUB_PAIRS = 64


def shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the shingles of words ``h``, where each first stands, and how often each occurs."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _A + h[k : k + len(out)]
    return np.unique(_mix(out), return_index=True, return_counts=True)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal shares, by bisection of its
    distribution 1 - (1 + x) e^-x."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Weights under document frequencies (words in order, documents of each), samples and band keys of a text."""

    def __init__(self, words: np.ndarray, docs: np.ndarray, n_docs: int):
        self.words = words
        share = np.maximum(docs / max(n_docs, 1), RARE)
        self.rarity = np.append(np.log(share) / np.log(RARE), 1.0)  # last: of all other words
        r = _gamma_quantiles(1 << 12)
        self.r, self.inv_r = r.astype(np.float32), (1.0 / r).astype(np.float32)
        self.ln_c = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
        self.seeds = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _A)

    def weighted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        h = word_hashes(text)
        x, first, tf = shingles(h)
        if not len(x):
            return x, np.empty(0)
        at = np.searchsorted(self.words, h)
        if len(self.words):
            at[self.words[np.minimum(at, len(self.words) - 1)] != h] = len(self.words)
        word, width = self.rarity[at], min(SHINGLE, len(h))
        rarity = sum(word[first + k] for k in range(width)) / width  # in this order, so equal shingles weigh the same to the last bit
        return x, (1.0 + np.log(tf)) * (1.0 - IDF_SHARE + IDF_SHARE * rarity)

    def bands(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A key for each band.  For each sample and shingle r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from
        a hash; t = floor(ln w / r + b), and the shingle with the smallest ln c - r (t - b + 1) is drawn."""
        ln_w = np.log(weight).astype(np.float32)
        n = len(x)
        picked = np.empty(len(self.seeds), np.uint64)
        step = max(1, 400_000 // n)
        for at in range(0, len(self.seeds), step):
            with np.errstate(over="ignore"):
                h = (x[None, :] ^ self.seeds[at : at + step, None]) * _B
                h ^= h >> np.uint64(29)
                h *= _C
                h ^= h >> np.uint64(32)
            k = (h & np.uint64(0xFFF)).astype(np.int32)
            b = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            r = self.r[k]
            t = np.floor(ln_w * self.inv_r[k] + b)
            ln_a = self.ln_c[((h >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - b + np.float32(1.0))
            best = ln_a.argmin(axis=1)
            row = np.arange(len(best))
            picked[at : at + step] = _mix(x[best] + t[row, best].astype(np.int64).astype(np.uint64) * _A)
        rows = picked.reshape(BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64) * _C
        with np.errstate(over="ignore"):
            for k in range(ROWS):
                out = _mix(out * _A + rows[:, k])
        return out.view(np.int64)

    @staticmethod
    def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
        return weighted_jaccard(a, b) >= threshold


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _merged(words: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    return found, np.bincount(at, np.concatenate(docs), len(found)).astype(np.int64)


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The words in at least ``RARE`` of the documents by hash, the documents that hold each, and the number of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        hand_on = lambda w, n: pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "docs"])
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.append(np.unique(word_hashes(text)))
                n.append(np.ones(len(words[-1]), np.int64))
                size += len(words[-1])
                if size > 2 * PENDING:
                    w, m = _merged(words, n)
                    if len(w) > PENDING:
                        yield hand_on(w, m)
                        w, m = w[:0], m[:0]
                    words, n, size = [w], [m], len(w)
        yield hand_on(*_merged(words, n))

    n_docs = docs.count()
    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    frequent = cut(counted.filter(F.col("docs") >= RARE * n_docs), "icws-words")
    found = frequent.toArrow()
    words, n = (found.column(c).to_numpy() for c in ("word", "docs"))
    order = np.argsort(words.view(np.uint64))
    return words.view(np.uint64)[order], n[order], n_docs


def _by_bucket(rows: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` joined to a table of one row for each bucket.  Rows of hot buckets stay where they are."""
    few = table.join(F.broadcast(hot), "bucket", "left_semi")
    return rows.join(F.broadcast(few), "bucket").unionByName(rows.join(F.broadcast(hot), "bucket", "left_anti").join(table, "bucket"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (u, v): root is the smallest node.
    Each round takes the smallest label of the neighbours and then the label's own label."""
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-links")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).select(F.col("u").alias("node"), "root"), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.u, "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        # the root of a root is at most as large; a jump halves the depth of chains
        labels_next = cut(
            step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "cc-labels"
        )
        changed = labels_next.filter(F.col("root") != F.col("old")).limit(1).count()
        labels = labels_next.select("node", "root")
        if not changed:
            return labels


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with both texts.  b may be a hub of very many pairs: its text is copied to one
    salt for every HUB_PAIRS of them."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    hubs = texts.join(salts, texts.k == salts.b).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("text_b"))
    members = dealt.join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    return members.join(hubs, ["b", "salt"]).drop("salt")


def _measure(sent):
    measure, args = sent.value
    return measure(*args)


def _compared(batches: Iterator[pa.RecordBatch], sampler):
    """(batch, [(weighted a, weighted b)]); a hub's text comes many times in a row."""
    last, last_b = None, None
    for batch in batches:
        out = []
        for ta, b, tb in zip(batch.column("text_a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_b").to_pylist()):
            if b != last_b:
                last, last_b = sampler.weighted(tb), b
            out.append((sampler.weighted(ta), last))
        yield batch, out


def _verify(pairs: DataFrame, texts: DataFrame, sampler_args, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts reach the threshold."""
    sent = pairs.sparkSession.sparkContext.broadcast(sampler_args)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = _measure(sent)
        for batch, both in _compared(batches, measure):
            yes = pa.array([measure.linked(x, y, threshold) for x, y in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(yes).rename_columns(["u", "v"])

    return _with_texts(pairs, texts).mapInArrow(check, "u binary, v binary")


def delta_prefix(x: tuple[np.ndarray, np.ndarray], hub: tuple[np.ndarray, np.ndarray], outlier: bool, threshold: float):
    """(elements, weight from each element on, delta size) of the prefix that any link of x within the hub's
    bucket must meet.  An element is a shingle and whether x has more or less of it than the hub."""
    keys = np.union1d(x[0], hub[0])
    d = np.zeros(len(keys))
    d[np.searchsorted(keys, x[0])] += x[1]
    d[np.searchsorted(keys, hub[0])] -= hub[1]
    keys, d = keys[np.abs(d) > 1e-12], d[np.abs(d) > 1e-12]
    order = np.lexsort((keys, d < 0))  # additions first, then by hash
    keys, d = keys[order], d[order]
    size = np.abs(d)
    total, c = float(size.sum()), (1 - threshold) / (1 + threshold)
    if outlier:  # its distance to the hub is beyond the threshold by so much
        least = (total - c * (x[1].sum() + hub[1].sum())) / (1 + c)
    else:
        least = (total - c * d.sum()) / 2
    rest = np.cumsum(size[::-1])[::-1]
    kept = rest >= least - 1e-9
    return _mix(keys[kept] ^ np.where(d[kept] < 0, _A, np.uint64(0))).view(np.int64), rest[kept], total


def _delta_pairs(open_members: DataFrame, texts: DataFrame, sampler_args, threshold: float) -> DataFrame:
    """Pairs (a, b) of members (hub b, member a, root, outlier) that can still reach the threshold."""
    sent = open_members.sparkSession.sparkContext.broadcast(sampler_args)
    kinds = {"a": pa.binary(), "b": pa.binary(), "root": pa.binary(), "outlier": pa.bool_(), "mass": pa.float64(), "total": pa.float64(), "keys": pa.list_(pa.int64()), "rests": pa.list_(pa.float64())}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, both in _compared(batches, _measure(sent)):
            found = [delta_prefix(x, y, o, threshold) for (x, y), o in zip(both, batch.column("outlier").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("a", "b", "root", "outlier")], pa.array([float(x[1].sum()) for x, _ in both], pa.float64()),
                pa.array([f[2] for f in found], pa.float64()), pa.array([f[0] for f in found], kinds["keys"]), pa.array([f[1] for f in found], kinds["rests"]),
            ], list(kinds))

    schema = "a binary, b binary, root binary, outlier boolean, mass double, total double, keys array<long>, rests array<double>"
    deltas = cut(_with_texts(open_members, texts).mapInArrow(describe, schema), "icws-deltas")
    long = deltas.select(F.col("b").alias("hub"), "a", "root", "outlier", "mass", "total", F.explode(F.arrays_zip("keys", "rests")).alias("z"))
    long = long.select("hub", "a", "root", "outlier", "mass", "total", F.col("z.keys").alias("element"), F.col("z.rests").alias("rest"))
    # an element that one member alone has joins nothing
    shared = long.groupBy("hub", "element").agg(F.count("*").alias("n"), F.max("outlier").alias("any")).filter("n > 1 and any").select("hub", "element")
    long = cut(long.join(shared, ["hub", "element"]), "icws-elements")
    c = (1 - threshold) / (1 + threshold)
    x, y = long.alias("x"), long.filter("outlier").alias("y")
    need = (F.col("x.total") + F.col("y.total") - c * (F.col("x.mass") + F.col("y.mass"))) / 2 - 1e-9
    hit = (
        (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.root") != F.col("y.root"))
        & (F.least("x.rest", "y.rest") >= need) & (F.least("x.mass", "y.mass") >= threshold * F.greatest("x.mass", "y.mass") - 1e-9)
    )
    return x.join(y, hit).select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, mass) of every row, and (k, rep, class_id, class_k) of every distinct text: its smallest doc_id
    and the smallest doc_id of its class, with the text that has it."""
    return linked_classes(docs, Sampler, word_frequencies(docs), threshold)


def linked_classes(docs: DataFrame, measure, measure_args: tuple, threshold: float) -> tuple[DataFrame, DataFrame]:
    """:func:`text_classes` by any measure: ``measure(*measure_args)`` gives a text's ``weighted`` set, the ``bands`` that texts meet
    in, and whether two sets are ``linked``."""
    spark = docs.sparkSession
    sampler_args = (measure, measure_args)
    sent = spark.sparkContext.broadcast(sampler_args)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _measure(sent)
        for batch in batches:
            done: dict[bytes, tuple] = {}
            out = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                if k not in done:
                    x, w = sampler.weighted(text)
                    done[k] = (sampler.bands(x, w).tolist() if len(x) else [], float(w.sum()))
                out.append(done[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.float64())],
                ["doc_id", "k", "bands", "mass"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", text_key(F.col("text")))
    signed = cut(own.select("doc_id", "k", "text").mapInArrow(sign, "doc_id long, k binary, bands array<long>, mass double"), "icws-signed")
    nodes = cut(signed.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("mass").alias("mass")), "icws-nodes")
    spread = nodes.select("k", "rep", "mass", F.explode("bands").alias("bucket"))
    sizes = cut(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "icws-sizes")
    # buckets above the limit hold more than HOT_KEYS-th of all places, so there are fewer than HOT_KEYS
    places = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = cut(sizes.filter(F.col("n") > max(HOT, places // HOT_KEYS)).select("bucket"), "icws-hot")
    members = cut(_by_bucket(spread, sizes, hot), "icws-members")
    company = members.groupBy("k").agg(F.sum("n").alias("company"))
    members = cut(members.join(company, "k").select("bucket", "k", "rep", "mass", "company"), "icws-members")
    wanted = members.select("k", F.col("rep").alias("doc_id")).distinct()
    # the text of each candidate, from the row with its smallest doc_id (or any, where it has none)
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    named = own.withColumn("id_key", id_key).join(wanted.select("k", id_key.alias("id_key")), ["k", "id_key"])
    texts = cut(named.groupBy("k").agg(F.first("text").alias("text")), "icws-texts")
    best = F.struct("company", -F.coalesce("rep", F.lit(2**62)), "k")
    hubs = members.groupBy("bucket").agg(F.max_by(F.struct("k", "mass"), best).alias("hub"))
    members = cut(_by_bucket(members, hubs, hot).filter(F.col("k") != F.col("hub.k")).select("bucket", "k", "mass", "hub"), "icws-members")
    # similarity cannot exceed the ratio of the masses
    near = F.least("mass", "hub.mass") >= threshold * F.greatest("mass", "hub.mass") - 1e-9
    pairs = members.filter(near).select(F.col("k").alias("a"), F.col("hub.k").alias("b")).distinct()
    links = cut(_verify(pairs, texts, sampler_args, threshold), "icws-links")
    roots = components(links)
    # members that are all of one class have nothing left to compare
    own_root = members.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    open_buckets = own_root.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    hub_root = roots.select(F.col("node").alias("b"), F.col("root").alias("hub_root"))
    open_members = _by_bucket(own_root, open_buckets, hot).select(F.col("k").alias("a"), F.col("hub.k").alias("b"), "root").distinct()
    open_members = open_members.join(hub_root, "b", "left").select("a", "b", "root", (F.col("root") != F.coalesce("hub_root", "b")).alias("outlier"))
    open_members = cut(open_members, "icws-open")
    if open_members.head(1):
        pairs = cut(_delta_pairs(open_members, texts, sampler_args, threshold), "icws-pairs")
        if pairs.head(1):
            links = cut(links.unionByName(_verify(pairs, texts, sampler_args, threshold)), "icws-links")
            roots = components(links)
    of = nodes.select("k", "rep").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    of = cut(of, "icws-classes")
    heads = of.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), "rep", "k")).alias("head"))
    classes = of.join(heads, "root").select("k", "rep", F.col("head.rep").alias("class_id"), F.col("head.k").alias("class_k"))
    return signed.select("doc_id", "k", "mass"), classes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, is_representative), one row for each input row."""
    rows, classes = text_classes(docs, threshold)
    rows = rows.withColumn("salt", salt_of("doc_id"))
    # each (text, salt) learns its class first, so a text that very many rows share is spread
    at = rows.select("k", "salt").distinct().join(classes, "k")
    return rows.join(at, ["k", "salt"]).select(
        "doc_id", "class_id",
        ((F.col("k") == F.col("class_k")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_representative"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row for each class: that of its smallest doc_id."""
    _, classes = text_classes(docs, threshold)
    pick = lambda k, doc_id: F.md5(F.concat_ws("|", F.hex(k), F.coalesce(doc_id.cast("string"), F.lit(""))))
    name = unused("pick", docs.columns)
    kept = classes.filter(F.col("k") == F.col("class_k")).select(pick(F.col("k"), F.col("class_id")).alias(name))
    marked = docs.withColumn(name, pick(text_key(F.col("text").cast("string")), F.col("doc_id").cast("long")))
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
