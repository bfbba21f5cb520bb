"""The filter audit, the n-gram join and the token alignment against brute force, on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import filter_audit, icws, ngram_join, token_alignment

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["*", "1 AS part", "2 AS mask", "3 AS k", "4 AS chunk", "5 AS fingerprint", "6 AS mass"]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11 filter audit


def audit_rows(seed=3, n=240):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["w%d" % (int(rng.expovariate(0.02))), "AB", "x#y", "CAPS", "é"]) for _ in range(rng.randint(0, 260))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None]), "s", 0) for i in range(n)]
    rows += [(7, rows[3][1], "en", "s", 0), (7, rows[3][1], "en", "s", 0), (None, rows[3][1], "en", "s", 0), (None, None, None, None, None), (5000, "", "fr", "s", 0), (5001, None, "fr", "s", 0)]
    rows += [(6000 + i, "hot text " * 30, "en", "s", 0) for i in range(n)]
    rows += [(9000, "A" * 200_000, "en", "s", 0), (9001, "a b\tc\n\x0bd " * 30_000, "en", "s", 0)]
    rng.shuffle(rows)
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    return rows, labels


def brute_masks(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    out = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]]
        out.append((d, lang or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def brute_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in range(2))
    out, masks = {}, brute_masks(rows)
    for part in {p for _, p, _ in masks}:
        mine = [(d, m) for d, p, m in masks if p == part]
        shap = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                out[part, order, step] = [len(left), len(gone), sum(bool(m & bit) for _, m in mine) - len(gone), sum(m == bit for _, m in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shap[f] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shap[f])
    return out


def test_audit_against_brute_force(spark, empty):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, DOCS).selectExpr(*CLASH).repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "9 AS part", "8 AS docs")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in filter_audit.audit_orders(docs, told).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit_orders(empty, told).count() == 0
    none = filter_audit.audit_orders(docs, told.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert none[0] == none[1] == 0 and none[2] == 600 * len({r[2] or "" for r in rows})


@pytest.mark.parametrize("fingerprint", [None, "length(text) % 3", "0"])
def test_duplicates_over_task_boundaries(spark, monkeypatch, fingerprint):
    """Hot texts cut over many tasks, and different texts of one fingerprint within and across them."""
    rows, _ = audit_rows(seed=5)
    rows += [(10_000 + i, f"{'ab' if i % 2 else 'cd'} {i % 3}", "en", "s", 0) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        masks = filter_audit.failure_masks(spark.createDataFrame(rows, DOCS).repartition(4), fingerprint and F.expr(fingerprint))
        assert Counter(map(tuple, masks.collect())) == Counter(brute_masks(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# 12 n-gram join


def grams(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows):
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(known) if known and sets[i] else rows[i][0]) for i in members]
    return Counter(out)


def gram_rows(seed, base=14, copies=9, edits=(0, 1, 1, 2, 3, 4, 6, 8)):
    """Groups whose members lie close to the threshold, a passage that all share, sizes from one word to thousands."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for g in range(base):
        w = [f"g{g}w{rng.randrange(200)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 11, 12, 13, 40, 120, 300]))]
        for _ in range(copies):
            x = list(w)
            for _ in range(rng.choice(edits)):
                at = rng.randrange(len(x))
                x[at : at + rng.choice([0, 1])] = [rng.choice(["new%d" % rng.randrange(9), x[at].upper()])]
            text = " ".join(x)
            rows.append((len(rows), text + (" " + passage if rng.random() < 0.3 else ""), "en", "s", 0))
    rows += [(800 + i, passage + " " + " ".join(f"u{i}v{k}" for k in range(25)), "en", "s", 0) for i in range(40)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \t\n", "en", "s", 0), (903, "One", "en", "s", 0), (904, "one", "en", "s", 0), (905, "É x", "en", "s", 0), (906, "é x", "en", "s", 0)]
    rows += [(None, "one", "en", "s", 0), (None, "lonely text without an id", "en", "s", 0), (12, rows[12][1], "en", "s", 0), (3, "another row of three here", "en", "s", 0)]
    long = [f"l{rng.randrange(3000)}" for _ in range(8000)]
    rows += [(950, " ".join(long), "en", "s", 0), (951, " ".join(long[:7900]) + " tail", "en", "s", 0), (952, " ".join(long[3000:]), "en", "s", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, empty, seed):
    rows = gram_rows(seed)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS).selectExpr(*CLASH, "7 AS salt", "8 AS bucket"))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_components(rows)
    if seed == 1:
        assert ngram_join.ngram_components(empty).count() == 0


def test_components_with_hot_buckets_and_many_outliers(spark, monkeypatch):
    """One origin with many edited copies, most of them out of reach of each other, and hot buckets kept in place."""
    monkeypatch.setattr(icws, "HOT", 20)
    rng = random.Random(4)
    w = [f"o{i}" for i in range(200)]
    rows = []
    for i in range(150):
        x = list(w)
        for at in rng.sample(range(200), rng.choice([1, 2, 4, 5, 7])):
            x[at] = f"e{i}x{at}" if rng.random() < 0.8 else "same"
        rows.append((i, " ".join(x), "en", "s", 0))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS))
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def test_block_keys_keep_every_link():
    """Sets at the threshold meet in a key, whatever their sizes, and blocks without a column too."""
    rng = np.random.default_rng(7)
    inc = ngram_join.Incidence(3, 90)
    for _ in range(3000):
        n = int(rng.choice([9, 10, 12, 19, 20, 25, 30, 38, 57, 100, 190, 400]))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x
        while True:  # as far apart as they may be
            drop, add = rng.random() < 0.5, rng.integers(0, 2**63, 1).astype(np.uint64)
            z = np.delete(y, rng.integers(len(y))) if drop else np.union1d(y, add)
            both = len(np.intersect1d(x, z))
            if 100 * both < 90 * len(np.union1d(x, z)):
                break
            y = z
        one = np.ones(1)
        assert np.intersect1d(inc.bands(x, one), inc.bands(y, one)).size
        assert inc.linked((x, one), (y, one), 0.9) and not inc.linked((x, one), (z, one), 0.9)


def test_blocked_overlap_counts():
    rng = np.random.default_rng(8)
    inc = ngram_join.Incidence(3, 90)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 3000, rng.integers(0, 2500)).astype(np.uint64)) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert inc.overlap(x, y, 0) == both and inc.overlap(x, y, both + 1) is None


# 13 token alignment


class Naive:
    def __init__(self):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(token_alignment.VOCABULARY_A)
        self.a.encode_special_tokens = True
        with open(token_alignment.VOCABULARY_B, "rb") as f:
            self.b = token_alignment.PieceVocabulary(f.read())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.b.bytes[i]) for i in self.b.model.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute_alignment(texts):
    naive, docs, count = Naive(), [], Counter()
    for text in texts:
        spans, at = [], 0
        a, b = naive.tokens(text)
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    links.append((i, spans[1][j][0]))
                j += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        at = [0, 0]
        for end in ends:
            ids = []
            for k in range(2):
                own = []
                while at[k] < len(spans[k]) and spans[k][at[k]][2] <= end:
                    own.append(str(spans[k][at[k]][0]))
                    at[k] += 1
                ids.append(",".join(own))
            groups.append("|".join(ids))
            start = end
        count.update(links)
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (n_a, n_b, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for n_a, n_b, g, ls in docs
    ]


def token_rows():
    rng = random.Random(6)
    alphabet = "abcdeé  \t\n\r 　ﬁ①漢字😀'’<>|s▁x1²½\x1c\x85​َ"
    texts = [None, "", " ", "  ", "\n", "▁", "a▁b", "<s> <|endoftext|> </s> <unk> <0x41>", "naïve café's  we'll\n\n\tI'd", "x" * 5000, " " * 3000 + "end", "word " * 20_000, "  x", "x   y"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [" ".join(rng.choice(["the", "Holländer", "été", "3.14", "snake_case", "don't", "漢字", "a"]) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    return texts


def test_pieces_have_the_tokens_of_the_text(monkeypatch):
    monkeypatch.setattr(token_alignment, "PIECE_CHARS", 7)
    with open(token_alignment.VOCABULARY_A, "rb") as a, open(token_alignment.VOCABULARY_B, "rb") as b:
        aligner = token_alignment.Aligner(a.read(), b.read())
    for text, want in zip(token_rows(), brute_alignment(token_rows())):
        if text:
            cut = list(token_alignment.pieces(text))
            assert " ".join(cut) == text and (len(cut) > 1 or len(text) < 200 or " " not in text.strip())
            got = aligner.measured([text])[0] or (0, 0, [], [])
            assert (got[0], got[1], len(got[2]), len(got[3])) == want[:4]
            assert not got[2] or hashlib.sha256(";".join(got[2]).encode()).hexdigest() == want[6]


@pytest.mark.parametrize("chunk_bytes", [300, token_alignment.CHUNK_BYTES])
def test_alignment_against_brute_force(spark, empty, chunk_bytes):
    texts = token_rows()
    rows = [(i if i != 20 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(21, texts[30], "en", "s", 0), (21, texts[30], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr(*CLASH, "7 AS pair", "8 AS n_best").repartition(3)
    got = token_alignment.align_tokens(docs, chunk_bytes=chunk_bytes)
    want = [(r[0], *x) for r, x in zip(rows, brute_alignment([r[1] for r in rows]))]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    if chunk_bytes == 300:
        assert token_alignment.align_tokens(empty).count() == 0
        blank = spark.createDataFrame([(1, None, None, None, None), (2, "▁", None, None, None)], DOCS)
        assert sorted(map(tuple, token_alignment.align_tokens(blank).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_transducer_forgets_and_refuses(monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_STEPS", 2)
    t = token_alignment.Transducer([b"ab", b"c", b"d", b"abc"], [b"a", b"bc", b"d", b"abcd"])
    assert t.align([0, 1, 2], [0, 1, 2]) == (["0,1|0,1", "2|2"], [0 * token_alignment.PAIR, 1, token_alignment.PAIR + 1, 2 * token_alignment.PAIR + 2])
    assert t.align([0, 1, 2], [3]) == (["0,1,2|3"], [3, token_alignment.PAIR + 3, 2 * token_alignment.PAIR + 3])
    with pytest.raises(ValueError):
        t.align([1], [2])
