"""Each operator against a brute-force version on small tables with nulls, ties, repeated rows, empty and
very long texts, and columns whose names clash with the operators' own."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapewright.llm import decontam, fertility, html_density, icws, license_scan, mixing, pairwise_rank, sharding, toxicity, warc, word_hash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.expovariate(0.01)) % vocabulary}" for _ in range(n))


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, words(rng, rng.randint(3, 150)), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", "other", None]), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0), (902, "x", "en", "src1", 1), (None, "no id here at all", "en", "src1", 1)]
    rows += [(903, rows[5][1], "en", "src1", 0), (903, rows[5][1], "en", "src1", 0), (904, words(rng, 6000), "en", "src2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).selectExpr("*", "1 AS shard", "'x' AS k", "2 AS salt", "3 AS bucket").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def size(text):
    return len((text or "").encode()) + 1


# 1 sharding


def test_shards_cover_rows_and_balance(docs):
    rows = sharding.plan_shards(docs, 8).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d[0], size(d[1]), zlib.crc32((d[1] or "").encode())) for d in corpus())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())  # equal texts stay together


def spread_of(rows):
    """How far apart the fullest and the emptiest shard are, as shares of the mean, by bytes, tokens and rows."""
    loads = defaultdict(lambda: np.zeros(3))
    for r in rows:
        loads[r.shard] += (r["size"], r.tokens, 1)
    at = np.array([loads[k] for k in range(8)])
    return (at.max(axis=0) - at.min(axis=0)) / at.mean(axis=0)


@pytest.mark.parametrize("fine, cell", [(sharding.FINE, sharding.CELL_UNITS), (2, 150)])
def test_shards_near_equal_with_a_hot_text(spark, monkeypatch, fine, cell):
    """A third of the rows are one text; placed by one task, and in hashed cells."""
    monkeypatch.setattr(sharding, "FINE", fine)
    monkeypatch.setattr(sharding, "CELL_UNITS", cell)
    rng = random.Random(2)
    rows = [(i, "the very same text " * 5 if i % 3 == 0 else words(rng, rng.randint(20, 60)), "en", "s", 0) for i in range(3000)]
    rows += [(None, "the very same text " * 5, "en", "s", 0)] * 200
    got = sharding.plan_shards(spark.createDataFrame(rows, DOCS), 8).collect()
    assert len(got) == len(rows) and (spread_of(got) < 0.03).all()
    hot = zlib.crc32(("the very same text " * 5).encode())
    assert len({r.piece for r in got if r.text_crc32 == hot}) == 64 and {r.piece for r in got if r.text_crc32 != hot} == {None}
    assert max(Counter((r.shard, r.piece) for r in got if r.doc_id is None).values()) < 20


def test_groups_up_to_the_share_of_a_shard_stay_whole(spark):
    rng = random.Random(3)
    texts = [f"copy {g} " + words(rng, 30) for g in range(4)]
    rows = [(i, texts[i % 10] if i % 10 < 4 else words(rng, 30) + f" {i}", "en", "s", 0) for i in range(1000)]  # a tenth of all rows each
    got = sharding.plan_shards(spark.createDataFrame(rows, DOCS), 8).collect()
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and {r.piece for r in got} == {None}
    assert (spread_of(got) < 0.05).all()


def test_place_matches_brute_force():
    rng = np.random.default_rng(0)
    v = rng.random((200, 3))
    got = sharding.place(v, np.full((5, 3), 40.0))
    room = np.full((5, 3), 40.0)
    for x, j in zip(v, got):
        assert np.isclose(room[j] @ x, (room @ x).max())
        room[j] -= x


def test_shards_of_nothing(empty):
    assert sharding.plan_shards(empty, 8).collect() == []


# 2 WARC


def test_warc_round_trip(spark):
    page = "<p>" + "same page " * 40 + "</p>"
    rows = [(3, "http://a/3", page), (1, "http://a/1", page), (1, "http://a/1", page), (7, None, page), (4, "u\r\nx", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (None, "u", page), (9, "u", "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS digest", "1 AS revisit")
    folder = warc.fresh_path(spark, "t")
    index = warc.write_bundles(pages, folder).collect()
    records = warc.read_bundles(spark, folder).collect()
    assert len(records) == len(rows) == len(index)
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = Counter()
    for p, _, h in rows:
        revisit = len((h or "").encode()) >= 100 and p != min(q for q, _, g in rows if g == h and q is not None)
        want[p, len((h or "").encode()), digest(h), "revisit" if revisit else "response", min(q for q, _, g in rows if g == h and q is not None) if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == want
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in records if r.record_type == "response")
    assert Counter((r.page_id, r.url) for r in records) == Counter((p, u) for p, u, _ in rows)
    assert len({r.record_id for r in records}) == len({i.record_id for i in index}) == len(rows)  # repeated rows too
    files = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").load(folder + "/archives").collect()}
    for i in index:  # random access by the index
        r = warc.read_record(files[i.archive], i.frame, i.offset)
        assert (r["record_id"], r["page_id"], r["length"]) == (i.record_id, i.page_id, i.length)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_seek_table_round_trip():
    frames = [(10, 20), (1, 2), (300, 4000)]
    data = b"x" * 311 + warc.seek_table(frames)
    assert warc.read_seek_table(data) == [(0, 10, 20), (10, 1, 2), (11, 300, 4000)]


# 3 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy this now</div>
<article><h1>A title &amp; more</h1><p><b>First  paragraph of\n the article, long enough to count for something.<br><p>Second &eacute; one<!-- no -->, also with a <a href="/x">link</a> inside of it.</p><p>To.</p></article>
<aside>Related stuff</aside><div id="comments"><p>I disagree with all of this, and here is why at length.</p></div><form><input><p>Sign up</p></form><footer>&copy; someone</footer></body></html>"""


def test_html_article_only():
    want = "A title & more\n\nFirst paragraph of the article, long enough to count for something.\n\nSecond é one, also with a link inside of it.\n\nTo."
    assert html_density.main_text(PAGE) == want


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<nav>only</nav>"])
def test_html_without_text(html):
    assert html_density.main_text(html) == ""


def test_html_odd_pages():
    assert html_density.main_text("plain words") == "plain words"
    assert html_density.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert html_density.main_text("<article><h1>T</h1><p>cut off &am") == "T\n\ncut off &am"
    body = "<p>" + "long text here. " * 3000 + "</p>"
    assert html_density.main_text(f"<body><article>{body}</article></body>") == ("long text here. " * 3000).strip()


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string").selectExpr("*", "'t' AS text")
    got = sorted((r.page_id, r.n_chars) for r in html_density.extract_main_text(pages).collect())
    n = len(html_density.main_text(PAGE))
    assert got == [(1, n), (1, n), (2, 0)]


# 4 mixing


def test_poisson_counts_match_brute_force(docs):
    weights = {"src0": 0.2, "src1": 0.5, "src2": 0.3, "absent": 0.4}
    got = Counter()
    for r in mixing.mix_sources(docs, weights, seed=3).collect():
        got[r.doc_id, r.text] += 1
    sizes = Counter()
    for d in corpus():
        if d[3] in weights:
            sizes[d[3]] += size(d[1]) - 1
    total = sum(weights[s] for s in sizes)
    want = Counter()
    for doc_id, text, _, source, _ in corpus():
        key = f"3|{'' if doc_id is None else doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        if source not in sizes:
            want[doc_id, text] += 1
            continue
        rate = weights[source] / total * sum(sizes.values()) / sizes[source]
        k, p = 0, np.exp(-rate)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        if k:
            want[doc_id, text] += k
    assert got == want


def test_mixing_high_rates_and_columns(spark, empty):
    rows = [(i, "tiny" if i < 5 else "big " * 400, "en", "a" if i < 5 else "b", 0) for i in range(50)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), {"a": 0.5, "b": 0.5}, epochs=2.0)
    n = Counter(r.source for r in out.collect())
    assert 0.7 < n["a"] * 4 / (n["b"] * 1600) < 1.3
    assert mixing.mix_sources(empty, {"a": 1.0}).collect() == []
    assert abs(mixing.poisson_steps(30.0)[-1] - 1) < 1e-9 and mixing.poisson_steps(0.0) == [1.0]


def test_mixing_is_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# 5 decontamination


def brute_tiles(item, doc, least):
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(t[0] for t in tiles)
        n, i, j = best
        for x in range(n):
            free_i[i + x] = free_d[j + x] = False
        tiles.append(best)


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randint(0, 5) for _ in range(rng.randint(5, 25))]
        doc = [rng.randint(-1, 5) for _ in range(rng.randint(0, 40))]
        got = decontam.greedy_tiles(np.array(item), np.array(doc), 3)
        assert sum(t[2] for t in got) == brute_tiles(item, doc, 3)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in got)


def test_leaks(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    bench = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, "one two three"), (1, item)], "item_id long, text string")
    rows = [(1, "x " * 50 + item + " y", None, None, 0), (2, " ".join(w[6:] + ["and", "then"] + w[:6]), None, None, 0), (3, " ".join(w[:5]), None, None, 0), (4, "so ONE, two three!", None, None, 0), (5, None, None, None, 0), (6, "", None, None, 0)]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "5 AS coverage", "6 AS item_id")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontam.find_leaks(d, bench).collect()}
    assert got == {(1, 1): (1.0, 1), (2, 1): (1.0, 2), (4, 4): (1.0, 1)}
    assert sorted(r.doc_id for r in decontam.drop_leaks(d, bench).collect()) == [3, 5, 6]
    assert decontam.find_leaks(empty, bench).collect() == [] and decontam.find_leaks(d, bench.limit(0)).collect() == []


def test_leaks_against_brute_force(spark):
    """Whole queries, with the benchmark sent to the tasks and joined by seeds: equal to tiling every pair."""
    rng = random.Random(14)
    bench = [(i, words(rng, rng.randint(1, 40), 60)) for i in range(25)] + [(25, "Only, Two"), (25, "only two"), (26, "..."), (27, None), (28, "solo")]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 30), 60)]
        for _ in range(rng.randint(0, 2)):
            t = (bench[rng.randrange(25)][1]).split()
            cut = rng.randint(0, len(t))
            parts += [" ".join(t[cut:]), words(rng, rng.randint(0, 3), 60), " ".join(t[:cut])]
        rows.append((i, " ".join(parts) + rng.choice(["", " only two", " Solo!"]), "en", "s", 0))
    rows += [(3, rows[3][1], "en", "s", 0), (70, None, None, None, 0), (None, rows[4][1], None, None, 0)]
    want = Counter()
    items = {(i, tuple(decontam.words_of(t))) for i, t in bench}
    for doc_id, text, *_ in rows:
        doc = decontam.words_of(text)
        for item_id, w in items:
            if not w:
                continue
            ids = {x: n for n, x in enumerate(w)}
            covered = brute_tiles([ids[x] for x in w], [ids.get(x, -1) for x in doc], min(5, len(w)))
            if covered >= 0.8 * len(w):
                want[doc_id, item_id, covered] += 1
    assert len(want) > 20
    d, b = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row", "2 AS item"), spark.createDataFrame(bench, "item_id long, text string")
    leaking = Counter()
    for doc_id, text, *_ in rows:
        leaking[doc_id] += not any(k[0] == doc_id for k in want)
    for block_bytes in (decontam.BLOCK_BYTES, 0):
        got = Counter((r.doc_id, r.item_id, r.covered_words) for r in decontam.find_leaks(d, b, block_bytes=block_bytes).collect())
        assert got == want
        kept = decontam.drop_leaks(d, b, block_bytes=block_bytes)
        assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == +leaking


def test_repetitive_texts_are_tiled_in_time():
    """A place is visited once however often a run is repeated: these would be ten million pairs a width."""
    item = decontam.words_of("a b c d " * 300)
    index = decontam.ItemIndex([(1, " ".join(item))])
    began = time.process_time()
    found = decontam.leaks_in(index, "a b c d " * 40_000, 0.8)
    assert [f[2] for f in found] == [1200] and time.process_time() - began < 20


# 6 fertility


def brute_base(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_base_figures():
    rng = random.Random(5)
    texts = ["", " ", "a", "a b c", "a b c d a b c", "x\n\n x \nx\nx", "a\xa0b\x1cc d e", "é#*$ | <b>\x0b\x0c\r\n", "z " * 40]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) + rng.choice(["", "\n", "\n\t"]) for _ in range(80)]
    for t in texts:
        assert fertility.base_figures(t) == brute_base(t), t


def test_fertility_query(docs, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.base_failed) for r in fertility.measure_fertility(docs).collect())
    want = Counter()
    for d in corpus():
        n, c, *_, rep = brute_base(d[1] or "")
        want[d[0], n, c, n < 50 or 100 * rep > 50 * n] += 1
    assert got == want
    kept = fertility.keep_fluent(docs)
    assert kept.columns == docs.columns
    flags = Counter(r.doc_id for r in fertility.measure_fertility(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == flags
    assert fertility.measure_fertility(empty).collect() == []


def test_fertility_bands_split_prose_from_junk():
    import os

    if not os.path.exists(fertility.VOCABULARY):
        pytest.skip("no vocabulary here")
    v = fertility.vocabulary(open(fertility.VOCABULARY, "rb").read())
    prose = "The quick brown fox jumps over the lazy dog while many other animals watch from the hills above the old town. " * 1
    assert fertility.in_band("en", v.measures(prose))
    assert not fertility.in_band("en", v.measures("$#*& %%^ ||| <> " * 30))
    assert v.measures("") is None and not fertility.in_band("en", None)
    assert fertility.band_of("xx", "Привет мир") == "script:cyrillic" and fertility.band_of(None, "漢字かな") == "script:cjk"


# 7 licences


def test_template_join_against_brute_force():
    rng = random.Random(6)
    templates = [(f"l{i}", " ".join(f"t{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12)))) for i in range(12)]
    frequency = {f"t{i}".encode(): rng.randint(0, 50) for i in range(31)}
    for threshold in (0.5, 0.8, 0.9, 1.0):
        index = license_scan.TemplateIndex(templates, frequency, threshold)
        for _ in range(200):
            block = {f"t{rng.randint(0, 35)}".encode() for _ in range(rng.randint(0, 25))}
            want = [(i, len(set(t.encode().split()) & block) / len(set(t.split()))) for i, (_, t) in enumerate(templates)]
            want = [(i, c) for i, c in want if c >= threshold - 1e-9]
            assert index.matches(block) == want


def test_license_query(spark, empty):
    rows = [
        (1, "x\nReleased under the MIT License.\nno", "en", "s", 0), (2, "the mit\nlicense, and MIT  License", "en", "s", 0), (3, None, None, None, 0), (4, "", None, None, 0),
        (5, "Licensed under CC BY-NC 4.0.", "en", "s", 0), (6, "licensed under nothing", "en", "s", 0), (5, "Licensed under CC BY-NC 4.0.", "en", "s", 0),
    ]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "'q' AS labels", "2 AS score")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_scan.scan_licenses(d).collect())
    want = Counter([
        (1, 7, 1, 4, 4, "mit", "mit", 1.0), (2, 6, 2, 1, 4, "mit", "mit", 1.0), (3, 0, 0, None, None, "", "", 0.0), (4, 0, 0, None, None, "", "", 0.0),
        (5, 7, 0, None, None, "", "cc-by-nc", 1.0), (5, 7, 0, None, None, "", "cc-by-nc", 1.0), (6, 3, 0, None, None, "", "", 0.0),
    ])
    assert got == want
    assert license_scan.scan_licenses(empty).collect() == []


# 8 and 10: learned scores


def labelled(seed=7, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        text = words(rng, 80)
        if bad:
            text = " ".join(x + rng.choice(["***", "###", "$$$"]) for x in text.split())
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "awful", "rotten"]))
            text = " ".join(w)
        docs.append((i, text, "en", "s", 0))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(None, None, None, None, None), (5000, "", "en", "s", 0), (0, docs[0][1], "en", "s", 0)]
    labels += [(None, 1, 1), (7, None, None), (9999, 0, 1), (3, 1, None)]
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def accuracy(rows, labels, column, held):
    truth = {x[0]: x[column] for x in labels if x[0] is not None and x[0] < 400 and x[column] is not None}
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert own and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % held[0] == held[1]) for r in rows if r.doc_id is not None)
    return np.mean([r.predicted == truth[r.doc_id] for r in own])


def test_quality_on_held_out_fold(spark, empty):
    docs, labels = labelled()
    d, lab = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS quality", "2 AS y"), spark.createDataFrame(labels, LABELS)
    rows = pairwise_rank.score_quality(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, 1, (5, 0)) > 0.95
    assert pairwise_rank.score_quality(empty, lab).collect() == []
    only = pairwise_rank.score_quality(d, lab.filter("quality = 1")).collect()
    assert {r.score for r in only} == {1.0}
    assert {r.score for r in pairwise_rank.score_quality(d, lab.limit(0)).collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, DOCS)
    flipped = [(i, (1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q), t) for i, q, t in labels]
    score = lambda x: sorted((r.doc_id or -1, r.score) for r in pairwise_rank.score_quality(d, spark.createDataFrame(x, LABELS)).collect())
    assert score(labels) == score(flipped)


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (200, 3)), rng.normal(0, 1, (150, 3))
    w = pairwise_rank.fit_bradley_terry(good, bad)
    assert (good @ w).mean() > (bad @ w).mean() and np.allclose(w, pairwise_rank.fit_bradley_terry(good, bad))


def test_toxicity_on_held_out_fold(spark, empty):
    docs, labels = labelled()
    d, lab = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS toxic", "2 AS y"), spark.createDataFrame(labels, LABELS)
    rows = toxicity.score_toxicity(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, 2, (4, 2)) > 0.95
    assert toxicity.score_toxicity(empty, lab).collect() == []
    assert {r.score for r in toxicity.score_toxicity(d, lab.limit(0)).collect()} == {0.0}


def test_block_max_search_is_exact():
    rng = random.Random(8)
    idf = np.array([rng.random() + 0.1 for _ in range(30)])

    def some():
        terms = sorted({rng.randrange(30) for _ in range(rng.randint(0, 6))})
        return np.array(terms, np.uint64), np.array([rng.randint(1, 4) for _ in terms], int)

    texts = [some() for _ in range(300)]
    starts = np.cumsum([0] + [len(t) for t, _ in texts])
    terms, times = (np.concatenate([x[k] for x in texts]).astype(int) for k in (0, 1))
    index = toxicity.BlockMaxIndex(idf, toxicity.Examples(np.arange(30, dtype=np.uint64), list(range(300)), [rng.randint(0, 1) for _ in range(300)], starts, terms, times))
    dense = np.zeros((300, 30))
    for i, (no, w) in enumerate(index.vectors):
        dense[i, no] = w
    for _ in range(100):
        no, w = index.vector(*some())
        q = np.zeros(30)
        q[no] = w
        sims = dense @ q
        want = [i for i in np.lexsort((np.arange(300), index.rank[index.of], -np.round(sims, 12))) if sims[i] > 0][:15]
        got, s = index.nearest(no, w)
        assert got.tolist() == want and np.allclose(s, sims[want])


def test_toxic_neighbours_use_every_term(spark):
    """Texts without a term of any label still have the neighbours of their whole text, as a dense computation finds them."""
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randint(5, 60)) + (f" only{i}" if i % 3 else " vile"), "en", "s", 0) for i in range(150)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(150)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(len(r.evidence) == 15 for r in got.values())
    train = [i for i in range(150) if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = [Counter(re.findall(r"[^\W\d_]+", r[1].lower())) for r in rows]
    for c in counts:
        for w, n in list(c.items()):
            if len(w) > toxicity.STEM:
                c[w[: toxicity.STEM] + "*"] += n
    g2 = {}
    n = [sum(1 for i in train if labels[i][2] == y) for y in (0, 1)]
    for t in {t for i in train for t in counts[i]}:
        c = [sum(1 for i in train if labels[i][2] == y and t in counts[i]) for y in (0, 1)]
        cells = [(got, part * n[y] / sum(n)) for y in (0, 1) for got, part in ((c[y], sum(c)), (n[y] - c[y], sum(n) - sum(c)))]
        g2[t] = sum(2 * got * np.log(got / e) for got, e in cells if got)
    df = Counter(t for c in counts for t in c)
    idf = lambda t: np.log(151 / (1 + df[t])) + 1 if t in g2 else np.log(151 / 2) + 1
    v = [{t: (1 + np.log(n)) * idf(t) * np.sqrt(1 + g2.get(t, 0)) for t, n in c.items()} for c in counts]
    norm = [np.sqrt(sum(x * x for x in u.values())) for u in v]
    for q in range(150):
        sims = {i: sum(x * v[i].get(t, 0) for t, x in v[q].items()) / norm[q] / norm[i] for i in train}
        want = sorted((i for i in train if i != q), key=lambda i: (-round(sims[i], 12), i))[:15]
        assert np.allclose(sorted(got[q].similarity, reverse=True), [sims[i] for i in want])
        assert list(got[q].evidence) == want


def test_rare_terms_and_equal_examples_are_searched_exactly(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", 8)
    test_block_max_search_is_exact()


# 9 near-duplicates


def brute_classes(rows, threshold=0.8):
    texts = [re.findall(r"\w+", (r[1] or "").lower()) for r in rows]
    df = Counter(w for t in texts for w in set(t))
    top = np.log(len(rows) + 1)
    sets = []
    for t in texts:
        width = min(5, len(t))
        tf = Counter(tuple(t[i : i + width]) for i in range(len(t) - width + 1)) if t else {}
        sets.append({x: (1 + np.log(n)) * (0.5 + 0.5 * np.mean([np.log((len(rows) + 1) / df[w]) / top for w in x])) for x, n in tf.items()})

    def similar(i, j):
        low = sum(min(x, sets[j].get(k, 0)) for k, x in sets[i].items())
        high = sum(sets[i].values()) + sum(sets[j].values()) - low
        return bool(high) and low / high >= threshold

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similar(i, j):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i][0])
    return sorted(sorted(-1 if x is None else x for x in v) for v in out.values())


def near_copies(seed=9):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(w), "en", "s", 0))
            n += 1
    # a group whose members are mostly unlike each other but linked in chains
    base = [f"h{i}" for i in range(150)]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"other{rng.randint(0, 30)}"
        rows.append((n, " ".join(w), "en", "s", 0))
        n += 1
    return rows + [(500, None, None, None, 0), (501, "", None, None, 0), (502, "two words", None, None, 0), (503, "Two, words!", None, None, 0), (3, rows[3][1], "en", "s", 0), (None, rows[4][1], "en", "s", 0), (504, "!!", "en", "s", 0)]


def test_near_duplicates_against_brute_force(spark, empty):
    rows = near_copies()
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS class_id", "2 AS bands")
    got = icws.near_duplicates(d).collect()
    assert len(got) == len(rows)
    classes = defaultdict(list)
    for r in got:
        classes[r.class_id].append(-1 if r.doc_id is None else r.doc_id)
    assert sorted(sorted(v) for v in classes.values()) == brute_classes(rows)
    assert all(min(x for x in v if x >= 0) == c for c, v in classes.items())
    kept = icws.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    assert icws.near_duplicates(empty).collect() == []


def test_near_duplicates_with_hot_buckets(spark, monkeypatch):
    """The same classes where every bucket of more than two counts as hot."""
    monkeypatch.setattr(icws, "HOT", 2)
    rows = near_copies(seed=19)
    classes = defaultdict(list)
    for r in icws.near_duplicates(spark.createDataFrame(rows, DOCS)).collect():
        classes[r.class_id].append(-1 if r.doc_id is None else r.doc_id)
    assert sorted(sorted(v) for v in classes.values()) == brute_classes(rows)


def test_word_frequencies_are_exact(spark, monkeypatch):
    monkeypatch.setattr(icws, "PENDING", 50)
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 60), 90), "en", "s", 0) for i in range(200)] + [(200, None, None, None, 0)]
    want = Counter(w for r in rows for w in set((r[1] or "").split()))
    w, n, n_docs = icws.word_frequencies(spark.createDataFrame(rows, DOCS))
    assert n_docs == 201 and dict(zip(w.tolist(), n.tolist())) == {icws.word_hashes(x)[0].item(): c for x, c in want.items()}
    monkeypatch.setattr(icws, "RARE", 0.25)
    w, n, _ = icws.word_frequencies(spark.createDataFrame(rows, DOCS))
    assert sorted(n.tolist()) == sorted(c for c in want.values() if c >= 0.25 * 201)


def test_weights_do_not_depend_on_the_size_of_the_corpus():
    """The same shares of documents give the same similarity in a tiny corpus, in ten copies of it and in a very large one."""
    a, b = (" ".join(f"w{i if i != k else 99}" for i in range(60)) for k in (10, 30))
    h = np.sort(np.unique(icws.word_hashes(a + " " + b)))
    share = np.random.default_rng(2).integers(1, 64, len(h)) / 64
    found = []
    for n in (64, 640, 10**10):
        sampler = icws.Sampler(h, share * n, n)
        found.append(icws.weighted_jaccard(sampler.weighted(a), sampler.weighted(b)))
    assert max(found) - min(found) < 1e-12


def test_word_hashes_follow_words():
    rng = random.Random(11)
    for text in ["", " ", "a", "Ab aB ab_1 ab-1", "é É e\u0301 ß ẞ", "漢字 kana カナ", "x\x00y \u2014 \U0001F600 ٣٤", "z" * 5000] + ["".join(rng.choice("abAB _-.é") for _ in range(60)) for _ in range(60)]:
        words = re.findall(r"\w+", text.lower())
        h = icws.word_hashes(text).tolist()
        assert len(h) == len(words)
        assert all((words[i] == words[j]) == (h[i] == h[j]) for i in range(len(words)) for j in range(i))
    long = " ".join(rng.choice(["ab", "cde", "x" * 300]) for _ in range(400))
    whole, small = icws.word_hashes(long).tolist(), word_hash.CHUNK
    for chunk in (7, 100, 5000):
        word_hash.CHUNK = chunk
        try:
            assert icws.word_hashes(long).tolist() == whole and icws.word_hashes("y" * 50).tolist() == icws.word_hashes("y" * 50).tolist()
        finally:
            word_hash.CHUNK = small
    assert icws.word_hashes("same")[0] == icws.word_hashes("not at the same place")[3]


def test_samples_agree_as_often_as_the_weighted_jaccard():
    sampler = icws.Sampler(np.empty(0, np.uint64), np.empty(0), 1000)
    rng = np.random.default_rng(3)
    hits = total = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        y = np.unique(np.concatenate([x[:50], rng.integers(0, 2**63, 10).astype(np.uint64)]))
        wx, wy = np.ones(len(x)), np.ones(len(y))
        a, b = sampler.bands(x, wx), sampler.bands(y, wy)
        hits += int((a == b).sum())
        total += len(a)
    j = 50 / 70
    assert abs(hits / total - j**icws.ROWS) < 0.04


def test_delta_prefix_keeps_every_link():
    """Members of one bucket: every pair at the threshold shares a prefix element and passes the filters."""
    rng = random.Random(10)
    sampler = icws.Sampler(np.empty(0, np.uint64), np.empty(0), 1000)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [f"e{rng.randint(0, 12)}"]
        texts.append(" ".join(w))
    m = [sampler.weighted(t) for t in texts]
    hub, c = m[0], (1 - 0.8) / (1 + 0.8)
    out = [icws.weighted_jaccard(x, hub) < 0.8 for x in m]
    pre = [icws.delta_prefix(x, hub, o, 0.8) for x, o in zip(m, out)]
    links = 0
    for i in range(1, len(m)):
        for j in range(1, len(m)):
            if out[i] and i != j and icws.weighted_jaccard(m[i], m[j]) >= 0.8 and texts[i] != texts[j]:
                links += 1
                shared = {}
                for k in (i, j):
                    for e, r in zip(pre[k][0].tolist(), pre[k][1].tolist()):
                        shared.setdefault(e, []).append(r)
                need = (pre[i][2] + pre[j][2] - c * (m[i][1].sum() + m[j][1].sum())) / 2 - 1e-9
                assert any(len(r) == 2 and min(r) >= need for r in shared.values())
    assert links > 20
