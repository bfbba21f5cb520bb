"""Phrases, tickers and relevance against plain Python; content-addressed ingest run twice."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tapewright.operators import entities as N
from tapewright.sources import content

TEXTS = "id int, text string, source string"


def plain(text):
    return re.sub(" +", " ", re.sub(r"[^a-z0-9\- ]+", " ", (text or "").lower())).strip()


def test_company_phrases_of_legal_names(spark):
    names = ["The North Ridge Company Limited", "Widgets Limited", "Iron & Stone Works Co. Ltd.", "ab cd", None, "", "Red-Leaf Motor (Pvt.) Ltd", "THE the Waller Corp", "Coal Companyland Mine"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select(N.company_phrase(F.col("n")), "i").orderBy("i").collect()]
    assert got == ["north ridge", None, "iron stone works", None, None, None, "red-leaf motor", "the waller", "coal companyland mine"]


def test_thousands_of_phrases_against_plain_python(spark):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.expovariate(0.05))}"
    phrases = [" ".join(word() for _ in range(rng.randint(2, 5))) for _ in range(4000)] + [None, "common start of one", "common start of two", "common start"]
    texts = [(i, ", ".join(word().upper() if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 80))), "s") for i in range(150)]
    texts += [(900, None, None), (901, "", "s"), (902, "common start of", "s"), (903, "uncommon start; COMMON   start\nof Two.", "s"), (904, "common start of one " * 5000, "s"), (905, "common", "s")]
    got = sorted(map(tuple, N.phrase_hits(spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame([(p,) for p in phrases * 2], "phrase string"), "id").collect()))
    want = sorted({(i, p) for i, t, _ in texts for p in phrases if p and f" {p} " in f" {plain(t)} "})
    assert got == want and len(want) > 300
    assert N.phrase_hits(spark.createDataFrame([], TEXTS), spark.createDataFrame([("a b",)], "phrase string"), "id").count() == 0


def test_an_ambiguous_ticker_needs_company(spark):
    texts = [
        (1, "CAN gains seats", "x"), (2, "CAN and dividend news", "x"), (3, "CAN with north ridge today", "x"), (4, "NRTH rises", "x"), (5, "harbour weather", "x"), (6, "harbour weather", "bureau"),
        (7, "nrth rises", "x"), (8, None, None), (9, "AAA CAN", "x"), (10, "CAN ZZZ", "x"), (11, "NRTHO XNRTH", "x"),
    ]
    tickers = spark.createDataFrame([("nrth",), ("CAN",), ("AAA",), ("ZZZ",)], "ticker string")
    got = {r.id: (r.score, r.passes, r.reasons) for r in N.entity_relevance(
        spark.createDataFrame(texts, TEXTS), tickers, spark.createDataFrame([("north ridge",)], "phrase string"), {"corporate": {"dividend": 3, "gains": -1}, "geo": {"harbour": 1}}, "id",
        watch=("NRTH",), ambiguous=("CAN",), source_bonus={"bureau": 3},
    ).collect()}
    assert got[1] == (0, False, "corporate:gains(-1);ticker(ignored):CAN;context only")
    assert got[2] == (7, True, "corporate:dividend(3);ticker(backed):CAN") and got[3] == (8, True, "company:north ridge;ticker(backed):CAN")
    assert got[4] == (5, True, "ticker:NRTH;watchlist:NRTH") and got[5] == (0, False, "geo:harbour(1);context only") and got[6] == (4, True, "geo:harbour(1);source:+3")
    assert got[7] == got[8] == got[11] == (0, False, "context only")
    assert got[9] == (4, True, "ticker:AAA") and got[10][2] == "ticker:ZZZ;ticker(ignored):CAN"


def test_content_is_taken_in_once(spark, tmp_path):
    folder, store = tmp_path / "in", f"file://{tmp_path}/store"
    (folder / "sub").mkdir(parents=True)
    files = {"a.bin": b"same", "sub/b.bin": b"same", "c.bin": b"other", "empty.bin": b""}  # Spark reads no empty file
    for name, data in files.items():
        (folder / name).write_bytes(data)
    assert content.ingest_files(spark, str(folder), store) == 2
    assert content.ingest_files(spark, str(folder), store) == 0
    (folder / "d.bin").write_bytes(b"third")
    (folder / "e.bin").write_bytes(b"other")
    assert content.ingest_files(spark, str(folder), store) == 1
    rows = spark.read.parquet(store).collect()
    assert sorted(r.sha256 for r in rows) == sorted(hashlib.sha256(d).hexdigest() for d in (b"same", b"other", b"third"))
    same = next(r for r in rows if r.n_bytes == 4)
    assert same.first_path.endswith("/a.bin") and same.copies == 2 and bytes(same.content) == b"same"
