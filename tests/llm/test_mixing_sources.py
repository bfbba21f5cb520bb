"""Without weights, every source found is mixed, whatever its name and however many there are."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapewright.llm import mixing

DOCS = "doc_id long, text string, source string"


def counted(df):
    return Counter((r.doc_id, r.source) for r in df.collect())


def rows(spark):
    return spark.createDataFrame([(i, "word " * 20, "hot" if i % 2 else f"site{i % 30}") for i in range(3000)] + [(9000, "x", None)], DOCS)


def test_sources_of_any_name_are_mixed(spark):
    n = Counter(s for _, s in counted(mixing.mix_sources(rows(spark))).elements())
    assert n[None] == 1 and len(n) == 17
    assert n["hot"] < 400 and all(100 < n[s] < 300 for s in n if s)


def test_table_of_many_sources_gives_the_same(spark, monkeypatch):
    want = counted(mixing.mix_sources(rows(spark)))
    tiny = rows(spark).union(spark.createDataFrame([(9001, "t", "tiny")], DOCS))
    also = counted(mixing.mix_sources(tiny))
    monkeypatch.setattr(mixing, "MAX_CONSTANTS", 2)
    assert counted(mixing.mix_sources(rows(spark))) == want
    assert counted(mixing.mix_sources(tiny)) == also and also[9001, "tiny"] > 1000


@pytest.mark.parametrize("constants", [mixing.MAX_CONSTANTS, 1])
def test_tiny_sources_draw_in_blocks(spark, monkeypatch, constants):
    """The same counts, in blocks or not, and replicas from 0 without gaps; a bound on rates holds."""
    monkeypatch.setattr(mixing, "MAX_CONSTANTS", constants)
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(1, "x", "tiny"), (1, "x", "tiny"), (2, "yz", "tiny")] + [(i, "z" * 4000, "big") for i in range(10, 30)], schema)
    sums = {}
    for at_once in (64, 10**6):
        monkeypatch.setattr(mixing, "PARTS_AT_ONCE", at_once)
        out = mixing.mix_sources(docs)
        assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
        rows = out.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("replica").alias("last"), F.count_distinct("replica").alias("each")).collect()
        sums[at_once] = sorted((r.doc_id, r.n) for r in rows)
        assert all(r.last == r.each - 1 for r in rows)
    assert sums[64] == sums[10**6] and dict(sums[64])[1] % 2 == 0 and 9000 < dict(sums[64])[2] < 11000
    assert mixing.mix_sources(docs, most_epochs=3.0).filter("source = 'tiny'").count() < 30
