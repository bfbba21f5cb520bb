"""The pipeline's stages, one after the other, against their operators' own verdicts."""

import random
from collections import Counter

import corpus_pipeline
from tapewright.llm import decontam, fertility, icws
from tapewright.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing sources", "sharding"]


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s1 = corpus_pipeline.quality(spark, docs, SF).cache()
    assert {r.doc_id for r in s1.collect()} == {r.doc_id for r in fertility.measure_fertility(docs).collect() if r.kept}
    s2 = corpus_pipeline.near_duplicates(spark, s1, SF).cache()
    assert {r.doc_id for r in s2.collect()} == {r.class_id for r in icws.near_duplicates(s1).collect()}
    s3 = corpus_pipeline.decontaminate(spark, s2, SF).cache()
    leaks = {r.doc_id for r in decontam.find_leaks(s2, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in s3.collect()} == {r.doc_id for r in s2.collect()} - leaks
    s4 = corpus_pipeline.mix(spark, s3, SF).cache()
    assert s1.columns == s2.columns == s3.columns == s4.columns == docs.columns
    s5 = corpus_pipeline.shard(spark, s4, SF)
    assert Counter(r.doc_id for r in s5.collect()) == Counter(r.doc_id for r in s4.collect())


def odd_docs(spark):
    """Nulls, ties, repeated rows, very long and empty texts, and columns with the operators' own names."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["the", "a", "house", "river", "green", "walks", "under", "morning", "light", "stone", "of", "with"]) + rng.choice(["", "", "s", "ly"]) for _ in range(n))
    texts = [prose(rng.randint(60, 200)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "xx", None]), rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s1"), (100, texts[1], "en", "s1"), (101, texts[2] + " end", "en", "s2"), (None, texts[3], None, None), (None, None, None, None)]
    rows += [(102, "", "en", "s1"), (103, " " * 1_000_000, "en", "s1"), (104, prose(60_000), "en", "s2"), (105, "x" * 500_000, "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", "cast(length(text) as long) AS n_chars", "1 AS pick", "2 AS k", "3 AS row", "4 AS replica", "5 AS mix_key", "6 AS __draw", "7 AS __count", "8 AS kept", "9 AS bands", "10 AS bytes", "11 AS salt")


def test_stages_take_odd_rows_and_clashing_columns(spark):
    docs = odd_docs(spark)
    s1 = corpus_pipeline.quality(spark, docs, SF)
    verdicts = [r.kept for r in fertility.measure_fertility(docs).collect()]
    assert len(verdicts) == docs.count() and s1.count() == sum(verdicts) > 30
    s2 = corpus_pipeline.near_duplicates(spark, s1.cache(), SF).cache()
    assert 0 < s2.count() < s1.count() and len({r.text for r in s2.collect()}) == s2.count()
    s3 = corpus_pipeline.decontaminate(spark, s2, SF).cache()
    s4 = corpus_pipeline.mix(spark, s3, SF).cache()
    for s in (s1, s2, s3, s4):
        assert s.columns == docs.columns
        assert {(r.pick, r.k, r.row, r.replica, r.mix_key, r["__draw"], r["__count"], r.kept, r.bands, r.bytes, r.salt) for r in s.collect()} == {tuple(range(1, 12))}
    shards = corpus_pipeline.shard(spark, s4, SF).collect()
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in s4.collect())


def test_stages_on_an_empty_table(spark):
    docs = odd_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (name == "sharding" or out.columns == docs.columns)


def test_queries_are_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(oracle_sql()) <= set(names)
