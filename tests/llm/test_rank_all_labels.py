import random

from pyspark.sql import functions as F

from tapewright.llm import pairwise_rank


def test_labels_beyond_four_thousand_count(spark):
    rng = random.Random(2)
    order = [r[0] for r in spark.range(10_000).orderBy(F.xxhash64("id"), "id").collect()]
    good = [i for i in order if i % 2]
    late = set(good[4000:])  # good ones that look like bad ones but for a mark of their own

    def text(i):
        words = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(20, 30))]
        return (" ! | " if i in late else " " if i % 2 else " | ").join(words)

    docs = spark.createDataFrame([(i, text(i)) for i in range(10_000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    rows = pairwise_rank.score_quality(docs, labels).collect()
    hits = [r.predicted == r.doc_id % 2 for r in rows if r.held_out]
    assert sum(hits) > 0.97 * len(hits)
    assert all(r.predicted for r in rows if r.doc_id in late)
    again = pairwise_rank.score_quality(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted(rows) == sorted(again)


def test_ranks_by_bins(spark, monkeypatch):
    monkeypatch.setattr(pairwise_rank, "BINS", 4)
    monkeypatch.setattr(pairwise_rank, "AT_ONCE", 3)
    rng = random.Random(1)
    values = [rng.choice([0.0, 0.5, rng.random() ** 9, -rng.random()]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [pairwise_rank.value_at(df, "s", k) for k in (0, 17, 150, 299)] == [sorted(values)[k] for k in (0, 17, 150, 299)]
