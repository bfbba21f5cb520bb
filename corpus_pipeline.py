"""A training corpus in five stages: quality rules, near-duplicates, benchmark decontamination,
mixing by source, shards.  Each stage is written as Parquet and read again as the next
one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import decontam, fertility, icws, mixing, sharding
from tapewright.llm.common import cut, unused
from tapewright.session import prepare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules and the base rules keep.  Null and empty texts fail the base rules; repeated
    rows are judged each; an unknown or null language is judged by its script; all columns stay."""
    return fertility.keep_fluent(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class; null doc_ids come last.  Of repeated rows one stays, and null
    and empty texts are one class; all columns stay, whatever their names."""
    return icws.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.  Null and empty texts and an empty benchmark leak nothing; repeated rows are
    judged each; all columns stay."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson counts.  Null sources keep their rate of one; repeated rows (of equal doc_id and
    text) get the same count; all columns stay, whatever their names."""
    replica, mix_key = unused("replica", docs.columns), unused("mix_key", docs.columns)
    return mixing.mix_sources(docs, replica=replica, mix_key=mix_key).select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, null and empty texts and repeated rows too; other columns are ignored."""
    return sharding.plan_shards(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: The stages for tokens, samples and greedy choices cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
