"""Content-addressed ingest: the digest of the bytes is the key, so the same file taken in twice, or under two names, is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def addressed(items: DataFrame, content: Column, path: Column, at: Column) -> DataFrame:
    """(sha256, n_bytes, content, first_path, first_at, copies), a row for each content: the earliest item, by time and then by path, stands for the others.
    Null contents are left out.  Contents are shuffled once, and by digest only the first of each task's goes on."""
    own = items.select(F.sha2(content, 256).alias("sha256"), content.alias("content"), path.alias("path"), at.alias("at")).filter("content IS NOT NULL")
    first = F.min(F.struct("at", "path", "content"))
    out = own.groupBy("sha256").agg(first.alias("f"), F.count("*").alias("copies"))
    return out.select("sha256", F.octet_length("f.content").cast("long").alias("n_bytes"), F.col("f.content").alias("content"), F.col("f.path").alias("first_path"), F.col("f.at").alias("first_at"), "copies")


def new_only(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose digest is not stored yet; only digests of the store are read."""
    return rows.join(known.select("sha256"), "sha256", "left_anti")


def ingest_files(spark: SparkSession, folder: str, store: str, pattern: str = "*") -> int:
    """Take the files of a folder and its subfolders into the Parquet store and say how many contents were new.  A run that is broken off or comes twice adds
    nothing twice: what is there is left out before the append.  Empty files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = addressed(files, F.col("content"), F.col("path"), F.col("modificationTime"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    before = spark.read.parquet(store).count() if exists else 0
    (new_only(rows, spark.read.parquet(store)) if exists else rows).write.mode("append").parquet(store)
    return spark.read.parquet(store).count() - before
