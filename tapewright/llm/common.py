"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts over which the rows of one text are dealt, so that a text that a third of all
#: rows share still reaches tasks in pieces of one half per cent.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is
    set; a temporary folder only for a local master, where all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tapewright-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a
    lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`cut` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_key(text: Column) -> Column:
    """128-bit key of a text's bytes; equal texts, and null and empty ones, share it."""
    return F.unhex(F.md5(utf8(text)))


def salt_of(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column of the input by name, or nulls of that type where it has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def unused(name: str, columns: list[str]) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
