"""Structured Streaming: windows with watermarks, minute de-duplication, pace against a baseline, and a
stateful accumulator that alerts once per symbol, kind and day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of a growing folder, or of one file, as a stream.  What lies there already is in no order of time, so
    it is one trigger unless ``files_per_trigger`` says otherwise: else the watermark drops whole files as late."""
    schema = spark.read.parquet(path).schema
    folder, glob = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    events = reader.option("pathGlobFilter", glob).parquet(folder) if is_file else reader.parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there to the end and read what was written."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Counts and sums by kind of event and window, given out once the watermark has passed its end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_per_minute(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """One event for each kind and minute; keys leave the state once the watermark passes them."""
    return events.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("minute", late).dropDuplicates(["event_type", "minute"])


def volume_pace(events: DataFrame, baseline: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Stream joined to a static baseline by kind and hour; rows whose value is far beyond it."""
    e = events.withColumn("hour", F.hour("ts"))
    return e.join(baseline, ["event_type", "hour"]).withColumn("pace", F.col("value") / F.col("usual")).filter(F.col("pace") >= threshold)


ALERT = "event_type string, day string, kind string, at timestamp, level double"
STATE = "day string, total double, high double, low double, fired string"


def accumulator_alerts(events: DataFrame, extreme: float = 3000.0, spread: float = 200.0) -> DataFrame:
    """A running total per kind of event and day.  EXTREME_TOTAL and WIDE_RANGE fire once a day each; the state is
    a handful of numbers for each key and goes when its day is over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kind, day = key
        total, high, low, fired = (state.get[1:] if state.exists else (0.0, float("-inf"), float("inf"), ""))
        done = set(filter(None, fired.split(",")))
        out = []
        for pdf in batches:
            for ts, value in pdf.sort_values(["ts", "event_id"])[["ts", "value"]].itertuples(index=False):
                total, high, low = total + value, max(high, value), min(low, value)
                for name, hit, level in (("EXTREME_TOTAL", total >= extreme, total), ("WIDE_RANGE", high - low >= spread, high - low)):
                    if hit and name not in done:
                        done.add(name)
                        out.append((kind, day, name, ts, level))
        state.update((day, total, high, low, ",".join(sorted(done))))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 2 * 24 * 3600 * 1000)
        yield pd.DataFrame(out, columns=["event_type", "day", "kind", "at", "level"])

    keyed = events.withWatermark("ts", "1 hour").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return keyed.groupBy("event_type", "day").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
