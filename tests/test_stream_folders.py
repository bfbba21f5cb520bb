"""A table of many part files in no order of time streams whole."""

import pytest

from tapewright.plans.session_queries import QUERIES

NAMES = ["str_tumbling", "str_sliding", "str_first_per_minute", "str_accumulator_alerts", "str_volume_pace"]


@pytest.mark.parametrize("name", NAMES)
def test_part_files_give_what_one_file_gives(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet").orderBy("ts")
    n = events.count()
    parts = events.rdd.zipWithIndex().map(lambda x: ((7 * (x[1] * 10 // n)) % 10, x[0])).partitionBy(10, lambda k: k).values()
    spark.createDataFrame(parts, events.schema).write.parquet(f"{tmp_path}/events.parquet")
    run = QUERIES[name][0]
    got, want = ([tuple(r) for r in run(spark, d).collect()] for d in (str(tmp_path), source))
    assert want and sorted(map(str, got)) == sorted(map(str, want))
