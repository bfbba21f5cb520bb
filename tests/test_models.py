"""The barrier model: a split in time, the same trees however rows are partitioned, and a rule that it must learn."""

import datetime as dt
import random

import pytest

from tapewright.operators import models

ROWS = "symbol string, trade_date date, bar_ix int, label int, a double, b double"


def rows(n=600, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        out.append((rng.choice("xyz"), dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), i, None if i % 50 == 0 else 1 if a > 0.3 else -1 if a < -0.5 else 0, None if i % 71 == 0 else a, b))
    return out


def report(df, **more):
    return sorted(map(tuple, models.train_time_split(df, ("a", "b"), trees=12, least_leaf=2, **more)[1].collect()))


def test_model_learns_and_repeats(spark):
    df = spark.createDataFrame(rows(), ROWS)
    found = report(df.repartition(1))
    assert found == report(df.repartition(7, "b")) == report(df.orderBy("b"))
    value = {(p, n, m): v for p, n, m, v in found}
    assert value["all", "all", "accuracy"] > 0.9 and value["feature", "a", "importance"] > 0.8
    known = [r for r in rows() if r[3] is not None and r[4] is not None]
    assert sum(value["class", str(c), "support"] for c in (-1, 0, 1)) <= 0.2 * len(known)
    with pytest.raises(ValueError):
        models.train_time_split(df.limit(20), ("a", "b"))


def test_no_training_row_is_later_than_a_test_row(spark):
    df = spark.createDataFrame(rows(), ROWS)
    last = models.split_date(df, 0.25)
    dates = sorted(r[1] for r in rows())
    assert sum(d <= last for d in dates) >= 0.75 * len(dates) > sum(d < last for d in dates)
