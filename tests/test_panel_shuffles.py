import math
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tapewright.sources import panels

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders with several lines at one time, lines of equal numbers, times within a day, keys that meet nothing."""
    rng, path = random.Random(4), str(tmp_path_factory.mktemp("panel"))
    lines = []
    for _ in range(900):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(5), hours=rng.choice([0, 0, 9, 15]))
        lines.append((rng.randrange(70), rng.randrange(3), rng.randrange(3), rng.randrange(3), float(rng.randrange(4)), rng.randrange(9) / 4, rng.randrange(11) / 100, 0.0, at))
    orders = [(k, rng.randrange(14)) for k in range(60)]
    customers = [(c, None if c == 3 else "AB"[c % 2], c % 3) for c in range(12)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    return path, lines, dict(orders), {c: s for c, s, _ in customers}


def test_days_by_hand(spark, folder):
    path, lines, orders, customers = folder
    ticks = defaultdict(list)
    for r in lines:
        if r[0] in orders and orders[r[0]] in customers:
            ticks[customers[orders[r[0]]]].append((r[8], r[0], r[3], r[1], r[2], r[4], r[5], r[6], r[7]))
    want = {}
    for symbol, rows in ticks.items():
        total = 0
        for t in sorted(rows):
            total += round(t[7] * 100) - 5
            d = want.setdefault((symbol, t[0].date()), [[], 0.0])
            d[0].append(100 * math.exp(0.002 * total))
            d[1] += t[5]
    got = {(r.symbol, r.trade_date): r for r in panels.daily_bars(spark, path).collect()}
    assert got.keys() == want.keys()
    for key, (px, volume) in want.items():
        r = got[key]
        assert (r.open, r.high, r.low, r.close) == pytest.approx((px[0], max(px), min(px), px[-1]), rel=1e-12)
        assert (r.volume, r.n_ticks) == (volume, len(px))


def test_lines_are_shuffled_once(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = panels.daily_bars(spark, folder[0])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wide = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[[^\]]*l_extendedprice[^\]]*\]", plan)
    assert len(wide) == 1


def test_ticks_that_differ_in_tax_or_discount_alone(spark, tmp_path):
    """Lines of one number, part, price: discounts of one step and any tax, also none, in every order of the file."""
    path, rng, at = str(tmp_path), random.Random(5), datetime(2024, 1, 3)
    near = [0.0, 0.004, 0.02, 0.021, 0.096, 0.1, 0.104, None]
    lines = [(k, 1, 1, 1, 2.0, rng.choice([1.0, 2.0]), rng.choice(near), rng.choice([0.0, 0.08, None]), at) for k in range(8) for _ in range(12)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, 0) for k in range(8)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(0, "A", 0)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    nulls = lambda v: (v is not None, v or 0.0)
    total, px = 0, []
    for r in sorted(lines, key=lambda r: (r[0], r[5], nulls(r[6]), nulls(r[7]))):
        if r[6] is not None:
            total += round(r[6] * 100) - 5
            px.append(total)
    got = panels.daily_bars(spark, path).collect()[0]
    price = lambda x: pytest.approx(100 * math.exp(0.002 * x), rel=1e-12)
    assert (got.close, got.n_ticks, got.volume) == (price(total), len(lines), 2.0 * len(lines))
    assert (got.high, got.low) == (price(max(px)), price(min(px)))
