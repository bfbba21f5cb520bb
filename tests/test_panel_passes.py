"""Queries over weekly bars build the panel once, and lines leave their scan once."""

import math
import re
from datetime import date, datetime, timedelta

import pytest

from tapewright.plans import market_queries, registry
from tapewright.sources import panels

SF = "/root/testdata/sf0.001"
NARROW = ["cs_index_regime", "src_rescans", "cs_rebased", "cs_return_matrix", "cs_rs_score", "cs_beta", "cs_leave_one_out", "cs_relative_strength"]
ORDERED = ["cs_breadth", "cs_bucket_lists", "cs_market_regime", "cs_quotes", "cs_sector_rotation", "dec_admission"]
BARS = "symbol string, sector string, week date, close double, volume double, bar_ix int"


@pytest.mark.parametrize("name", ["src_rescans", "src_overlay"])
def test_lines_are_read_once(spark, name):
    plan = market_queries.QUERIES[name][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


def test_quotes_beside_bars_of_four_weeks_before(spark, monkeypatch):
    rows = lambda s, closes, volumes: [(s, "S", date(2024, 1, 5) + timedelta(weeks=i), c, v, i + 1) for i, (c, v) in enumerate(zip(closes, volumes))]
    bars = rows("moved", [50.0, 100.0, 1.0, 1.0, 1.0, 103.0], [200.0] * 6) + rows("quiet", [100.0, 1.0, 1.0, 1.0, 103.0], [200.0] * 4 + [100.0])
    bars += rows("short", [100.0] * 4, [200.0] * 4) + rows(None, [100.0] * 5, [200.0] * 5) + rows("entry", [100.0, 1.0, 1.0, 1.0, 101.0], [7.0] * 4 + [101.0])
    monkeypatch.setattr(market_queries, "weekly_bars", lambda *_: spark.createDataFrame(bars, BARS))
    got = {r.symbol: (r.price, r.live_price, r.reason) for r in market_queries.q_rescans(spark, SF).collect()}
    assert got == {"moved": (100.0, 103.0, "moved"), "entry": (100.0, 101.0, "entry")}
    got = {r.symbol: (r.close, r.volume, r.live) for r in market_queries.q_overlay(spark, SF).collect()}
    assert got == {"moved": (103.0, 200.0, True), "quiet": (100.0, 200.0, False), None: (100.0, 200.0, False), "entry": (101.0, 101.0, True)}


def exchanges(spark, df):
    """Columns of every exchange of a plan in which only what is marked is broadcast."""
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", NARROW + ORDERED)
def test_customers_are_shuffled_once_and_without_names(spark, no_broadcast, name):
    found = exchanges(spark, registry.QUERIES[name][0](spark, SF))
    customers = {x for x in found if "c_custkey" in x}
    assert len(customers) == 1 and not any("n_name" in x for x in customers)
    prices = {x for x in found if "l_extendedprice" in x}  # only what needs an order of ticks takes whole lines, once
    assert len(prices) == (name in ORDERED)


STEPS = ["cs_rebased", "cs_return_matrix", "cs_rs_score", "cs_beta", "cs_leave_one_out", "cs_relative_strength", "cs_breadth", "cs_bucket_lists", "cs_market_regime", "cs_quotes", "cs_sector_rotation", "dec_admission"]


@pytest.mark.parametrize("name", STEPS)
def test_lines_travel_with_steps(spark, no_broadcast, name):
    lines = [x.split(", ") for x in exchanges(spark, registry.QUERIES[name][0](spark, SF)) if "l_orderkey" in x and "step" in x]
    assert lines and not any({"l_discount", "l_tax"} & set(x) for x in lines)


def test_weeks_of_nations_that_share_a_name(spark, tmp_path):
    path, at = str(tmp_path), datetime(2024, 1, 3)
    save = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(f"{path}/{name}.parquet")
    save("region", [(0, "b"), (1, "a")], "r_regionkey int, r_name string")
    save("nation", [(0, "N", 0), (1, "N", 1), (2, None, 0), (3, "Z", 9)], "n_nationkey int, n_name string, n_regionkey int")
    save("customer", [(c, None if c == 4 else c, "S") for c in range(5)], "c_custkey long, c_nationkey int, c_mktsegment string")
    save("orders", [(k, k % 6) for k in range(12)], "o_orderkey long, o_custkey long")
    lines = [(k, 1, 1, n, 1.0 + k, 1.0, (k % 3 + 5) / 100, 0.0, at) for k in range(13) for n in (1, 2)]
    save("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp")
    got = {r.symbol: r for r in panels.weekly_bars(spark, path).collect()}
    assert set(got) == {"N", None} and [got[s].sector for s in ("N", None)] == ["a", "b"]
    for symbol, orders in (("N", (0, 1, 6, 7)), (None, (2, 8))):
        assert got[symbol].volume == sum(2 * (1.0 + k) for k in orders)
        assert got[symbol].close == pytest.approx(100 * math.exp(0.002 * sum(2 * (k % 3) for k in orders)), rel=1e-12)
