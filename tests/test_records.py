"""Nulls, empty tables and ties in filters, overlays, fallbacks and gates; trade structure and lifecycles of nothing."""

from datetime import date

from pyspark.sql import functions as F

from tapewright.operators import campaigns, regime_studies, trade_quality
from tapewright.sources import records

ROWS = [(1, "a", None), (2, None, 5.0), (3, "b", 7.0), (3, "b", 7.0)]
KINDS = "id int, name string, value double"


def test_conditions_that_are_not_given_ask_for_nothing(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    assert records.matching(df, name=None, value__least=None).count() == 4
    assert sorted(r.id for r in records.matching(df, name__not_in=["a"]).collect()) == [2, 3, 3]
    assert [r.id for r in records.matching(df, value__from=5.0, value__until=7.0).collect()] == [2]
    assert records.matching(df.limit(0), name="a").count() == 0


def test_a_null_on_a_list_excludes_nothing(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    listed = spark.createDataFrame([("a",), (None,), ("a",)], "name string")
    assert sorted(r.id for r in records.without(df, listed, "name").collect()) == [2, 3, 3]
    assert records.without(df, listed.limit(0), "name").count() == 4


def test_overlay_keeps_what_has_no_quote(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "symbol string, close double")
    quotes = spark.createDataFrame([("x", 9.0), ("z", 3.0)], "symbol string, close double")
    got = {r.symbol: (r.close, r.live) for r in records.overlay(df, quotes, "symbol", ["close"]).collect()}
    assert got == {"x": (9.0, True), "y": (2.0, False)}


def test_first_source_with_rows_wins_whole(spark):
    one = spark.createDataFrame([("x", 1)], "symbol string, n int")
    two = spark.createDataFrame([("x", 2), ("y", 3), ("y", 3)], "symbol string, n int")
    got = sorted(tuple(r) for r in records.first_non_empty([("one", one), ("two", two)], "symbol").select("symbol", "n", "source").collect())
    assert got == [("x", 1, "one"), ("y", 3, "two"), ("y", 3, "two")]


def test_friday_has_two_sessions(spark):
    times = ["2024-01-05 12:00:00", "2024-01-05 12:30:00", "2024-01-05 14:15:00", "2024-01-06 10:00:00", "2024-01-08 15:30:00", "2024-01-08 15:30:01"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"))
    assert [r[0] for r in df.select(records.in_session(F.col("ts"))).collect()] == [True, False, True, False, True, False]


def test_gates_fail_closed(spark):
    counts = records.row_counts({"full": spark.range(5), "empty": spark.range(0)})
    got = {r.table_name: (r.n_rows, r.ready) for r in records.gates(counts, {"full": 5, "empty": 1, "absent": 0 + 1}).collect()}
    assert got == {"full": (5, True), "empty": (0, False), "absent": (0, False)}


def test_old_rows_without_grade(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), None), (2, date(2024, 1, 1), ""), (3, date(2024, 1, 1), "A"), (4, date(2024, 1, 9), None), (5, None, None)], "id int, d date, g string")
    assert [r.id for r in records.ungraded(df, "d", "g", date(2024, 1, 10), 5).collect()] == [1, 2]


def test_lifecycle_takes_accumulation_on_ties(spark):
    rows = [("x", "accumulation", "SC"), ("x", "accumulation", "PS"), ("x", "distribution", "BC"), ("y", "distribution", "BC"), ("y", "distribution", "AR"), ("z", "accumulation", "PS")]
    events = spark.createDataFrame(rows, "symbol string, campaign string, event string")
    got = {r.symbol: (r.sequence, r.chain, r.stage) for r in campaigns.lifecycle(events).collect()}
    assert got == {"x": ("accumulation", "SC", campaigns.STAGES["SC"]), "y": ("distribution", "BC,AR", campaigns.REACTION), "z": (None, "", campaigns.NO_STAGE)}
    assert campaigns.lifecycle(events.limit(0)).count() == 0


BAR = "symbol string, trade_date date, open double, high double, low double, close double, volume double, bar_ix int"


def test_studies_of_short_and_empty_panels(spark):
    bars = spark.createDataFrame([("x", date(2024, 1, 1 + i), 1.0, 1.0, 1.0, 1.0, 0.0, i + 1) for i in range(5)], BAR)
    assert [r.reason for r in regime_studies.eligibility(bars).collect()] == ["insufficient_history"]
    assert {r.volatility for r in regime_studies.volatility_class(bars).collect()} == {None}
    for empty in (regime_studies.eligibility(bars.limit(0)), regime_studies.candle_context(bars.limit(0)), regime_studies.regime_split(bars.limit(0)), trade_quality.breadth(bars, "trade_date")):
        assert empty.count() == 0
