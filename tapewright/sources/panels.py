"""Panels built from raw tables: ticks, daily and weekly bars, intraday bars, quotes, headlines.

Lines of orders are shuffled once, to their orders, and reduced there to one narrow row for an order and time; these are shuffled by symbol and
day, and reduced to days where they lie.  Everything downstream is a window on the symbol over these few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapewright.session import table

#: A total order of the ticks of a symbol.
TICK_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

TICKS_SQL = """
ticks AS (
  SELECT {symbol} AS symbol, {sector} AS sector, l_quantity AS qty, CAST(l_shipdate AS DATE) AS trade_date,
    row_number() OVER w AS tick_ix,
    100 * exp(0.002 * sum(CAST(round(l_discount * 100) AS BIGINT) - 5) OVER (PARTITION BY {symbol} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS px
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey {more}
  WINDOW w AS (PARTITION BY {symbol} ORDER BY {order})
)""".replace("{order}", ", ".join(TICK_ORDER))
BARS_SQL = (
    "WITH " + TICKS_SQL.format(symbol="c_mktsegment", sector="'ALL'", more="") + """,
bars AS (
  SELECT symbol, trade_date, min_by(px, tick_ix) AS open, max(px) AS high, min(px) AS low, max_by(px, tick_ix) AS close,
    sum(qty) AS volume, count(*) AS n_ticks, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS bar_ix
  FROM ticks GROUP BY symbol, trade_date
)"""
)
WEEKLY_SQL = (
    "WITH "
    + TICKS_SQL.format(
        symbol="n_name", sector="r_name", more="JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    )
    + """,
weekly AS (
  SELECT symbol, any_value(sector) AS sector, CAST(date_trunc('week', trade_date) + INTERVAL 4 DAY AS DATE) AS week, min_by(px, tick_ix) AS open, max(px) AS high,
    min(px) AS low, max_by(px, tick_ix) AS close, sum(qty) AS volume,
    row_number() OVER (PARTITION BY symbol ORDER BY CAST(date_trunc('week', trade_date) + INTERVAL 4 DAY AS DATE)) AS bar_ix
  FROM ticks GROUP BY symbol, CAST(date_trunc('week', trade_date) + INTERVAL 4 DAY AS DATE)
)"""
)
INTRADAY_SQL = """WITH intraday AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS session_date, hour(ts) AS hour, min_by(value, ts) AS open, max(value) AS high,
    min(value) AS low, max_by(value, ts) AS close, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS volume,
    row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE), hour(ts)) AS bar_ix
  FROM events GROUP BY event_type, CAST(ts AS DATE), hour(ts)
)"""


def _orders(spark: SparkSession, sf_dir: str, by_nation: bool) -> DataFrame:
    """(o_orderkey, symbol) of every order with a customer; ``symbol`` is the customer's segment, or the number of its nation's name."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey" if by_nation else "c_mktsegment").alias("symbol"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "symbol")
    if not by_nation:
        return own
    # nations come after the customers: Spark takes a join of small tables for a large one and would shuffle the orders for it
    nations = _nations(spark, sf_dir).select("n_nationkey", "code")
    return own.join(F.broadcast(nations), F.col("symbol") == F.col("n_nationkey")).select("o_orderkey", F.col("code").alias("symbol"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region, and one number for all of a name, which is narrower than the name."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    code = F.min("n_nationkey").over(Window.partitionBy("n_name")).alias("code")
    return nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", code)


def _days(spark: SparkSession, sf_dir: str, by_nation: bool) -> DataFrame:
    """Daily bars.  A price is a function of the sum of all steps so far, and grows with it.  Steps are summed within each order
    and time, and only their first, highest, lowest and last sum leave the order; these are summed within each day, in the same order of
    ticks, and the days along the symbol.  No task holds more than the rows of one symbol and day."""
    step = (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("step")
    # lines that differ in their tax alone have one step, so their order changes no sum; nor does the order of discounts of one step
    lines = table(spark, sf_dir, "lineitem").select(*TICK_ORDER[:-2], step)
    ticks = lines.join(_orders(spark, sf_dir, by_nation), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    own = Window.partitionBy("l_orderkey", "symbol", "l_shipdate").orderBy(*TICK_ORDER[2:-2], "step")
    ticks = ticks.withColumns({"ix": F.row_number().over(own), "sum": F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    pieces = ticks.groupBy("l_orderkey", "symbol", "l_shipdate").agg(
        F.min(F.when(F.col("ix") == 1, F.col("sum"))).alias("open"), F.max("sum").alias("high"), F.min("sum").alias("low"),
        F.sum("step").alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("n_ticks"),
    ).withColumn("trade_date", F.to_date("l_shipdate"))
    day = Window.partitionBy("symbol", "trade_date").orderBy("l_shipdate", "l_orderkey")
    so_far = F.coalesce(F.sum("close").over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"ix": F.row_number().over(day), "so_far": so_far})
    bars = pieces.groupBy("symbol", "trade_date").agg(
        F.min(F.when(F.col("ix") == 1, F.col("open"))).alias("open"), F.max(F.col("so_far") + F.col("high")).alias("high"), F.min(F.col("so_far") + F.col("low")).alias("low"),
        F.sum("close").alias("close"), F.sum("volume").alias("volume"), F.sum("n_ticks").alias("n_ticks"),
    )
    before = F.coalesce(F.sum("close").over(Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bars = bars.withColumn("before", before)
    price = lambda c: (100 * F.exp(0.002 * (F.col("before") + F.col(c)))).alias(c)
    return bars.select("symbol", "trade_date", *map(price, ("open", "high", "low", "close")), "volume", "n_ticks")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_date, open, high, low, close, volume, n_ticks, bar_ix."""
    bars = _days(spark, sf_dir, by_nation=False)
    return bars.withColumn("bar_ix", F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, week (its Friday), OHLCV, bar_ix: a cross-section with sectors."""
    week = F.date_add(F.date_trunc("week", "trade_date").cast("date"), 4)
    names = _nations(spark, sf_dir).groupBy("code").agg(F.min("n_name").alias("name"), F.min("r_name").alias("sector"))
    days = _days(spark, sf_dir, by_nation=True).join(F.broadcast(names), F.col("symbol") == F.col("code")).withColumn("symbol", F.col("name"))
    bars = days.groupBy("symbol", "sector", week.alias("week")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.withColumn("bar_ix", F.row_number().over(Window.partitionBy("symbol").orderBy("week")))


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events by type: symbol, session_date, hour, OHLCV, bar_ix."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    bars = e.groupBy("symbol", F.to_date("ts").alias("session_date"), F.hour("ts").alias("hour")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.sum("k").alias("volume"),
    )
    return bars.withColumn("bar_ix", F.row_number().over(Window.partitionBy("symbol").orderBy("session_date", "hour")))
