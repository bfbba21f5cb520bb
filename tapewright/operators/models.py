"""A classifier of which barrier a price touches first, trained on the past and tested on what came after."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.windows import BARS as P
from tapewright.operators import indicators
from tapewright.operators.masked import rsi_variants

FEATURES = ("rsi_14", "mfi_14", "obv", "atr", "vol_avg_20")
#: Weights of classes are multiples of this, so their sums are exact in any order.
GRAIN = 1 / 4096


def atr_barriers(bars: DataFrame, up: float = 2.0, down: float = 1.5, most_bars: int = 15, n: int = 14) -> DataFrame:
    """Adds ``atr`` (Wilder's, null before n bars), ``label`` and ``touch_bar``: +1 if a high reaches close + up * ATR first within so many
    bars, -1 if a low reaches close - down * ATR (it wins ties), 0 if neither does; null where the end of the history leaves it open."""
    f = scans.ewma(bars.withColumn("__tr", indicators.true_range()), {"atr": (F.col("__tr"), 1 / n)}, least=n).drop("__tr")
    f = f.withColumns({"__top": F.col("close") + up * F.col("atr"), "__bottom": F.col("close") - down * F.col("atr")})
    ahead = F.collect_list(F.struct("bar_ix", "high", "low")).over(P.FWD(most_bars))  # at most ``most_bars`` bars
    f = f.withColumns({"__path": ahead, "__n": F.count("*").over(P.FWD(most_bars))})
    first = lambda test: F.array_min(F.transform(F.filter("__path", test), lambda s: s["bar_ix"]))
    f = f.withColumns({"__hit": first(lambda s: s["high"] >= F.col("__top")), "__stop": first(lambda s: s["low"] <= F.col("__bottom"))})
    stopped = F.col("__stop").isNotNull() & (F.col("__hit").isNull() | (F.col("__stop") <= F.col("__hit")))
    label = F.when(stopped, -1).when(F.col("__hit").isNotNull(), 1).when(F.col("__n") == most_bars, 0)
    f = f.withColumns({"label": F.when(F.col("atr").isNotNull(), label), "touch_bar": F.least("__hit", "__stop") - F.col("bar_ix")})
    return f.select(*bars.columns, "atr", "label", "touch_bar")


def barrier_features(bars: DataFrame) -> DataFrame:
    """Labels with what was known at the close: RSI, MFI, OBV, ATR and the mean volume."""
    f = indicators.volume(indicators.oscillators(rsi_variants(atr_barriers(bars))))
    return f.select(
        "symbol", "trade_date", "bar_ix", "label", F.col("rsi_100").alias("rsi_14"), F.col("mfi_100").alias("mfi_14"), F.col("obv").cast("double").alias("obv"), "atr",
        P.full(F.avg("volume"), 20).alias("vol_avg_20"),
    )


def split_date(rows: DataFrame, test_size: float = 0.2):
    """The last date of the training part: rows up to it are at least 1 - test_size of all.  Summed by date first."""
    by_date = rows.groupBy("trade_date").agg(F.count("*").alias("n"))
    w = Window.orderBy("trade_date")  # one row a date
    cum = by_date.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return cum.filter(F.col("upto") >= (1 - test_size) * F.col("all")).agg(F.min("trade_date")).first()[0]


def train_time_split(
    rows: DataFrame, features: tuple[str, ...] = FEATURES, test_size: float = 0.2, trees: int = 300, depth: int = 6, least_leaf: int = 20, seed: int = 42,
    parts: int = 8, least_rows: int = 50,
) -> tuple[PipelineModel, DataFrame]:
    """The forest and its report (part, name, metric, value): precision, recall, F1 and support of each class and the accuracy on the test part, and
    the importance of each feature.

    Rows without a label or a feature are left out.  No row is tested that is not later than all training rows.  Rows are dealt by
    their key to a fixed number of parts and sorted, so the same seed gives the same trees however the input was
    partitioned.  Classes weigh alike in the sum."""
    known = rows.dropna(subset=["label", *features]).select("symbol", "trade_date", "bar_ix", (F.col("label") + 1).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    known = known.persist(StorageLevel.MEMORY_AND_DISK)  # read by every pass below; lost blocks are computed again
    n = known.count()
    if n < least_rows:
        known.unpersist()
        raise ValueError(f"{n} labelled rows are too few to train and test on")
    last = split_date(known, test_size)
    train, test = known.filter(F.col("trade_date") <= F.lit(last)), known.filter(F.col("trade_date") > F.lit(last))
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}  # three classes
    total = sum(sizes.values())
    weight = F.lit(GRAIN)
    for y, k in sizes.items():
        weight = F.when(F.col("y") == y, F.lit(max(GRAIN, round(total / (len(sizes) * k) / GRAIN) * GRAIN))).otherwise(weight)
    even = train.withColumn("w", weight).repartition(parts, "symbol", "bar_ix").sortWithinPartitions("symbol", "bar_ix")
    vector = VectorAssembler(inputCols=list(features), outputCol="x")
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=least_leaf, seed=seed, featureSubsetStrategy="sqrt"
    )
    fitted = forest.fit(vector.transform(even))
    model = PipelineModel([vector, fitted])
    cells = model.transform(test).groupBy("y", "prediction").agg(F.count("*").alias("n")).collect()  # at most nine
    known.unpersist()
    confusion = rows.sparkSession.createDataFrame(cells, "y double, prediction double, n long")
    return model, _report(confusion, features, [float(v) for v in fitted.featureImportances.toArray()])


def _report(confusion: DataFrame, features: tuple[str, ...], importances: list[float]) -> DataFrame:
    """From at most nine cells of the confusion table."""
    spark = confusion.sparkSession
    classes = spark.createDataFrame([(float(i), str(i - 1)) for i in range(3)], "c double, name string")
    hit = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    each = classes.join(confusion, (F.col("y") == F.col("c")) | (F.col("prediction") == F.col("c")), "left").groupBy("name").agg(
        hit((F.col("y") == F.col("c")) & (F.col("prediction") == F.col("c"))).alias("tp"), hit(F.col("prediction") == F.col("c")).alias("said"), hit(F.col("y") == F.col("c")).alias("support")
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    figures = F.create_map(
        F.lit("precision"), zero(F.try_divide("tp", "said")), F.lit("recall"), zero(F.try_divide("tp", "support")),
        F.lit("f1"), zero(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("support"))), F.lit("support"), F.col("support").cast("double"),
    )
    by_class = each.select(F.lit("class").alias("part"), "name", F.explode(figures).alias("metric", "value"))
    whole = confusion.select(F.lit("all").alias("part"), F.lit("all").alias("name"), F.lit("accuracy").alias("metric"), F.try_divide(F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0)).over(Window.partitionBy()), F.sum("n").over(Window.partitionBy())).alias("value")).limit(1)
    weights = spark.createDataFrame([("feature", f, "importance", v) for f, v in zip(features, importances)], "part string, name string, metric string, value double")
    return by_class.unionByName(whole).unionByName(weights)
