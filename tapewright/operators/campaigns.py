"""What the events of an accumulation or distribution say: nine tests each, and the stage that was reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P

#: The order of events, and the stage that each one stands for.
CHAINS = {
    "accumulation": ["SC", "AR", "ST", "SPRING", "TEST", "SOS", "LPS"],
    "distribution": ["BC", "PSY", "AR", "ST", "UT", "SOW", "LPSY"],
}
STAGES = {
    "SC": "SELLING CLIMAX DETECTED", "AR": "AUTOMATIC RALLY", "ST": "SECONDARY TEST", "SPRING": "SPRING DETECTED", "TEST": "SPRING TEST SUCCESSFUL",
    "SOS": "SIGN OF STRENGTH CONFIRMED", "LPS": "LAST POINT OF SUPPORT — MARKUP LIKELY NEXT",
    "BC": "BUYING CLIMAX DETECTED", "PSY": "PRELIMINARY SUPPLY", "UT": "UPTHRUST DETECTED", "SOW": "SIGN OF WEAKNESS CONFIRMED", "LPSY": "LAST POINT OF SUPPLY — MARKDOWN LIKELY NEXT",
}
NO_STAGE, REACTION = "NO STRUCTURE DETECTED", "AUTOMATIC REACTION"
#: Events that the tests of each side ask for: preliminary stop, climax, test, sign.
NEEDED = {"accumulation": (1, "PS", "SC", "ST", "SOS"), "distribution": (-1, "PSY", "BC", "ST", "SOW")}
WIDTH = 8.0


def latest_state(bars: DataFrame, back: int = 59, window: int = 40, rs: int = 20) -> DataFrame:
    """The last bar of each symbol with the move that led to it, the width of its range in percent, and its return against the mean of
    all symbols: a row for each symbol, and only these rows meet in one task."""
    core = P.base.rowsBetween(-(window - 1), -3)
    f = bars.withColumns({
        "then": P.lag("close", back), "width": 100 * (F.max("high").over(core) - F.min("low").over(core)) / F.avg("close").over(core), "long": F.count("*").over(core) == window - 3,
        "own": F.col("close") / P.lag("close", rs) - 1,
    })
    last = f.groupBy("symbol").agg(F.max_by(F.struct("close", "low", "high", "then", F.when(F.col("long"), F.col("width")).alias("width"), "own"), "bar_ix").alias("x")).select("symbol", "x.*")
    return last.withColumn("market", F.avg("own").over(Window.partitionBy(F.lit(1))))


def nine_tests(events: DataFrame, state: DataFrame) -> DataFrame:
    """Nine tests of each side for each symbol, in one string, and how many pass."""
    sides = F.explode(F.array(*[
        F.struct(F.lit(name).alias("campaign"), F.lit(sign).alias("side"), *[F.lit(x).alias(k) for k, x in zip(("early", "climax", "again", "strong"), need)])
        for name, (sign, *need) in NEEDED.items()
    ]))
    found = events.groupBy("symbol", "campaign").agg(F.collect_set("event").alias("found"))
    f = state.select("*", sides.alias("s")).select(*state.columns, "s.*").join(found, ["symbol", "campaign"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    has = lambda x: F.array_contains(F.col("found"), F.col(x))
    verdict = lambda test, other: F.when(F.coalesce(test, F.lit(False)), "PASS").otherwise(other)
    edge = F.when(F.col("side") > 0, F.col("close") > F.col("low")).otherwise(F.col("close") < F.col("high"))
    lead = (F.col("own") - F.col("market")) * F.col("side")
    tests = [
        verdict((F.col("then") - F.col("close")) * F.col("side") > 0, "PARTIAL"), verdict(has("early"), "FAIL"), verdict(has("climax"), "FAIL"), verdict(has("again"), "FAIL"),
        verdict(has("climax") & edge, "PARTIAL"), verdict(has("strong"), "PARTIAL"), F.when(lead > 0, "PASS").when(lead.isNotNull(), "FAIL").otherwise("N/A"),
        verdict(F.col("width") >= WIDTH, "PARTIAL"), verdict(has("strong"), "FAIL"),
    ]
    out = f.withColumn("tests", F.array(*tests))
    return out.withColumn("passed", F.size(F.filter("tests", lambda x: x == "PASS"))).withColumn("tests", F.array_join("tests", ","))


def lifecycle(events: DataFrame) -> DataFrame:
    """The side that got as far as the other or farther (accumulation on ties), its events in order, and the stage of the last."""
    sets = events.groupBy("symbol").agg(*[F.collect_set(F.when(F.col("campaign") == name, F.col("event"))).alias(name) for name in CHAINS])
    for name, chain in CHAINS.items():  # an intersection keeps the order of its first side
        sets = sets.withColumn(name, F.array_intersect(F.array(*map(F.lit, chain)), F.col(name)))
    up = (F.size("accumulation") > 0) & (F.size("accumulation") >= F.size("distribution"))
    side = F.when(up, "accumulation").when(F.size("distribution") > 0, "distribution")
    out = sets.withColumn("sequence", side).withColumn("chain", F.when(F.col("sequence") == "accumulation", F.col("accumulation")).otherwise(F.col("distribution")))
    out = out.withColumn("furthest", F.when(F.size("chain") > 0, F.element_at("chain", -1)))
    names = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    stage = F.when(F.col("furthest").isNull(), NO_STAGE).when((F.col("sequence") == "distribution") & (F.col("furthest") == "AR"), REACTION).otherwise(names[F.col("furthest")])
    return out.select("symbol", "sequence", F.array_join("chain", ",").alias("chain"), "furthest", stage.alias("stage"))
