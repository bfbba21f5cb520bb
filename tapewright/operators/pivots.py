"""Confirmed pivots, swing structure, islands and greedy suppression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.windows import BARS as P


def pivots(bars: DataFrame, k: int = 3, amplitude: float = 0.02) -> DataFrame:
    """Highs and lows that are extreme over k bars to both sides (the earliest of equal ones), at least
    ``amplitude`` away from the latest candidate of the other kind, alternating: of several of one kind in a
    row the most extreme stays.  ``confirmed_ix`` is the bar on which a pivot is known."""
    full = F.count("*").over(P.base.rowsBetween(-k, k)) == 2 * k + 1
    before, after = P.base.rowsBetween(-k, -1), P.base.rowsBetween(1, k)
    high = full & (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after))
    low = full & (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after))
    both = F.filter(F.array(F.when(high, F.struct(F.lit("H").alias("kind"), F.col("high").alias("price"))), F.when(low, F.struct(F.lit("L").alias("kind"), F.col("low").alias("price")))), lambda x: x.isNotNull())
    c = bars.withColumn("p", both).select("symbol", "trade_date", "bar_ix", F.explode("p").alias("p")).select("symbol", "trade_date", "bar_ix", "p.kind", "p.price")
    w = Window.partitionBy("symbol").orderBy("bar_ix", "kind")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("kind") == "H", F.last(F.when(F.col("kind") == "L", F.col("price")), True).over(so_far)).otherwise(F.last(F.when(F.col("kind") == "H", F.col("price")), True).over(so_far))
    c = c.withColumn("other", other).filter(F.col("other").isNull() | (F.abs(F.col("price") / F.col("other") - 1) >= amplitude))
    c = c.withColumn("new", (F.col("kind") != F.lag("kind").over(w)) | F.lag("kind").over(w).isNull()).withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("symbol", "run").orderBy(F.when(F.col("kind") == "H", -F.col("price")).otherwise(F.col("price")), "bar_ix")
    best = c.withColumn("rn", F.row_number().over(own)).filter("rn = 1")
    return best.select("symbol", "trade_date", "bar_ix", "kind", "price", (F.col("bar_ix") + k).alias("confirmed_ix"))


def structure(bars: DataFrame) -> DataFrame:
    """The latest two highs and lows of each symbol, and whether they rise or fall."""
    p = pivots(bars).withColumn("rn", F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("bar_ix")))).filter("rn <= 2")
    pick = lambda kind, rn: F.max(F.when((F.col("kind") == kind) & (F.col("rn") == rn), F.col("price")))
    s = p.groupBy("symbol").agg(pick("H", 1).alias("h1"), pick("H", 2).alias("h2"), pick("L", 1).alias("l1"), pick("L", 2).alias("l2"))
    return s.withColumn("structure", F.when((F.col("h1") > F.col("h2")) & (F.col("l1") > F.col("l2")), "HH/HL").when((F.col("h1") < F.col("h2")) & (F.col("l1") < F.col("l2")), "LH/LL").otherwise("mixed"))


def double_bottoms(bars: DataFrame, tolerance: float = 0.03, low_span: int = 5, high_span: int = 120, wait: int = 30) -> DataFrame:
    """Low, high, low pivots with lows at one level, whose neckline a close breaks within ``wait`` bars of the
    second low's confirmation.  The breakout is the first such bar: an equi-join on the symbol with a bounded range."""
    w = Window.partitionBy("symbol").orderBy("bar_ix", "kind")
    p = pivots(bars)
    t = p.select(
        "symbol", *[F.lead(c, n).over(w).alias(f"{c}_{n}") if n else F.col(c).alias(f"{c}_0") for n in range(3) for c in ("kind", "price", "bar_ix")], F.lead("confirmed_ix", 2).over(w).alias("from_ix")
    ).filter("kind_0 = 'L' and kind_1 = 'H' and kind_2 = 'L'")
    t = t.filter((F.abs(F.col("price_2") / F.col("price_0") - 1) <= tolerance) & (F.col("bar_ix_2") - F.col("bar_ix_0")).between(low_span, high_span))
    b = bars.select(F.col("symbol").alias("s"), F.col("bar_ix").alias("ix"), "close", F.col("trade_date").alias("breakout_date"))
    hit = t.join(b, (t.symbol == b.s) & (b.ix > t.from_ix) & (b.ix <= t.from_ix + wait) & (b.close > t.price_1))
    first = hit.groupBy("symbol", "bar_ix_0", "bar_ix_1", "bar_ix_2").agg(F.first("price_1").alias("neckline"), F.first("price_0").alias("low_1"), F.first("price_2").alias("low_2"), F.min("ix").alias("breakout_ix"), F.min("breakout_date").alias("breakout_date"))
    return first.withColumn("target", 2 * F.col("neckline") - F.least("low_1", "low_2"))


def cooldown(events: DataFrame, bars: int, order: str = "bar_ix", by: str = "symbol") -> DataFrame:
    """Greedy suppression: an event is dropped if one that was kept lies less than ``bars`` before it.  Each
    decision depends on the one before, so a symbol's events go through one fold."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        last, kept = None, []
        for x in pdf[order]:
            ok = last is None or x - last >= bars
            kept.append(ok)
            last = x if ok else last
        return pdf[kept]

    return events.groupBy(by).applyInPandas(keep, events.schema)
