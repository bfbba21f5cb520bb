"""The evidence board: market, sector, effort against result, relative strength, momentum, MACD, OBV, reward and the longer trend as signed components,
their sum, a grade that wants agreement, and an action behind gates that only make it more careful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.scalars import bands, clamp
from tapewright.functions.windows import BARS as P
from tapewright.operators import indicators
from tapewright.operators.masked import rsi_variants

#: Points that a component can move the score of 50 by.
WEIGHTS = {
    "regime": 10.0, "sector": 10.0, "effort": 15.0, "relative": 7.0, "momentum": 5.0, "macd": 5.0, "obv": 5.0, "reward": 5.0, "structure": 5.0,
}
#: Limits of the market's score by label, of effort and result, and of the grades (score, components of one side).
REGIMES = [(45.0, "RISK-OFF"), (55.0, "MIXED"), (65.0, "CONSTRUCTIVE")]
GRADES = [("A+", 88, 7), ("A", 78, 6), ("B", 65, 4), ("C", 50, 0), ("D", 35, 0)]
BULLISH = ("WATCH FOR BUY", "ACCUMULATE", "BUY", "STRONG BUY")


def breadth(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Share of rises among moves and the mean change, in percent: a row for each date, or date and sector."""
    up, down = F.count_if(F.col("pct") > 0), F.count_if(F.col("pct") < 0)
    return rows.groupBy(*by).agg((100 * up / F.greatest(F.lit(1), up + down)).alias(f"{name}_breadth"), F.avg("pct").alias(f"{name}_avg"))


def market_label(share: Column, average: Column) -> Column:
    score = clamp(0.6 * share + 0.4 * clamp(50 + 10 * average, 0, 100), 0, 100)
    return bands(score, REGIMES, "RISK-ON")


def effort_state(n: int = 20) -> tuple[Column, Column, Column]:
    """Volume, spread and progress of a bar against the bars before it within n bars."""
    spread = F.greatest(F.lit(1e-6), F.col("high") - F.col("low"))
    known = F.count("*").over(P.W(n + 2)) == n + 2
    before = P.WP(n - 1)
    usual = F.greatest(F.lit(1e-6), F.avg(spread).over(before))
    volume = F.col("volume") / F.greatest(F.lit(1.0), F.avg("volume").over(before))
    return F.when(known, volume), F.when(known, spread / usual), F.when(known, F.abs(F.col("close") - P.lag("close")) / usual)


def _sides(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def board_frame(bars: DataFrame, date: str) -> DataFrame:
    """What the components read, for bars with a sector: one window pass over the symbol, and two small tables by date joined back."""
    f = indicators.volume(rsi_variants(bars))
    f = scans.ewma(f, {"__12": (F.col("close"), 2 / 13), "__26": (F.col("close"), 2 / 27)}).withColumn("__macd", F.col("__12") - F.col("__26"))
    f = scans.ewma(f, {"__signal": (F.col("__macd"), 0.2)}).withColumn("hist", F.col("__macd") - F.col("__signal"))
    effort, spread, progress = effort_state()
    f = f.withColumns({
        "pct": 100 * (F.col("close") / P.lag("close") - 1), "effort": effort, "spread": spread, "progress": progress, "obv_10": P.lag("obv", 10), "close_10": P.lag("close", 10),
        "hi20": P.prior(F.max("high"), 20), "lo20": P.prior(F.min("low"), 20), "sma26": P.full(F.avg("close"), 26), "turnover": F.avg(F.col("close") * F.col("volume")).over(P.W(20)),
    })
    f = f.withColumn("sma26_4", P.lag("sma26", 4)).filter("pct IS NOT NULL")
    return f.join(breadth(f, [date], "market"), date).join(breadth(f, [date, "sector"], "sector"), [date, "sector"])


def components() -> dict[str, tuple[Column, Column]]:
    """(side, strength from 0 to 1) by name; null where the history is too short."""
    c = F.col
    label = market_label(c("market_breadth"), c("market_avg"))
    quiet, harmony, easy = (c("effort") >= 1.5) & (c("progress") < 0.5), (c("effort") >= 1.2) & (c("spread") >= 1.2), (c("effort") < 0.8) & (c("progress") >= 1.0)
    against = ((c("pct") - c("sector_avg")) + (c("pct") - c("market_avg"))) / 2
    reward = F.try_divide(c("hi20") - c("close"), c("close") - c("lo20"))
    hidden = (c("close") <= c("close_10")) & (c("obv") > c("obv_10"))
    one = lambda x: clamp(x, 0, 1)
    return {
        "regime": (_sides(label.isin("RISK-ON", "CONSTRUCTIVE"), label == "RISK-OFF"), F.when(label.isin("RISK-ON", "RISK-OFF"), 1.0).otherwise(0.5)),
        "sector": (_sides((c("sector_breadth") > 55) & (c("sector_avg") > 0), (c("sector_breadth") < 45) & (c("sector_avg") < 0)), one(F.abs(c("sector_breadth") - 50) / 30)),
        # what a bar did counts for its side by size only: absorption, harmony and easy moves are read as support
        "effort": (F.when(c("effort").isNotNull(), F.when(quiet | harmony | easy, 1).otherwise(0)), F.when(quiet, 0.5).when(harmony, 0.7).when(easy, 0.6).otherwise(0.0)),
        "relative": (_sides(against > 0.3, against < -0.3), one(F.abs(against) / 3)),
        "momentum": (F.when(c("rsi_100").isNotNull(), _sides(c("rsi_100") > 55, c("rsi_100") < 45)), one(F.abs(c("rsi_100") - 50) / 30)),
        "macd": (_sides(c("hist") > 0, c("hist") < 0), one(F.abs("hist") / F.greatest(F.lit(0.01), 0.01 * F.abs("close")))),
        "obv": (F.when(c("obv_10").isNotNull(), F.when(hidden | (c("obv") > c("obv_10")), 1).otherwise(-1)), F.when(hidden, 0.7).otherwise(0.3)),
        "reward": (F.when(reward.isNotNull(), _sides(reward >= 1.5, reward < 1.0)), one(reward / 3)),
        "structure": (
            F.when(c("sma26_4").isNotNull(), _sides((c("close") > c("sma26")) & (c("sma26") > c("sma26_4")), (c("close") < c("sma26")) & (c("sma26") < c("sma26_4")))),
            F.lit(0.6),
        ),
    }


def evidence_board(bars: DataFrame, date: str = "week", thin: float = 2_000.0, dry: float = 500.0) -> DataFrame:
    """Score, counts of components for and against, how many are there, grade and action.  ``thin`` and ``dry`` are mean turnovers under which a name
    is watched only, or avoided."""
    f = board_frame(bars, date)
    found = components()
    f = f.withColumns({f"s_{n}": s for n, (s, _) in found.items()} | {f"x_{n}": x for n, (_, x) in found.items()})
    f = f.withColumns({f"p_{n}": F.coalesce(F.col(f"s_{n}") * F.col(f"x_{n}") * w, F.lit(0.0)) for n, w in WEIGHTS.items()})
    total = sum((F.col(f"p_{n}") for n in WEIGHTS), F.lit(50.0))
    count = lambda test: sum((F.when(test(F.col(f"s_{n}")), 1).otherwise(0) for n in WEIGHTS), F.lit(0))
    f = f.withColumns({
        "score": clamp(total, 0, 100), "n_bull": count(lambda s: s > 0), "n_bear": count(lambda s: s < 0), "n_known": count(lambda s: s.isNotNull()),
        "reward": F.try_divide(F.col("hi20") - F.col("close"), F.col("close") - F.col("lo20")),
    })
    s, bull, bear, rr = F.col("score"), F.col("n_bull") > F.col("n_bear"), F.col("n_bear") > F.col("n_bull"), F.col("reward")
    most, liquid = F.greatest("n_bull", "n_bear"), F.col("turnover") >= thin
    grade = F.lit("F")
    for name, least, agree in reversed(GRADES):
        grade = F.when((s >= least) & (most >= agree), name).otherwise(grade)
    # 0: no claim; 1 to 4: places in BULLISH
    claim = F.when(bull & (s >= 78) & (rr >= 2) & liquid, 4).when(bull & (s >= 65), 3).when(bull & (s >= 50), 1).otherwise(0)
    capped = F.when((rr < 1.5) | ~liquid, F.least(claim, F.lit(1))).otherwise(claim)
    names = F.array(*[F.lit(x) for x in BULLISH])
    action = (
        F.when((claim > 0) & (F.col("turnover") < dry), "AVOID").when(claim > 0, F.get(names, capped - 1))
        .when(bear & (s <= 35), "SELL / REDUCE").when(bear & (s <= 45), "WATCH FOR SELL").when(~liquid, "AVOID").otherwise("NEUTRAL")
    )
    return f.withColumns({"grade": grade, "action": action})
