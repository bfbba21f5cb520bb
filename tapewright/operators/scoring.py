"""Composite scores and decisions: technical score, signed evidence with grade and gated action, conviction,
risk sizing, portfolio admission, outcome grading, decision differences, confluence votes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import clamp, ramp, weighted
from tapewright.functions.windows import BARS as P
from tapewright.operators import indicators

#: Evidence components and their weights: the largest move each can make to the score of 50.
WEIGHTS = {"trend": 12.0, "momentum": 10.0, "volume": 8.0, "volatility": 6.0, "location": 8.0, "breakout": 10.0}


def score_frame(bars: DataFrame) -> DataFrame:
    f = indicators.volume(indicators.oscillators(indicators.trend(bars))).withColumn("tr", indicators.true_range())
    return f.withColumns({"atr14": P.full(F.avg("tr"), 14), "hi20": P.prior(F.max("high"), 20), "lo20": P.prior(F.min("low"), 20), "obv_20": P.lag("obv", 20)})


def technical_score(bars: DataFrame) -> DataFrame:
    """0 to 100 from what is there; coverage says how much of the weight that was."""
    f = score_frame(bars)
    parts = [
        (F.when(F.col("sma200").isNotNull(), (F.col("close") > F.col("sma200")).cast("double")), 15), (ramp(F.col("rsi_simple_100"), 30, 70), 20), (ramp(F.col("roc10"), -0.05, 0.05), 15),
        (ramp(F.col("pct_b"), 0, 1), 10), (ramp(F.col("cmf20"), -0.2, 0.2), 15), (F.when(F.col("obv_20").isNotNull(), (F.col("obv") > F.col("obv_20")).cast("double")), 10),
        (F.when(F.col("hi20").isNotNull(), (F.col("close") > F.col("hi20")).cast("double")), 15),
    ]
    score, cover = weighted(parts)
    return f.withColumns({"score": score, "coverage": cover})


def _component(stance: Column, strength: Column, name: str) -> Column:
    w = WEIGHTS[name]
    return F.struct(F.lit(name).alias("name"), F.coalesce(stance, F.lit(0)).alias("stance"), F.coalesce(F.coalesce(stance, F.lit(0)) * clamp(strength, 0, 1) * w, F.lit(0.0)).alias("points"))


def evidence(bars: DataFrame) -> DataFrame:
    """Signed components, their sum on 50, a grade that wants agreement, and an action that gates can only make
    more careful."""
    f = score_frame(bars)
    sign = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    comps = F.array(
        _component(sign(F.col("close") > F.col("sma50"), F.col("close") < F.col("sma50")), F.abs(F.col("close") / F.col("sma50") - 1) / 0.05, "trend"),
        _component(sign(F.col("rsi_simple_100") > 55, F.col("rsi_simple_100") < 45), F.abs(F.col("rsi_simple_100") - 50) / 30, "momentum"),
        _component(sign(F.col("cmf20") > 0.05, F.col("cmf20") < -0.05), F.abs("cmf20") / 0.3, "volume"),
        _component(sign(F.col("bandwidth") < 0.05, F.col("bandwidth") > 0.2), F.lit(0.5), "volatility"),
        _component(sign(F.col("pct_b") < 0.2, F.col("pct_b") > 0.8), F.lit(0.7), "location"),
        _component(sign(F.col("close") > F.col("hi20"), F.col("close") < F.col("lo20")), F.lit(1.0), "breakout"),
    )
    f = f.withColumn("comps", comps)
    f = f.withColumns({
        "score": clamp(50 + F.aggregate("comps", F.lit(0.0), lambda a, x: a + x["points"]), 0, 100),
        "n_bull": F.size(F.filter("comps", lambda x: x["stance"] > 0)), "n_bear": F.size(F.filter("comps", lambda x: x["stance"] < 0)),
        "rr": F.try_divide(F.col("hi20") - F.col("close"), F.col("close") - F.col("lo20")),
    })
    top = F.greatest("n_bull", "n_bear")
    s, bull, bear = F.col("score"), F.col("n_bull") > F.col("n_bear"), F.col("n_bear") > F.col("n_bull")
    grade = F.when((s >= 78) & (top >= 4), "A").when((s >= 65) & (top >= 3), "B").when(s >= 50, "C").when(s >= 35, "D").otherwise("F")
    action = F.when(bull & (s >= 65), "BUY").when(bull & (s >= 50), "WATCH FOR BUY").when(bear & (s <= 35), "SELL / REDUCE").when(bear & (s <= 45), "WATCH FOR SELL").otherwise("NEUTRAL")
    f = f.withColumns({"grade": grade, "action": action})
    return f.withColumn("action", F.when((F.col("action") == "BUY") & (F.col("rr") < 1.5), "WATCH FOR BUY").otherwise(F.col("action")))


def decision_changes(ev: DataFrame, delta: float = 8.0) -> DataFrame:
    """Bars on which the decision moved since the bar before: score, action or grade."""
    f = ev.withColumns({"score_1": P.lag("score"), "action_1": P.lag("action"), "grade_1": P.lag("grade")}).filter("action_1 is not null")
    what = F.array_compact(F.array(F.when(F.abs(F.col("score") - F.col("score_1")) >= delta, "score"), F.when(F.col("action") != F.col("action_1"), "action"), F.when(F.col("grade") != F.col("grade_1"), "grade")))
    return f.withColumn("changed", F.array_join(what, ",")).filter("changed != ''")


def grade_outcomes(ev: DataFrame, horizon: int = 20, target: float = 0.03, stop: float = 0.02) -> DataFrame:
    """BUY decisions against the path after them: the target wins ties, an incomplete path is pending."""
    f = ev.withColumn("path", F.collect_list(F.struct("bar_ix", "high", "low")).over(P.FWD(horizon))).filter("action = 'BUY'")
    first = lambda test: F.array_min(F.transform(F.filter("path", test), lambda s: s["bar_ix"]))
    f = f.withColumns({"up": first(lambda s: s["high"] >= F.col("close") * (1 + target)), "dn": first(lambda s: s["low"] <= F.col("close") * (1 - stop))})
    return f.withColumn("outcome", F.when(F.col("up").isNotNull() & (F.col("dn").isNull() | (F.col("up") <= F.col("dn"))), "win").when(F.col("dn").isNotNull(), "loss").when(F.size("path") < horizon, "pending").otherwise("flat"))


def conviction(f: DataFrame) -> DataFrame:
    """Liquidity, momentum, trend and structure in one number."""
    parts = [(ramp(F.log10(F.greatest(F.col("volume"), F.lit(1.0))), 0, 3), 20), (ramp(F.col("roc10"), -0.05, 0.05), 20), (ramp(F.col("close") / F.col("sma50"), 0.95, 1.05), 30), (ramp(F.col("pct_b"), 0, 1), 30)]
    score, cover = weighted(parts)
    return f.withColumns({"conviction": score, "conviction_coverage": cover})


def admit(candidates: DataFrame, book: str, capital: float = 1e6, risk_each: float = 0.01, heat: float = 0.05, per_sector: int = 2, positions: int = 6) -> DataFrame:
    """Greedy admission by score under caps on heat, sector and count: whether a candidate fits depends on those
    taken before it, so each book's candidates (at most a market's symbols) go through one fold.  ``shares`` is null where the count does not fit a long."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "symbol"], ascending=[False, True], ignore_index=True)
        used, taken, sectors, out = 0.0, 0, {}, []
        for sector, price, stop in pdf[["sector", "price", "stop"]].itertuples(index=False):
            risk = price - stop
            why = "no_risk" if not risk > 0 else "positions" if taken >= positions else "sector" if sectors.get(sector, 0) >= per_sector else "heat" if used + risk_each > heat + 1e-12 else ""
            if not why:
                taken, used = taken + 1, used + risk_each
                sectors[sector] = sectors.get(sector, 0) + 1
            count = 0.0 if why else capital * risk_each / risk
            out.append((why == "", why, int(count) if count < 2**63 else None))
        admitted, reason, shares = zip(*out)
        pdf = pdf.assign(admitted=admitted, reason=reason, shares=pd.array(shares, dtype="Int64"))
        return pdf[[book, "symbol", "admitted", "reason", "shares"]]

    kind = dict(candidates.dtypes)[book]
    return candidates.groupBy(book).applyInPandas(fold, f"{book} {kind}, symbol string, admitted boolean, reason string, shares long")


def confluence(hits: DataFrame, bullish: Column, bearish: Column) -> DataFrame:
    """Votes of all signals of a symbol and day, for and against."""
    out = hits.groupBy("symbol", "trade_date").agg(F.count_if(bullish).alias("agree"), F.count_if(bearish).alias("disagree"), F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))
    return out.withColumn("net", F.col("agree") - F.col("disagree"))


def event_report(hits: DataFrame) -> DataFrame:
    """Counts by symbol and bias with totals (ROLLUP)."""
    return hits.rollup("symbol", "bias").agg(F.count("*").alias("n"), F.max("trade_date").alias("last"))


def leaderboard(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each symbol, one column for each kind."""
    return hits.groupBy("symbol").pivot("bias", kinds).agg(F.count(F.lit(1))).na.fill(0)


def own_return_strategy(bars: DataFrame) -> DataFrame:
    """A long-flat strategy by the 20-bar mean: next-bar returns, total return, Sharpe, profit factor, drawdown."""
    f = bars.withColumns({"sma20": P.full(F.avg("close"), 20)}).withColumn("w", F.when(F.col("close") > F.col("sma20"), 1.0).otherwise(0.0))
    f = f.withColumn("r", P.lag("w") * (F.col("close") / P.lag("close") - 1)).filter("r is not null")
    w = Window.partitionBy("symbol").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("eq", F.sum(F.log1p("r")).over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("eq").over(w)))
    return f.groupBy("symbol").agg(
        F.round(F.exp(F.sum(F.log1p("r"))) - 1, 6).alias("total_return"), F.round(F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(252.0)), 4).alias("sharpe"),
        F.round(F.try_divide(F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))), 4).alias("profit_factor"), F.round(F.max(1 - F.exp(F.col("eq") - F.col("peak"))), 6).alias("max_drawdown"),
    )
