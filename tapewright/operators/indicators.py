"""Technical indicators as window columns: each function takes a bar panel and returns it with
more columns.  Variants of one indicator have names of their own (``rsi_simple_null``,
``rsi_simple_100`` ...), since they differ on edge cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.scalars import monotone_quantile
from tapewright.functions.windows import BARS as P
from tapewright.functions.windows import corr, run_length

def _cols() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in ("close", "high", "low", "open", "volume"))


def true_range() -> Column:
    """The first bar of a symbol has only its own range."""
    _, h, lo, _, _ = _cols()
    pc = P.lag("close")
    return F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc))


def trend(bars: DataFrame) -> DataFrame:
    """Moving averages, Bollinger bands (both deviations), Donchian, Ichimoku, rates of change."""
    c, _, _, o, _ = _cols()
    sma20, mid = P.full(F.avg("close"), 20), lambda n: (P.full(F.max("high"), n) + P.full(F.min("low"), n)) / 2
    sd_s, sd_p = P.full(F.stddev_samp("close"), 20), P.full(F.stddev_pop("close"), 20)
    out = bars.withColumns({
        "sma20": sma20, "sma50": P.full(F.avg("close"), 50), "sma200": P.full(F.avg("close"), 200),
        "bb_up": sma20 + 2 * sd_s, "bb_low": sma20 - 2 * sd_s, "bb_up_pop": sma20 + 2 * sd_p, "bb_low_pop": sma20 - 2 * sd_p,
        "don_high": P.full(F.max("high"), 20), "don_low": P.full(F.min("low"), 20),
        "tenkan": mid(9), "kijun": mid(26), "mid52": mid(52),
        "roc10": c / P.lag("close", 10) - 1, "mom20": c - P.lag("close", 20), "gap": o / P.lag("close") - 1,
        "zscore20": F.try_divide(c - sma20, sd_p),
    })
    return out.withColumns({
        "pct_b": F.try_divide(c - F.col("bb_low"), F.col("bb_up") - F.col("bb_low")),
        "bandwidth": (F.col("bb_up") - F.col("bb_low")) / F.col("sma20"),
        "span_a": P.lag((F.col("tenkan") + F.col("kijun")) / 2, 26), "span_b": P.lag("mid52", 26),
    })


def oscillators(bars: DataFrame) -> DataFrame:
    """RSI from simple means, stochastics, CCI and money flow index with their null rules."""
    c, h, lo, _, v = _cols()
    diff = c - P.lag("close")
    tp = (h + lo + c) / 3
    out = bars.withColumns({"diff": diff, "tp": tp}).withColumns({
        "gain": P.full(F.avg(F.greatest("diff", F.lit(0.0))), 14, "diff"),
        "loss": P.full(F.avg(F.greatest(-F.col("diff"), F.lit(0.0))), 14, "diff"),
        "dtp": F.col("tp") - P.lag("tp"),
        "hi14": P.full(F.max("high"), 14), "lo14": P.full(F.min("low"), 14),
        "tp20": P.full(F.avg("tp"), 20), "tps": F.when(F.count("tp").over(P.W(20)) == 20, F.collect_list("tp").over(P.W(20))),
    })
    raw = F.col("tp") * v
    out = out.withColumns({
        "pos14": P.full(F.sum(F.when(F.col("dtp") > 0, raw).otherwise(0.0)), 14, "dtp"),
        "neg14": P.full(F.sum(F.when(F.col("dtp") < 0, raw).otherwise(0.0)), 14, "dtp"),
        "stoch_k": F.try_divide(100 * (c - F.col("lo14")), F.col("hi14") - F.col("lo14")),
        "mad20": F.aggregate("tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("tp20"))) / 20,
    })
    rs = F.col("gain") / F.when(F.col("loss") != 0, F.col("loss"))
    ratio = F.col("pos14") / F.when(F.col("neg14") != 0, F.col("neg14"))
    return out.withColumns({
        "rsi_simple_null": 100 - 100 / (1 + rs),
        "rsi_simple_100": F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + rs)),
        "stoch_d": P.full(F.avg("stoch_k"), 3, "stoch_k"),
        "cci20": F.try_divide(F.col("tp") - F.col("tp20"), 0.015 * F.col("mad20")),
        "mfi_null": 100 - 100 / (1 + ratio),
        "mfi_100": F.when(F.col("neg14") == 0, 100.0).otherwise(100 - 100 / (1 + ratio)),
        "mfi_50": F.when(F.col("neg14") == 0, F.when(F.col("pos14") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + ratio)),
    }).drop("tps")


def volume(bars: DataFrame) -> DataFrame:
    """OBV, accumulation/distribution, CMF, volume-price trend, VROC, VWAP, VWMA, relative volume."""
    c, h, lo, _, v = _cols()
    pc = P.lag("close")
    mfm = F.when(h > lo, ((c - lo) - (h - c)) / (h - lo)).otherwise(0.0)
    out = bars.withColumns({
        "obv_step": F.coalesce(F.signum(c - pc), F.lit(0.0)) * v, "mfv": mfm * v,
        "vpt_step": F.coalesce(v * (c - pc) / pc, F.lit(0.0)), "force_raw": (c - pc) * v, "tpv": (h + lo + c) / 3 * v, "cv": c * v,
    })
    vol20 = P.full(F.sum("volume"), 20)
    return out.withColumns({
        "obv": P.cum(F.sum("obv_step")), "adl": P.cum(F.sum("mfv")), "vpt": P.cum(F.sum("vpt_step")),
        "cmf20": P.full(F.sum("mfv"), 20) / vol20,
        "vroc14": 100 * (v / P.lag("volume", 14) - 1),
        "vwap20": P.full(F.sum("tpv"), 20) / vol20, "vwma20": P.full(F.sum("cv"), 20) / vol20,
        "anchored_vwap": P.cum(F.sum("tpv")) / P.cum(F.sum("volume")),
        "rvol_prior": v / P.prior(F.avg("volume"), 20), "rvol_incl": v / P.full(F.avg("volume"), 20),
    }).drop("obv_step", "mfv", "vpt_step", "tpv", "cv")


def mid_rank(values: Column, x: Column) -> Column:
    """Share of ``values`` below x, with ties counted half."""
    return (F.size(F.filter(values, lambda y: y < x)) + 0.5 * F.size(F.filter(values, lambda y: y == x))) / F.size(values)


def volatility(bars: DataFrame) -> DataFrame:
    """True range and its mean, historical volatility, causal percentile ranks, rolling quantiles."""
    c, h, lo, _, _ = _cols()
    out = bars.withColumns({"tr": true_range(), "ret": c / P.lag("close") - 1, "lret": F.log(c / P.lag("close"))})
    out = out.withColumns({
        "atr14": P.full(F.avg("tr"), 14), "adr14": P.full(F.avg(h / lo - 1), 14),
        **{f"hv{n}": P.full(F.stddev_samp("lret"), n, "lret") * math.sqrt(252) for n in (10, 20, 60)},
        "sd20": P.full(F.stddev_samp("close"), 20), "sma20": P.full(F.avg("close"), 20),
    }).withColumn("bandwidth", 4 * F.col("sd20") / F.col("sma20"))
    before = F.collect_list("atr14").over(P.WP(60))
    return out.withColumns({
        # the rank looks at prior bars only, and wants 80 % of them
        "atr_rank": F.when(F.size(before) >= 48, mid_rank(before, F.col("atr14"))),
        "bw_q10": P.full(F.percentile("bandwidth", F.lit(0.1)), 60, "bandwidth"),
        "close_med90": P.full(F.percentile("close", F.lit(0.5)), 90),
    })


def regression(bars: DataFrame) -> DataFrame:
    """Rolling least squares of closes on the bar number."""
    out = bars.withColumn("lc", F.log("close"))
    return out.withColumns({
        "slope20": P.full(F.regr_slope("close", "bar_ix"), 20), "r2_20": P.full(F.regr_r2("close", "bar_ix"), 20),
        "drift60": P.full(F.regr_slope("lc", "bar_ix"), 60) * 252,
        "zslope20": F.try_divide(P.full(F.regr_slope("close", "bar_ix"), 20), P.full(F.stddev_pop("close"), 20)),
        "corr_cv20": F.when(F.count("close").over(P.W(20)) == 20, corr("close", "volume", P.W(20))),
    }).drop("lc")


def weekly_levels(bars: DataFrame) -> DataFrame:
    """Classic, Fibonacci and Camarilla pivot levels of the bar before, and support/resistance over 60 bars."""
    c, _, _, _, _ = _cols()
    ph, pl, pc = P.lag("high"), P.lag("low"), P.lag("close")
    out = bars.withColumns({"pp": (ph + pl + pc) / 3, "rng": ph - pl, "pc": pc, "pl": pl, "ph": ph})
    closes = F.when(F.count("close").over(P.W(60)) == 60, F.collect_list("close").over(P.W(60)))
    return out.withColumns({
        "r1": 2 * F.col("pp") - F.col("pl"), "s1": 2 * F.col("pp") - F.col("ph"),
        "r2": F.col("pp") + F.col("rng"), "s2": F.col("pp") - F.col("rng"),
        "fib_r1": F.col("pp") + 0.382 * F.col("rng"), "fib_s1": F.col("pp") - 0.382 * F.col("rng"),
        "cam_r3": F.col("pc") + F.col("rng") * 1.1 / 4, "cam_s3": F.col("pc") - F.col("rng") * 1.1 / 4,
        "support": monotone_quantile(F.filter(closes, lambda x: x <= c), 0.1),
        "resistance": monotone_quantile(F.filter(closes, lambda x: x >= c), 0.9),
    }).drop("rng", "pc", "pl", "ph")


def squeeze(bars: DataFrame) -> DataFrame:
    """Bollinger bands inside a Keltner channel of simple means, and for how many bars in a row."""
    out = bars.withColumn("tr", true_range())
    sma, sd, atr = P.full(F.avg("close"), 20), P.full(F.stddev_pop("close"), 20), P.full(F.avg("tr"), 20)
    out = out.withColumns({"sma20": sma, "width_bb": 2 * sd, "width_kc": 1.5 * atr})
    flagged = out.withColumn("squeezed", F.coalesce(F.col("width_bb") < F.col("width_kc"), F.lit(False)))
    return run_length(flagged, F.col("squeezed"), "squeeze_len")
