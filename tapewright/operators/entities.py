"""Companies in texts: tickers in capitals, names as whole phrases, and a relevance score that wants more than an ambiguous ticker.

Phrases are matched by a join.  A phrase has at least two words, so its key is a hash of its first two; a text gives each pair of neighbouring
words once, as a number.  Where the phrases' keys are few the pairs meet them where the texts lie, else both sides are dealt by the pair, and a
common pair is spread like any skewed join.  What meets is a candidate, (text, phrase), and is verified on the whole text.
The number of phrases does not matter to a text's cost, and no phrase is an expression of the plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Words of a legal name that are no part of the phrase, and the points of an entity.
LEGAL = ("limited", "ltd", "company", "co", "corporation", "corp", "pvt", "private", "plc", "inc")
POINTS = {"ticker": 4, "company": 4, "watch": 1}
LEAST_WORDS, LEAST_CHARS = 2, 8


def normal(text: Column) -> Column:
    """Lower case, other than letters, digits, hyphens and spaces as one space, trimmed."""
    # one pass, which leaves lone spaces alone
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\- ][^a-z0-9\-]*| [^a-z0-9\-]+", " "))


def company_phrase(name: Column) -> Column:
    """The phrase of a legal name, without its legal words and a leading article; null where it is one word or short."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\b({'|'.join(LEGAL)})\b\.?", " ")
    phrase = F.trim(F.regexp_replace(normal(bare), "^the ", ""))
    return F.when((F.size(F.split(phrase, " ")) >= LEAST_WORDS) & (F.length(phrase) >= LEAST_CHARS), phrase)


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(key, phrase) of every phrase, as whole words, in every text.  ``key`` is unique; phrases are normal and of two words or more;
    null texts and phrases meet nothing; repeated phrases count once."""
    low = texts.select(F.col(key), normal(F.col(text)).alias("__low"))
    own = low.filter(F.contains("__low", F.lit(" "))).select(key, F.split("__low", " ").alias("__words"))
    pairs = F.zip_with("__words", F.expr("slice(__words, 2, size(__words))"), lambda a, b: F.xxhash64(a, b))
    # the last word has no neighbour; its number meets nothing, or fails below
    pairs = own.select(key, F.explode(F.array_distinct(pairs)).alias("__pair"))
    wanted = phrases.select(F.col(phrase).alias("phrase")).filter("phrase IS NOT NULL").distinct()
    first = F.split("phrase", " ")
    met = pairs.join(wanted.withColumn("__pair", F.xxhash64(first[0], first[1])), "__pair").select(key, "phrase")
    inside = F.contains(F.concat(F.lit(" "), F.col("__low"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    return met.join(low, key).filter(inside).select(key, "phrase")


def ticker_hits(texts: DataFrame, tickers: DataFrame, key: str, text: str = "text", ticker: str = "ticker") -> DataFrame:
    """(key, ticker) of every known ticker that stands in capitals as a whole word."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![A-Za-z0-9])([A-Z][A-Z0-9]{1,15})(?![A-Za-z0-9])"), F.lit(1)))
    own = texts.select(key, F.explode(found).alias("ticker"))
    return own.join(tickers.select(F.upper(ticker).alias("ticker")).distinct(), "ticker").select(key, "ticker")


def plain_terms(groups: dict[str, dict[str, int]]) -> bool:
    """Are all terms of letters and digits only?  Then what stands between words does not matter, and texts need not be normal."""
    return all(re.fullmatch("[a-z0-9]+", t) for terms in groups.values() for t in terms)


def keyword_hits(low: Column, groups: dict[str, dict[str, int]]) -> dict[str, Column]:
    """For each group, the term with the largest weight in a text in lower case (a normal one for terms of more than letters and digits):
    (weight, term), null without one.  Of equal weights the last by name."""
    out = {}
    for group, terms in groups.items():
        hits = [F.when(low.contains(t) & low.rlike(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])"), F.struct(F.lit(w).alias("weight"), F.lit(t).alias("term"))) for t, w in terms.items()]
        out[group] = F.array_max(F.array_compact(F.array(*hits)))
    return out


def entity_relevance(
    texts: DataFrame, tickers: DataFrame, phrases: DataFrame, groups: dict[str, dict[str, int]], key: str, text: str = "text", watch: tuple[str, ...] = (),
    ambiguous: tuple[str, ...] = (), source_bonus: dict[str, int] | None = None, context: tuple[str, ...] = ("geo", "foreign_noise"), threshold: int = 2,
) -> DataFrame:
    """(key, score, passes, reasons): points of the first ticker that is not ambiguous, of the longest company phrase, of the best term of each
    group, and of the source.

    An ambiguous ticker (the last one before the first plain ticker) counts only with a company phrase or a positive term of a
    group other than ``context`` beside it.  Without any such, a plain ticker or a source of three points, the score is 0."""
    bonus = F.lit(0)
    for s, b in (source_bonus or {}).items():
        bonus = F.when(F.col("source") == s, b).otherwise(bonus)
    columns = [key, text] + (["source"] if source_bonus else [])
    t = texts.select(*columns)
    names = phrase_hits(t, phrases, key, text).groupBy(key).agg(F.max(F.struct(F.length("phrase").alias("n"), F.col("phrase").alias("phrase"))).alias("company"))
    found = ticker_hits(t, tickers, key, text).withColumn("plain", ~F.col("ticker").isin(list(ambiguous)) if ambiguous else F.lit(True))
    first = F.min(F.when(F.col("plain"), F.col("ticker"))).over(Window.partitionBy(key))
    found = found.withColumn("first", first).groupBy(key).agg(
        F.first("first").alias("ticker"), F.max(F.when(~F.col("plain") & (F.col("first").isNull() | (F.col("ticker") < F.col("first"))), F.col("ticker"))).alias("doubtful")
    )
    t = t.join(names, key, "left").join(found, key, "left").withColumns({"low": F.lower(F.coalesce(F.col(text), F.lit(""))) if plain_terms(groups) else normal(F.col(text)), "bonus": bonus})
    best = keyword_hits(F.col("low"), groups)
    t = t.withColumns({f"g_{g}": b for g, b in best.items()})
    solid = F.col("company").isNotNull()
    for g in groups:
        if g not in context:
            solid = solid | F.coalesce(F.col(f"g_{g}")["weight"] > 0, F.lit(False))
    t = t.withColumn("solid", solid)
    backed = F.col("doubtful").isNotNull() & F.col("solid")
    watched = F.col("ticker").isin(list(watch)) if watch else F.lit(False)
    points = [
        F.when(F.col("ticker").isNotNull(), POINTS["ticker"] + F.when(watched, POINTS["watch"]).otherwise(0)), F.when(F.col("company").isNotNull(), POINTS["company"]),
        *[F.col(f"g_{g}")["weight"] for g in groups], F.when(backed, POINTS["ticker"]), F.col("bonus"),
    ]
    total = sum((F.coalesce(p, F.lit(0)) for p in points), F.lit(0))
    counts = F.col("solid") | (F.col("bonus") >= 3) | F.col("ticker").isNotNull()
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    reasons = [
        F.when(F.col("ticker").isNotNull(), say("ticker:", F.col("ticker"))), F.when(watched, say("watchlist:", F.col("ticker"))), F.when(F.col("company").isNotNull(), say("company:", F.col("company")["phrase"])),
        *[F.when(F.col(f"g_{g}").isNotNull(), say(f"{g}:", F.col(f"g_{g}")["term"], "(", F.col(f"g_{g}")["weight"].cast("string"), ")")) for g in groups],
        F.when(backed, say("ticker(backed):", F.col("doubtful"))), F.when(F.col("doubtful").isNotNull() & ~F.col("solid"), say("ticker(ignored):", F.col("doubtful"))),
        F.when(F.col("bonus") != 0, say("source:+", F.col("bonus").cast("string"))), F.when(~counts, F.lit("context only")),
    ]
    t = t.withColumn("score", F.when(counts, total).otherwise(0).cast("int"))
    return t.select(key, "score", (F.col("score") >= threshold).alias("passes"), F.array_join(F.array_compact(F.array(*reasons)), ";").alias("reasons"))
