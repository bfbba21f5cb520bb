"""Text operators: headline direction, sentiment with thin-coverage shrink, themes, relevance with
reasons, verbatim grounding, chunking, number parsing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.scalars import clamp
from tapewright.operators.entities import plain_terms

def contains_any(text: Column, stems) -> Column:
    out = F.lit(False)
    for s in stems:
        out = out | F.contains(text, F.lit(s))
    return out


def keyword_sum(text: Column, weights: dict[str, float]) -> Column:
    return sum((F.when(F.contains(text, F.lit(w)), F.lit(v)).otherwise(0.0) for w, v in weights.items()), F.lit(0.0))


def headlines(docs: DataFrame) -> DataFrame:
    """Every line of each document that is not blank, with its number."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "title"))
    return lines.filter(F.trim("title") != "").withColumn("line", F.col("line").cast("int"))


def classify(heads: DataFrame, positive, negative, high) -> DataFrame:
    """Direction by counts of stems that occur, and materiality by those of ``high``."""
    low = F.lower("title")
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    h = heads.withColumns({"pos": count(positive), "neg": count(negative)})
    return h.withColumns({
        "direction": F.when(F.col("pos") > F.col("neg"), "POSITIVE").when(F.col("neg") > F.col("pos"), "NEGATIVE").otherwise("NEUTRAL / REVIEW"),
        "materiality": F.when(contains_any(low, high), "HIGH").otherwise("MEDIUM"),
    })


def score_sources(heads: DataFrame, positive: dict[str, float], negative: dict[str, float]) -> DataFrame:
    """Mean headline score of each source, each headline clamped to +-4, shrunk to neutral when few."""
    low = F.lower("title")
    s = heads.withColumn("s", keyword_sum(low, positive) - keyword_sum(low, negative)).withColumn("s", clamp(F.col("s"), -4, 4))
    out = s.groupBy("source").agg(F.count("*").alias("n"), F.avg("s").alias("avg"))
    score = clamp(50 + (F.col("avg") * 11) * F.least(F.lit(1.0), F.col("n") / 4.0), 0, 100)
    out = out.withColumn("score", F.round(score, 4))
    return out.withColumns({
        "direction": F.when(F.col("score") > 56, "positive").when(F.col("score") < 44, "negative").otherwise("neutral"),
        "confidence": F.when((F.col("n") >= 3) & (F.abs(F.col("score") - 50) >= 6), "medium").otherwise("low"),
    })


def themes(heads: DataFrame, stems_of: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row for each headline and theme that it touches."""
    low = F.lower("title")
    hit = F.array_compact(F.array(*[F.when(contains_any(low, stems), F.lit(name)) for name, stems in stems_of.items()]))
    return heads.select("doc_id", "source", F.explode(hit).alias("theme"))


def relevance(heads: DataFrame, groups: dict[str, dict[str, int]], source_bonus: dict[str, int], relevant: int = 3) -> DataFrame:
    """Score, verdict and reasons: the largest weight of each group, plus the source.  Only the groups ``sector`` and
    ``macro``, or a source of bonus 3, make a headline relevant; noise cannot by itself."""
    low = F.lower("title") if plain_terms(groups) else F.regexp_replace(F.lower("title"), "[^a-z0-9\\- ]+", " ")
    h = heads.withColumn("low", low)
    best = {g: F.greatest(*[F.when(F.col("low").contains(t) & F.col("low").rlike(rf"(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])"), F.lit(w)) for t, w in terms.items()], F.lit(None).cast("int")) for g, terms in groups.items()}
    h = h.withColumns({f"g_{g}": b for g, b in best.items()})
    bonus = F.lit(0)
    for s, b in source_bonus.items():
        bonus = F.when(F.col("source") == s, b).otherwise(bonus)
    h = h.withColumn("bonus", bonus)
    solid = (F.col("g_sector") > 0) | (F.col("g_macro") > 0) | (F.col("bonus") >= 3)
    total = sum((F.coalesce(F.col(f"g_{g}"), F.lit(0)) for g in groups), F.lit(0)) + F.col("bonus")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"g_{g}").isNotNull(), F.concat(F.lit(f"{g}:"), F.col(f"g_{g}").cast("string"))) for g in groups], F.when(F.col("bonus") > 0, F.concat(F.lit("source:+"), F.col("bonus").cast("string")))))
    h = h.withColumn("score", F.when(F.coalesce(solid, F.lit(False)), total).otherwise(0))
    return h.select("doc_id", "line", F.col("score").cast("int").alias("score"), (F.col("score") >= relevant).alias("relevant"), F.array_join(reasons, ";").alias("reasons"))


def chunks(docs: DataFrame, max_chars: int = 2000, overlap: int = 200) -> DataFrame:
    """Paragraph chunks with overlap; a paragraph beyond the limit is cut hard.  Each chunk depends on the one
    before, so a document's chunks come from one pass over it."""

    def slices(paragraph: str) -> list[str]:
        """Overlapping windows; only the last may be short."""
        stop = max(len(paragraph) - overlap, 1)
        return [paragraph[at : at + max_chars] for at in range(0, stop, max_chars - overlap)]

    def cut(text: str) -> list[str]:
        done: list[str] = []
        pending = ""
        for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text.replace("\r\n", "\n")))):
            *full, rest = slices(paragraph)
            if full:
                done += [pending] * bool(pending) + full
                pending = rest
                continue
            joined = f"{pending}\n\n{rest}" if pending else rest
            if len(joined) > max_chars:
                done.append(pending)
                joined = f"{pending[len(pending) - overlap :] if overlap < len(pending) else pending}\n\n{rest}" if overlap else rest
            pending = joined
        return done + [pending] * bool(pending)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                parts = cut(text or "")
                rows += [(doc_id, i + 1, len(parts), hashlib.sha256(c.encode()).hexdigest(), c) for i, c in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "of", "sha256", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, of int, sha256 string, text string")


KEY_WORDS = 5
#: Quotes without a key that one expression looks for.
BLOCK_QUOTES = 500


def grounded(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes that occur letter for letter in a document.

    The words inside a quote, without its first and last, are whole words wherever it stands; the first of them
    (``KEY_WORDS`` at most) are its key.  Documents meet quotes on equal keys, and only what meets is compared as text.
    Quotes of one or two words have no word inside: every document is searched for them, in blocks."""
    words = lambda c: F.regexp_extract_all(c, F.lit("[\\w]+"), F.lit(0))
    q = quotes.filter(F.coalesce("text", F.lit("")) != "").select("item_id", F.col("text").alias("quote"), words("text").alias("w")).distinct()
    width = F.least(F.size("w") - 2, F.lit(KEY_WORDS))
    keyed = q.filter(F.size("w") > 2).select("item_id", "quote", width.alias("width"), F.xxhash64(F.expr(f"slice(w, 2, least(size(w) - 2, {KEY_WORDS}))")).alias("key"))
    widths = [r[0] for r in keyed.select("width").distinct().collect()]  # KEY_WORDS at most

    def runs(n: int) -> Column:
        starts = F.expr(f"CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n - 1}) ELSE CAST(array() AS ARRAY<INT>) END")
        found = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n))))  # of numbers, which is linear
        return F.transform(found, lambda k: F.struct(F.lit(n).alias("width"), k.alias("key")))

    windows = F.concat(*[runs(n) for n in widths]) if widths else F.expr("CAST(array() AS ARRAY<STRUCT<width: INT, key: BIGINT>>)")
    # only keys travel; texts are joined again to the few documents that share one
    keys = docs.select("doc_id", words("text").alias("w")).select("doc_id", F.explode(windows).alias("z")).select("doc_id", "z.width", "z.key")
    met = keys.join(keyed, ["width", "key"]).select("doc_id", "item_id", "quote").distinct()
    found = met.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains(F.col("text"), F.col("quote"))).select("doc_id", "item_id")
    short = [(r[0], r[1]) for r in q.filter(F.size("w") <= 2).select("item_id", "quote").collect()]
    for at in range(0, len(short), BLOCK_QUOTES):
        hit = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(quote)), F.lit(item)) for item, quote in short[at : at + BLOCK_QUOTES]]))
        found = found.unionByName(docs.select("doc_id", F.explode(hit).alias("item_id")))
    return found.distinct()
