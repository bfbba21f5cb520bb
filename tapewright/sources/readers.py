"""Readers and writers: CSV with header aliases, parallel-array JSON, HTML tables, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.scalars import parse_number

#: Header names by column.
ALIASES = {
    "symbol": ("symbol", "ticker", "scrip"), "trade_date": ("trade_date", "date", "time"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"),
    "close": ("close", "ldcp", "price", "c"), "volume": ("volume", "vol", "v"),
}
PAYLOAD = "s string, t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files under any of the known headers; numbers may have commas; broken rows are left out."""
    raw = spark.read.option("header", True).csv(path)
    found = {c.strip().lower(): c for c in raw.columns}

    def pick(name: str) -> Column:
        hits = [F.col(f"`{found[a]}`") for a in ALIASES[name] if a in found]
        return F.coalesce(*hits) if hits else F.lit(None).cast("string")

    out = raw.select(F.upper(F.trim(pick("symbol"))).alias("symbol"), pick("trade_date").try_cast("date").alias("trade_date"),
                     *[parse_number(pick(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    return out.filter(valid_bar() & F.col("symbol").isNotNull() & F.col("trade_date").isNotNull())


def valid_bar() -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (lo <= F.least(o, c)) & (h >= F.greatest(o, c)) & (c > 0) & (F.col("volume") >= 0)


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the bar check, and the others."""
    ok = F.coalesce(valid_bar(), F.lit(False))
    return bars.filter(ok), bars.filter(~ok)


def parse_arrays(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Rows from parallel arrays {s, t[], o[], h[], l[], c[], v[]}; payloads that are not ok or whose arrays differ in
    length give none."""
    p = payloads.withColumn("__p", F.from_json(column, PAYLOAD)).filter("__p.s = 'ok'")
    n = F.size("__p.t")
    same = F.lit(True)
    for a in ("o", "h", "l", "c", "v"):
        same &= F.size(f"__p.{a}") == n
    z = F.arrays_zip(*[F.col(f"__p.{a}").alias(a) for a in ("t", "o", "h", "l", "c", "v")])
    rows = p.filter(same).withColumn("__z", F.explode(z))
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
    return rows.select("symbol", F.timestamp_seconds("__z.t").cast("date").alias("trade_date"), *[F.col(f"__z.{k}").alias(v) for k, v in names.items()])


def html_cells(pages: DataFrame, tag: str) -> DataFrame:
    """Text of every <tag> element of a page, in order, by regular expressions (no nesting)."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    cells = pages.select("page_id", F.posexplode(found).alias("pos", "cell"))
    return cells.select("page_id", "pos", F.trim(F.regexp_replace(F.regexp_replace("cell", "<[^>]*>", ""), "&amp;", "&")).alias("cell"))


def expire(df: DataFrame, column: str, cutoff: str, archive: str) -> DataFrame:
    """Write rows older than the cutoff to CSV files and return the others."""
    df.filter(F.col(column) < F.lit(cutoff)).write.mode("append").option("header", True).csv(archive)
    return df.filter(F.col(column) >= F.lit(cutoff))
