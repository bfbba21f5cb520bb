"""Company phrases, tickers and relevance over whole documents, with SQL that looks for each phrase in each text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import entities as N
from tapewright.session import table
from tapewright.sources import content

#: Words of licence lines and of the invented prose stand in for markets' terms; capitals of licence names for tickers.
TICKERS, AMBIGUOUS, WATCH = ("MIT", "GPL", "GNU", "CC", "BY", "BSD"), ("CC", "BY"), ("MIT",)
GROUPS = {"rights": {"license": 2, "licensed": 1, "reserved": 3}, "geo": {"universal": 1}, "noise": {"free": -2}}
SOURCES = {"src1": 3, "src2": 1}

_NORMAL = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\- ]+', ' ', 'g'), ' +', ' ', 'g'))"
_BARE = f"regexp_replace(lower(coalesce(name, '')), '\\b({'|'.join(N.LEGAL)})\\b\\.?', ' ', 'g')"
#: The first five words of a benchmark item as the name of a company, in every item's form.
NAMES_CTE = f"""WITH names AS (
  SELECT CASE item_id % 3 WHEN 0 THEN 'The ' || w || ' Company Limited' WHEN 1 THEN w || ' (Pvt.) Ltd.' ELSE w END AS name
  FROM (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 2 + item_id % 4), ' ') AS w FROM benchmark)
  UNION ALL SELECT s_name FROM supplier UNION ALL SELECT unnest(['General Public License Inc.', 'The MIT Company', 'Free Software Foundation'])
),
n AS (SELECT trim(regexp_replace({_NORMAL.format(_BARE)}, '^the ', '')) AS phrase FROM names),
p AS (SELECT DISTINCT phrase FROM n WHERE len(string_split(phrase, ' ')) >= 2 AND length(phrase) >= 8),
t AS (SELECT doc_id, source, text, {_NORMAL.format('text')} AS low FROM documents),
hits AS (SELECT doc_id, phrase FROM t JOIN p ON contains(' ' || low || ' ', ' ' || phrase || ' '))"""
PHRASES_SQL = NAMES_CTE + " SELECT doc_id, phrase FROM hits"


def _word(t: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"


_best = {g: "greatest(" + ", ".join(f"CASE WHEN {_word(t)} THEN {w} END" for t, w in terms.items()) + ", NULL)" for g, terms in GROUPS.items()}
_term = {g: "CASE " + " ".join(f"WHEN {_word(t)} THEN '{t}'" for t, _ in sorted(terms.items(), key=lambda x: (-x[1], x[0]))) + " END" for g, terms in GROUPS.items()}
RELEVANCE_SQL = NAMES_CTE + f""",
k AS (
  SELECT doc_id, list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda w: w IN ({', '.join(f"'{x}'" for x in TICKERS)}))) AS ts FROM t
),
c AS (SELECT doc_id, max_by(phrase, (length(phrase), phrase)) AS company FROM hits GROUP BY doc_id),
s AS (
  SELECT t.doc_id, company, list_min(list_filter(ts, lambda x: x NOT IN ('CC', 'BY'))) AS ticker, ts, {', '.join(f'{b} AS w_{g}, {_term[g]} AS t_{g}' for g, b in _best.items())},
    CASE source WHEN 'src1' THEN 3 WHEN 'src2' THEN 1 ELSE 0 END AS bonus FROM t JOIN k ON k.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
),
d AS (SELECT *, list_max(list_filter(ts, lambda x: x IN ('CC', 'BY') AND (ticker IS NULL OR x < ticker))) AS doubtful, company IS NOT NULL OR coalesce(w_rights > 0, false) OR coalesce(w_noise > 0, false) AS solid FROM s),
e AS (
  SELECT *, CASE WHEN solid OR bonus >= 3 OR ticker IS NOT NULL THEN CASE WHEN ticker IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN ticker = 'MIT' THEN 1 ELSE 0 END + CASE WHEN company IS NOT NULL THEN 4 ELSE 0 END
    + coalesce(w_rights, 0) + coalesce(w_geo, 0) + coalesce(w_noise, 0) + CASE WHEN doubtful IS NOT NULL AND solid THEN 4 ELSE 0 END + bonus ELSE 0 END AS score FROM d
)
SELECT doc_id, CAST(score AS INT) AS score, score >= 2 AS passes, array_to_string(list_filter([
  'ticker:' || ticker, CASE WHEN ticker = 'MIT' THEN 'watchlist:MIT' END, 'company:' || company, {', '.join(f"'{g}:' || t_{g} || '(' || CAST(w_{g} AS VARCHAR) || ')'" for g in GROUPS)},
  CASE WHEN solid THEN 'ticker(backed):' || doubtful END, CASE WHEN NOT solid THEN 'ticker(ignored):' || doubtful END, CASE WHEN bonus <> 0 THEN 'source:+' || CAST(bonus AS VARCHAR) END,
  CASE WHEN NOT (solid OR bonus >= 3 OR ticker IS NOT NULL) THEN 'context only' END], lambda x: x IS NOT NULL), ';') AS reasons FROM e"""


def _phrases(spark, sf):
    words = F.array_join(F.slice(F.split("text", " "), 1, (2 + F.col("item_id") % 4).cast("int")), " ")
    form = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("The "), words, F.lit(" Company Limited"))).when(F.col("item_id") % 3 == 1, F.concat(words, F.lit(" (Pvt.) Ltd."))).otherwise(words)
    names = table(spark, sf, "benchmark").select(form.alias("name")).unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    names = names.unionByName(spark.createDataFrame([("General Public License Inc.",), ("The MIT Company",), ("Free Software Foundation",)], "name string"))
    return names.select(N.company_phrase(F.col("name")).alias("phrase"))


def q_phrases(spark, sf):
    return N.phrase_hits(table(spark, sf, "documents"), _phrases(spark, sf), "doc_id")


def q_relevance(spark, sf):
    tickers = spark.createDataFrame([(t,) for t in TICKERS], "ticker string")
    return N.entity_relevance(
        table(spark, sf, "documents"), tickers, _phrases(spark, sf), GROUPS, "doc_id", watch=WATCH, ambiguous=AMBIGUOUS, source_bonus=SOURCES
    )


CONTENT_SQL = """SELECT sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS n_bytes, min(url) AS first_path, count(*) AS copies FROM pages WHERE html IS NOT NULL GROUP BY html"""


def q_contents(spark, sf):
    rows = content.addressed(table(spark, sf, "pages"), F.col("html").cast("binary"), F.col("url"), F.lit(0))
    return rows.select("sha256", "n_bytes", "first_path", "copies")


QUERIES = {"src_contents": (q_contents, CONTENT_SQL), "txt_company_phrases": (q_phrases, PHRASES_SQL), "txt_entity_relevance": (q_relevance, RELEVANCE_SQL)}
