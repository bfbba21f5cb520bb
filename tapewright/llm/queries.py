"""The contract queries: thin layers over the operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import decontam, fertility, filter_audit, html_density, icws, license_scan, mixing, ngram_join, pairwise_rank, sharding, token_alignment, toxicity, warc
from tapewright.session import prepare, table


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.plan_shards(table(prepare(spark), sf_dir, "documents"), n_shards=8)


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(prepare(spark), sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(table(prepare(spark), sf_dir, "pages"))


def op4_poisson_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(prepare(spark), sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("replica").cast("long").alias("replica"))


def op5_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure_fertility(table(prepare(spark), sf_dir, "documents"))


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(prepare(spark), sf_dir, "documents"))


def op8_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pairwise_rank.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op10_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sorted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_audit.audit_orders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(prepare(spark), sf_dir, "documents"))


def op13_dangling_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(prepare(spark), sf_dir, "documents"))


def queries() -> dict:
    own = [
        op1_vector_bin_packing, op2_warc_bundles, op3_composite_text_density, op4_poisson_replication,
        op5_greedy_string_tiling, op6_tokeniser_fertility, op7_license_templates, op8_pairwise_ranking,
        op9_weighted_minhash, op10_toxic_neighbours, op11_sorted_audit, op12_ngram_product, op13_dangling_suffix,
    ]
    return {f.__name__: f for f in own}


OP2_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM f
"""

OP4_SQL = """
WITH w AS (SELECT 'src' || CAST(i AS VARCHAR) AS source, 0.05 AS weight FROM range(20) r(i)),
d AS (
  SELECT doc_id, source, lang, strlen(coalesce(text, '')) AS bytes,
    CAST(('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT)
      / 4503599627370496.0 AS draw
  FROM documents
), s AS (
  SELECT d.source, sum(bytes) AS bytes, any_value(weight) AS weight FROM d JOIN w ON w.source = d.source GROUP BY d.source HAVING sum(bytes) > 0
), r AS (
  SELECT source, weight / (SELECT sum(weight) FROM s) * CAST((SELECT sum(bytes) FROM s) AS DOUBLE) / CAST(bytes AS DOUBLE) AS rate FROM s
  WHERE true
), p AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS step
  FROM r, range(200) t(k)
), c AS (
  SELECT d.doc_id, d.source, d.lang,
    CASE WHEN r.source IS NULL THEN 1 ELSE (SELECT count(*) FROM p WHERE p.source = d.source AND p.step <= d.draw) END AS n
  FROM d LEFT JOIN r ON r.source = d.source
)
SELECT doc_id, source, lang, CAST(unnest(range(CAST(n AS BIGINT))) AS BIGINT) AS replica FROM c WHERE n > 0
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
  ] AS fails FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, fails
), x AS (SELECT i FROM range(1, 6) r(i)),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT c.*, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(k.i AS INTEGER) AS step, p[k.i] AS own, fails[p[k.i]] AS bad,
    len(list_filter(p[1:k.i - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS n_bad
  FROM c, o, x k
), r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND n_bad = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS x FROM t
), e AS (SELECT r, len(x) AS n, unnest(x) AS s FROM g),
p AS (
  SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.s = b.s AND a.r <> b.r AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), c AS (
  SELECT r AS node, r AS seen FROM g UNION SELECT c.node, p.v FROM c JOIN p ON p.u = c.seen
)
SELECT g.doc_id, CAST(len(any_value(g.x)) AS BIGINT) AS n_shingles, CASE WHEN len(any_value(g.x)) = 0 THEN g.doc_id ELSE min(o.doc_id) END AS component_id
FROM c JOIN g ON g.r = c.node JOIN g o ON o.r = c.seen GROUP BY g.r, g.doc_id
"""


def _op7_sql() -> str:
    """Every line that holds a word of notices against every template; runs of lines are tested by brute force instead."""
    def sql_text(t):
        return "'" + t.replace("'", "''") + "'"

    rows = ", ".join(f"({i}, {sql_text(label)}, {sql_text(text)})" for i, (label, text) in enumerate(license_scan.TEMPLATES))
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    words = lambda x: f"regexp_extract_all({fold.format(x)}, {word})"
    at = " OR ".join(
        "(" + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split())) + ")" for phrase in license_scan.PHRASES
    )
    base = ", ".join(
        f"CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'''w[i + {k}] = '{p}' ''' for k, p in enumerate(phrase.split()))})) > 0 THEN '{label}' END"
        for phrase, label in license_scan.PHRASES.items()
    )
    return f"""
WITH t AS (SELECT i, label, list_distinct({words('x')}) AS t FROM (VALUES {rows}) v(i, label, x)),
n AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, row_no, text, {words('text')} AS w FROM n),
b AS (SELECT doc_id, row_no, w, list_filter(range(1, len(w) + 1), lambda i: {at}) AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM d),
l AS (SELECT row_no, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT row_no, string_split(text, chr(10)) AS ls FROM n)),
m AS (
  SELECT l.row_no, l.line_no, t.i, t.label, t.t, len(list_intersect(t.t, list_distinct({words('l.line')}))) AS shared
  FROM (SELECT * FROM l WHERE {fold.format('line')} SIMILAR TO '(.|\\n)*(license|licensed|released|copyright|permission|redistribution|source|program)(.|\\n)*') l, t
), h AS (SELECT * FROM m WHERE shared >= ceil({license_scan.CONTAINMENT} * len(t) - 1e-9)),
own AS (
  SELECT h.row_no, h.line_no, h.label, shared / len(t) AS c,
    EXISTS (SELECT 1 FROM h o WHERE o.row_no = h.row_no AND o.line_no = h.line_no AND len(o.t) > len(h.t) AND len(list_intersect(o.t, h.t)) = len(h.t)) AS inside
  FROM h
), s AS (
  SELECT row_no, max(c) AS best, count(DISTINCT line_no) AS n_blocks, list(DISTINCT label) FILTER (WHERE NOT inside) AS found FROM own GROUP BY row_no
), best AS (
  SELECT own.row_no, min(line_no) AS best_block FROM own JOIN s ON own.row_no = s.row_no AND own.c = s.best GROUP BY own.row_no
)
SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score,
  CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks, CAST(best_block AS BIGINT) AS best_block
FROM b LEFT JOIN s ON s.row_no = b.row_no LEFT JOIN best ON best.row_no = b.row_no
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_bundles": OP2_SQL, "op4_poisson_replication": OP4_SQL, "op7_license_templates": _op7_sql(), "op11_sorted_audit": OP11_SQL, "op12_ngram_product": OP12_SQL}
