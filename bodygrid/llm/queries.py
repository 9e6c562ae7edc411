"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bodygrid.llm import bpe, collocations, exact, langid, minhash, mixing, packing, pii, quality, search, secrets, tokens, warc
from bodygrid.llm.common import table

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACKING_TOKENIZER)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(table(spark, sf_dir, "documents"), COUNT_TOKENIZER)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_personal_data, op4_secret_scan, op5_best_fit_packing, op6_warc, op7_mixing, op8_exact_dedup, op9_token_counts, op10_near_dedup, op11_lexical_search, op12_byte_bpe, op13_collocations, pipeline)}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN g.last IS NOT NULL AND page_id <> g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> g.last THEN g.last END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN g ON p.h = g.h
""",
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, coalesce('+' || source, '-') AS k, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
lv AS (SELECT level FROM f WHERE level * weight < cap ORDER BY cap / weight, level LIMIT 1),
t AS (SELECT k, source_size, least(cap, coalesce((SELECT level FROM lv) * weight, cap)) AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
    sum(size) OVER (PARTITION BY d.k ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.k, h) AS same FROM d JOIN b ON d.k = b.k)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM (
  SELECT *, CAST(least(2, whole + CASE WHEN upto <= budget OR upto - budget < budget - (upto - same) THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM r)
""",
    "op8_exact_dedup": rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
""",
    "op10_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
      FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.v),
c AS (SELECT v, min(root) AS root FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, '{_TERM}'))) AS t FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d),
f AS (SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM p GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN wt USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
""",
    "op13_collocations": rf"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM x),
s AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM s WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
p AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM c WHERE f >= 100),
i AS (SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))))) AS phrase FROM p WHERE k > 2),
m AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
t AS (SELECT p.*, unnest(range(1, k)) AS j FROM p LEFT JOIN m USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR longer < f)),
v AS (SELECT t.lang, t.phrase, t.f AS a, l.f AS l, r.f AS r, n.n, j, CAST((CAST(1000 AS HUGEINT) * t.f * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM t JOIN p l ON l.lang = t.lang AND l.phrase = array_to_string(t.w[1:j], ' ') JOIN p r ON r.lang = t.lang AND r.phrase = array_to_string(t.w[j + 1:], ' ') JOIN n ON n.lang = t.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
""",
}
