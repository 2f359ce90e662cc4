"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import bpe, decontamination, html, phrases, quality, ranked, ring, simhash, suffixes, token_files, toxicity, vectors, warc

QUERIES, ORACLES = {}, {}


def register(function):
    QUERIES[function.__name__] = function
    return function


# All pairs by their cosines, and the least vec_id that links reach.
ORACLES["op10_embedding_duplicates"] = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding]) THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id, vec_id AS other FROM vectors
  UNION SELECT r.vec_id, p.b FROM reached r JOIN pairs p ON p.a = r.other),
named AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counted ON a = vec_id"""


# All phrases counted one by one, and each candidate's cuts.
ORACLES["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
one AS (SELECT lang, unnest(w) AS phrase FROM cut),
f1 AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM one GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
two AS (SELECT lang, unnest([struct_pack(x := w[i], y := w[i + 1]) FOR i IN range(1, len(w))]) AS g FROM cut),
f2 AS MATERIALIZED (SELECT lang, g.x AS x, g.y AS y, count(*) AS f FROM two GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, unnest([struct_pack(x := w[i], y := w[i + 1], z := w[i + 2]) FOR i IN range(1, len(w) - 1)]) AS g FROM cut),
f3 AS MATERIALIZED (SELECT lang, g.x AS x, g.y AS y, g.z AS z, count(*) AS f FROM three GROUP BY ALL HAVING count(*) >= 10),
around AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT lang, x || ' ' || y AS phrase, c.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM f2 c JOIN f1 p USING (lang) JOIN f1 q USING (lang)
  WHERE p.phrase = c.x AND q.phrase = c.y
    AND NOT EXISTS (SELECT 1 FROM around o WHERE o.lang = c.lang AND o.x = c.x AND o.y = c.y AND 100 * o.f >= 50 * c.f)
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, p.f, q.f
  FROM f3 c JOIN f1 p ON p.lang = c.lang AND p.phrase = c.x JOIN f2 q ON q.lang = c.lang AND q.x = c.y AND q.y = c.z
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, p.f, q.f
  FROM f3 c JOIN f2 p ON p.lang = c.lang AND p.x = c.x AND p.y = c.y JOIN f1 q ON q.lang = c.lang AND q.phrase = c.z),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
best AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000"""


# Every document scored for every item.
ORACLES["op12_ranked_search"] = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM docs WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighted AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * t.docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM items JOIN df USING (term) CROSS JOIN totals t),
scored AS (
  SELECT item_id, d.doc_id, d.id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM weighted JOIN tf USING (term) JOIN docs d USING (id) CROSS JOIN totals t GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""


# SHA-1 in base32, five hexadecimal digits as four letters at a time.
ORACLES["op13_warc_archives"] = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages),
digested AS (SELECT *, sha1(html) AS hex FROM payloads)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || hex[1 + 5 * i : 5 + 5 * i] AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1)
    FOR j IN range(4)] FOR i IN range(8)]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response OR response IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to, url
FROM digested"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@register
def op2_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


@register
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op5_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.removed(table(spark, folder, "documents"))


@register
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op8_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return ring.shard(table(spark, folder, "documents"))


@register
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"))


@register
def op10_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@register
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@register
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register
def op13_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))
