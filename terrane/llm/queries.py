"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_code
from . import ann, bpe, cap_filters, lm, minhash, packing, sharding, suffix_dedup, toxicity, warc
from .common import crc_of_id, give_back, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(table(spark, sf_dir, "documents")).select("doc_id", "first_word", "n_words", "later")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    give_back()
    return toxicity.score(docs, model).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted", "evidence")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = lm.score(docs, crc_of_id() % 7 != 2)
    return rows.select("doc_id", (crc_of_id() % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.link(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.byte_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_ann, op4_toxicity, op5_minhash, op6_packing, op7_lm, op8_warc, op9_cap_filters, op10_sharding)}


def queries() -> dict:
    def ready(f):
        return lambda spark, sf_dir: f(share_code(spark), sf_dir)

    return {name: ready(f) for name, f in QUERIES.items()}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, list_transform(range(0, len(ws) - 49), lambda p: {{'p': p, 'h': md5(array_to_string(ws[p + 1:p + 50], ' '))}}) AS hs FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, u.p AS p, u.h AS h FROM (SELECT doc_id, unnest(hs) AS u FROM l)),
f AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM w),
m AS (SELECT doc_id, p, r > 1 AS later FROM f WHERE n > 1),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, later ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, later ORDER BY p) AS span FROM g)
SELECT doc_id, min(p) AS first_word, max(p) + 50 - min(p) AS n_words, later FROM s GROUP BY doc_id, later, span
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(0, len(ws) - 4), lambda p: array_to_string(ws[p + 1:p + 5], ' '))) END AS ss FROM d),
n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n FROM l),
s AS (SELECT doc_id, unnest(ss) AS x FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 70 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT doc_id, any_value(n.n) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM n JOIN r ON a = doc_id GROUP BY doc_id
"""

_DIGEST = "'sha1:' || sha1({})"
_TEXT_RULES = [
    (r"<!--.*?(-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(</(script|style|noscript|template)\s*>|$)", "", "gis"),
    (r"</?(p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre|hr)\b[^>]*>", "\n", "gi"),
    (r"</?[a-z!][^>]*>", "", "gis"),
]


def _plain_text_sql(html: str) -> str:
    out = html
    quote = lambda x: x.replace("'", "''")
    for pattern, to, flags in _TEXT_RULES:
        out = f"regexp_replace({out}, '{quote(pattern)}', '{to}', '{flags}')"
    for name, to in warc.ENTITIES:
        out = f"replace({out}, '&{name};', '{quote(to)}')"
    for pattern, to in warc.SPACING:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out}, ' ' || chr(10))"


def _record_id_sql(parts: str) -> str:
    h = f"md5({parts})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body, coalesce(CAST(page_id AS VARCHAR), '') AS k FROM pages),
r AS (SELECT *, {_record_id_sql("'response|' || k || '|' || target_uri || '|' || sha1(body)")} AS rid, {_DIGEST.format("body")} AS digest FROM p),
k AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'source-record: ' || rid || chr(13) || chr(10) || 'source-payload-digest: ' || digest || chr(13) || chr(10) || 'source-http-status: 200' || chr(13) || chr(10) ||
    'source-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-length: ' || CAST(strlen(body) AS VARCHAR) || chr(13) || chr(10) AS block FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_plain_text_sql("body")} FROM r
)
SELECT page_id, warc_type, {_record_id_sql("warc_type || '|' || rid")} AS record_id, rid AS refers_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, {_DIGEST.format("block")} AS block_digest, digest AS source_payload_digest, block FROM k
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM embeddings JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op5_minhash": OP5_SQL, "op8_warc": OP8_SQL, "op9_cap_filters": OP9_SQL}
