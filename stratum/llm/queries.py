"""The operators over their whole tables, as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .common import crc_fold, table, written


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_kernel import document_statistics, fit, score, training_rows

    stats = written(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    rows = written(training_rows(stats, table(spark, sf_dir, "labels")), "labelled")
    out = score(stats, fit(rows), ["doc_id"])
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = read_warc(spark, write_warc(pages, "page_id", "url", "html"), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_tokens, write_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = write_tokens(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import decide, labelled, learn, statistics

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(statistics(docs, "text").drop("text"), "statistics")
    rules = learn(labelled(stats, table(spark, sf_dir, "labels")))
    return decide(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


SQL = {}

SQL["op3_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

#: All pairs of vectors, and what each reaches.
SQL["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_dot_product(e, e)) AS norm FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, min(r) AS component_id, min(r) = e.vec_id AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id, n_links
"""

_BETWEEN, _UPPER, _LOWER = licenses.BETWEEN, licenses.UPPER, licenses.LOWER
_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())

#: Every document against every template, by their shingles.
SQL["op8_license_scan"] = f"""
WITH t(license, text) AS (VALUES {_NOTICES}),
     words AS (
         SELECT doc_id, NULL AS license, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BETWEEN}'), lambda x: x <> '') AS w FROM documents
         UNION ALL
         SELECT NULL, license, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '{_BETWEEN}'), lambda x: x <> '') FROM t),
     shingles AS (
         SELECT doc_id, license, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s,
                unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS at
         FROM words),
     notices AS (SELECT DISTINCT license, s FROM shingles WHERE license IS NOT NULL),
     sizes AS (SELECT license, count(*) AS n FROM notices GROUP BY license),
     hits AS (SELECT d.doc_id, n.license, count(DISTINCT d.s) AS n_found, min(d.at) AS at_word
              FROM shingles d JOIN notices n ON d.s = n.s WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id, n.license)
SELECT doc_id, license, n AS n_shingles, n_found, n_found / n AS containment, at_word
FROM hits JOIN sizes USING (license) WHERE 100 * n_found >= 80 * n
"""

#: All pairs of documents that share a shingle, and what each reaches.
SQL["op9_minhash"] = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
    JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n
"""

_QUERIES = [op1_embedding_near_dedup, op2_toxicity, op3_warc, op4_quality_kernel, op5_token_ids, op6_quality_rules, op7_mixing, op8_license_scan, op9_minhash, op10_byte_bpe]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
