"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from framerank.llm import _common as C
from framerank.llm import ann, bpe, decontaminate, langid, pii, quality, sharding, simhash, toxicity, warc

#: Where the public vocabulary is looked up; any path to such a file does.
VOCABULARY = "word_bpe_49k.json"

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_decontamination(spark, sf_dir):
    return decontaminate.digest(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def op2_simhash(spark, sf_dir):
    return simhash.digest(C.read(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.digest(C.read(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark, sf_dir):
    return ann.digest(C.read(spark, sf_dir, "embeddings"))


def op5_language_id(spark, sf_dir):
    return langid.digest(C.read(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.digest(C.read(spark, sf_dir, "pages"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op7_bpe(spark, sf_dir):
    return bpe.digest(C.read(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality(spark, sf_dir):
    return quality.digest(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op9_sharding(spark, sf_dir):
    return sharding.digest(C.read(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.digest(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_pii, op4_nearest_neighbours, op5_language_id, op6_warc, op7_bpe, op8_quality, op9_sharding, op10_toxicity)}

ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op1_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, pos.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos) pos
        JOIN win ON win.n = pos.n AND win.s = pos.s),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
         FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
}
