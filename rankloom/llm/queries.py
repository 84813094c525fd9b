"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontaminate, embdedup, license, linededup, lm, mixing, pii, quality, simhash, toxicity, whitening
from .common import read


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_deleted", "text")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(read(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(read(spark, sf_dir, "documents")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_personal_data": op8_personal_data,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_mixing": op12_source_mixing,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: A-Z in lower case, cut into words; every window of every item met with every window of its length of every document.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_OP9 = f"""WITH items AS (SELECT row_number() OVER () AS r, item, w FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT r, item, n, k AS j, array_to_string(w[k + 1 : k + n], ' ') AS s FROM (SELECT r, item, w, least(10, len(w)) AS n, unnest(range(greatest(len(w) - 10, 0) + 1)) AS k FROM items)),
places AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
met AS (SELECT doc_id, n, k, r, item, j FROM places JOIN wins USING (n, s)), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY ALL),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM met WHERE item IS NOT NULL) GROUP BY ALL),
runs AS (SELECT doc_id, item, min(k) AS doc_at, min(j) AS item_at, count(*) - 1 + any_value(n) AS words FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, r, k - j ORDER BY k) AS island FROM met WHERE item IS NOT NULL) GROUP BY doc_id, r, item, k - j, island),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, doc_at, item, item_at) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
    CAST(coalesce(b.words, 0) AS BIGINT) AS longest_words, b.item AS longest_item, CAST(b.item_at AS BIGINT) AS longest_item_at, CAST(b.doc_at AS BIGINT) AS longest_doc_at
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN best b USING (doc_id)"""

#: The targets' level is that of the first source, in the order in which bounds are reached, whose bound lies above it; the
#: slots that fall to a source take its words from the first on.
_OP12 = r"""WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
totals AS (SELECT CAST(sum(source_size) AS DOUBLE) AS words, sum(w) AS w FROM numbered),
levels AS (SELECT n.number, 2.0 * n.source_size / n.w AS reached, (1.5 * t.words - coalesce(sum(2.0 * n.source_size) OVER before, 0)) / (t.w - coalesce(sum(n.w) OVER before, 0)) AS level FROM numbered n, totals t WINDOW before AS (ORDER BY 2.0 * n.source_size / n.w, n.number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT n.*, CASE WHEN t.words = 0 THEN 0.0 ELSE least(2.0 * n.source_size, n.w * (SELECT level FROM levels WHERE level < reached ORDER BY reached, number LIMIT 1)) END AS target FROM numbered n, totals t),
block AS (SELECT CAST(floor(1.5 * words) AS BIGINT) AS all_words, (SELECT max(b) FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) AS b) WHERE b = 1 OR floor(1.5 * words) >= b * 65536) AS size FROM totals),
parts AS (SELECT number, CAST(round(target / (SELECT all_words FROM block) * 2147483648) AS BIGINT) AS part FROM goal WHERE target > 0),
cut AS (SELECT number, CAST(sum(part) OVER (ORDER BY number) AS BIGINT) - part AS lo, CAST(sum(part) OVER (ORDER BY number) AS BIGINT) AS hi FROM parts),
points AS (SELECT ((((k * 2654435769) % 4294967296) >> 1) * (SELECT max(hi) FROM cut)) >> 31 AS y FROM (SELECT unnest(range((all_words + size - 1) // size)) AS k FROM block)),
slots AS (SELECT number, count(*) * (SELECT size FROM block) AS words FROM points JOIN cut ON lo <= y AND y < hi GROUP BY number),
placed AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.number, CAST(sum(s.size) OVER (PARTITION BY g.number ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, coalesce(words, 0) - start)) + greatest(0, least(size, coalesce(words, 0) - start - source_size)) AS BIGINT) AS taken FROM placed LEFT JOIN slots USING (number)"""

ORACLE_SQL: dict[str, str] = {"op9_benchmark_decontamination": _OP9, "op12_source_mixing": _OP12}
