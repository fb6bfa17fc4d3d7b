"""The registered queries of this subpackage: each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import (
    alignment,
    decontaminate,
    language,
    licences,
    near_dedup,
    packing,
    prefix_trie,
    private_data,
    quality,
    repeats,
    token_counts,
    topk,
    vector_dedup,
)
from eventlens.llm.storage import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096
    )
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars"
    )


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), percent=85)


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = quality.trained(docs, table(spark, folder, "labels"))
    return quality.scored(docs, net).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predicted(docs, language.trained(docs)).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


@query
def op2_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private_data.private_spans(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s.no)
    counts = (
        (F.size("base") - F.size(F.array_remove(kinds, no))).cast("long").alias(f"n_{kind}")
        for no, kind in enumerate(private_data.KINDS)
    )
    return found.select(
        "doc_id", *counts, F.sha2(private_data.listed("base").cast("binary"), 256).alias("base_sha256"),
        private_data.listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"),
    )


@query
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), every=20, k=20)


ORACLE["op3_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), t AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


@query
def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents"))


@query
def op11_vector_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"), cosine=0.98)


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


# CRC-32 of the decimal id, a bit at a time; a node is known by a digest of its turns' digests.
ORACLE["op12_prefix_trie"] = """
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))
    )) % 9 AS h
    FROM (SELECT DISTINCT c FROM t)
), turns AS (
    SELECT v.c, 0 AS part, pos, r, x FROM convs v JOIN t ON t.c = v.base AND pos <= h
    UNION ALL SELECT t.c, 1, pos, r, x FROM t JOIN convs v ON v.c = t.c WHERE pos > h
), prefixes AS (
    SELECT c, row_number() OVER w AS d, octet_length(encode(x)) AS bytes, md5(string_agg(md5(length(r) || ':' || r || x), '') OVER w) AS k
    FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, pos)
), places AS (
    SELECT c, d, bytes, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), 'root') AS p FROM prefixes
    UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs
), nodes AS (
    SELECT k, any_value(p) AS p, any_value(d) AS d, min(c) AS m, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saved FROM places GROUP BY k
), children AS (
    SELECT p AS k, count(*) AS n_children FROM nodes WHERE p IS NOT NULL GROUP BY p
), subtrees AS (
    SELECT a.k, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
    FROM nodes y LEFT JOIN children ON children.k = y.k JOIN places a ON a.c = y.m AND a.d <= y.d GROUP BY a.k
), ends AS (
    SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM places
    WHERE (c, d) IN (SELECT (c, max(d)) FROM places GROUP BY c) GROUP BY k
)
SELECT y.m AS conv_id, CAST(y.d AS BIGINT) AS depth, above.m AS parent_conv_id, y.n AS n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes y LEFT JOIN nodes above ON above.k = y.p LEFT JOIN children ON children.k = y.k
JOIN subtrees ON subtrees.k = y.k LEFT JOIN ends ON ends.k = y.k
"""


# All pairs of a label; fine for the samples, quadratic beyond.
ORACLE["op11_vector_duplicates"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
), least AS (
    SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
    SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, coalesce(m, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
