"""One query for each operator on training data, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonalith.llm import html, linededup, lm, mixing, packing, pii, quality, simhash, topk
from zonalith.llm.common import table
from zonalith.llm.store import TokenStore


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the store: see TokenStore."""
    store = TokenStore.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return store.summaries(spark)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines kept and numbers of removed lines of every document: see linededup.line_dedup()."""
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: see html.extract()."""
    return html.extract(table(spark, sf_dir, "pages"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document: see pii.find()."""
    return pii.find(table(spark, sf_dir, "documents"))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens: see packing.pack()."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and the verdict for every document: see quality.judge()."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document: see simhash.near_groups()."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source, target and words taken of every document: see mixing.mix()."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best scores of every vector whose id is divisible by 50: see topk.top_k()."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every document: see lm.score()."""
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_line_dedup, op3_main_text, op4_personal_data, op5_best_two_fit, op6_quality_rules, op7_simhash_bk, op8_source_mix, op9_exact_top_k, op10_hmm_score)
}

#: For queries that DuckDB's SQL can express on the same tables.
ORACLE_SQL: dict[str, str] = {
    "op8_source_mix": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                greatest(power(1 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / greatest(length(coalesce(text, '')), 1)::DOUBLE, 2), 0.05) AS q,
                (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM d GROUP BY source
        ), l AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
                row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source) AS k
            FROM s
        ), f AS (
            SELECT rest, ws, k FROM l WHERE rest * w <= 3 * source_size * ws ORDER BY k LIMIT 1
        ), t AS (
            SELECT source, source_size, CASE WHEN l.k >= f.k THEN (f.rest * w)::DOUBLE / f.ws ELSE 3.0::DOUBLE * source_size END AS target FROM l LEFT JOIN f ON true
        ), e AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
        ), r AS (
            SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
        )
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
    """,
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
}
