"""Documents to packed sequences: quality rules, line dedup, near-duplicate documents, source mix, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and works on all that the stage before
kept.  All but the last return these columns again; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalith.llm import linededup, mixing, neardocs, packing, quality
from zonalith.llm.common import fresh, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat one of a smaller (doc_id, line); a later exact copy is left with an empty text."""
    return linededup.without_copies(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHashes of 5-word shingles in BK-trees, then Jaccard similarity 0.8) the document with the smallest doc_id; of equal rows, one."""
    return neardocs.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows that repeat a doc_id are taken alike."""
    doc, times, copy = (fresh(docs, c) for c in ("_doc", "_copies", "_copy"))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(doc)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(doc)))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(copy)).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The token ids and the SimHash links are not SQL's to express; tests/llm/test_pipeline.py holds stages and run() against plain versions.
ORACLE_SQL: str | None = None
