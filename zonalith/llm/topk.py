"""Exact top-k by inner product with the three-phase uniform threshold (TPUT).

A score is the sum of partial scores over `lists` segments of the components.  Phase 1: each shard takes the k highest
partial scores of each list, resolves these few rows, and their k-th highest score is a safe cutoff for each query.
Phase 2: a row that reaches the cutoff has a partial score of at least cutoff / lists in some list; only such entries are
collected.  Phase 3: their remaining partial scores are added, and those that reach the cutoff are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalith.llm.common import small_batches, written

#: Rows of a shard, and queries worked on at a time: 8192 x 64 and 256 x 8192 numbers fit any worker.
SHARD_ROWS, QUERY_ROWS = 8192, 256


class _Scaled:
    """vec_id and floor(scale * x) of each vector that has only finite components."""

    def __init__(self, scale: int):
        self.scale = scale

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is not None and v is not None and None not in v:
                    x = np.floor(self.scale * np.array(v, np.float64))
                    if np.isfinite(x).all():
                        ids.append(i)
                        vectors.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "v"])


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        own = np.frombuffer(x, np.float64)
        out[i, : len(own)] = own
    return out


class _Phase:
    """For each whole shard (its rows come first, then the queries): the rows of each query that stay in the race."""

    def __init__(self, k: int, lists: int, dim: int, exact: bool, first: bool):
        self.k, self.lists, self.dim, self.exact, self.first = k, lists, dim, exact, first

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, raw, asked = None, [], [], []
        data: np.ndarray | None = None
        for b in batches:
            for s, query, i, v, cutoff in zip(*(b.column(c).to_pylist() for c in ("shard", "query", "vec_id", "v", "cutoff")), strict=True):
                if s != shard:
                    yield from self.found(ids, raw, data, asked)
                    shard, ids, raw, asked, data = s, [], [], [], None
                if not query:
                    ids.append(i)
                    raw.append(v)
                    continue
                asked.append((i, v, cutoff))
                if len(asked) == QUERY_ROWS:
                    data = self.numbers(raw) if data is None else data
                    yield from self.found(ids, raw, data, asked)
                    asked = []
        yield from self.found(ids, raw, data, asked)

    def numbers(self, raw: list[bytes]) -> np.ndarray:
        m = _matrix(raw, self.dim)
        if self.exact:
            return m  # whole numbers whose sums of products stay under 2**53
        out = np.empty(m.shape, object)
        out.flat = [int(x) for x in m.flat]
        return out

    def found(self, ids: list[int], raw: list[bytes], data: np.ndarray | None, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not asked or not ids:
            return
        data = self.numbers(raw) if data is None else data
        queries = self.numbers([a[1] for a in asked])
        names = np.array(ids)
        cuts = np.linspace(0, self.dim, self.lists + 1).astype(int)
        partial = [queries[:, i:j] @ data[:, i:j].T for i, j in zip(cuts, cuts[1:], strict=False)]
        out: list[tuple[int, int, int]] = []
        for q, (i, _, cutoff) in enumerate(asked):
            own = [p[q] for p in partial]
            if self.first:
                top = min(len(ids) - 1, self.k)  # one more: a query may be among its own entries
                entries = np.unique(np.concatenate([np.argpartition(-p.astype(np.float64), top)[: top + 1] for p in own]))
            elif cutoff is None:
                entries = np.arange(len(ids))
            else:
                entries = np.flatnonzero(np.any([p * self.lists >= cutoff for p in own], axis=0))
            entries = entries[names[entries] != i]
            score = sum(p[entries] for p in own)
            if not self.first and cutoff is not None:
                entries, score = entries[score >= cutoff], score[score >= cutoff]
            ranked = sorted(zip((-score).tolist(), names[entries].tolist(), strict=True))[: self.k]
            out += [(i, n, int(-s)) for s, n in ranked]
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, lists: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each vec_id divisible by `every`.

    vectors(vec_id, embedding): each component x counts as floor(scale * x).  Vectors that are null or hold null, NaN or
    an infinity, and rows with a null vec_id, take no part.  Shorter vectors count as padded with 0.  Ties go to the
    smaller vec_id.  Rows that repeat a vec_id each are candidates, never of a query with that vec_id; a repeated query
    is asked once.  A query with fewer than k candidates gets them all.  An empty table gives no rows.

    Queries are dealt to shards of about SHARD_ROWS rows and met in blocks; a shard sends k rows for each query at most.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    kind = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"))
    rows = written(kind.select("vec_id", "embedding").mapInArrow(_Scaled(scale), "vec_id long, v binary"), "vectors")
    size = kind.select(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (a, x) -> if(x is null or isnan(x) or abs(x) = double('infinity'), a, greatest(a, abs(x))))")).alias("most")).first()
    dim, most = max(1, size["dim"] or 1), scale * (size["most"] or 0.0) + 1
    exact = most * most * dim * lists < 2**53
    n_shards = max(1, -(-size["n"] // SHARD_ROWS))
    data = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).alias("shard"), F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("long").alias("cutoff"))
    asked = written(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        to_all = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("query"), "vec_id", "v", "cutoff")
        dealt = data.unionByName(to_all).repartition("shard").sortWithinPartitions("shard", "query")
        return dealt.mapInArrow(_Phase(k, lists, dim, exact, first), "query_id long, vec_id long, score long")

    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = meet(asked.withColumn("cutoff", F.lit(None).cast("long")), True)
    cutoffs = written(best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff")), "cutoffs")
    final = meet(asked.join(cutoffs, asked["vec_id"] == cutoffs["query_id"], "left").select("vec_id", "v", "cutoff"), False)
    return final.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
