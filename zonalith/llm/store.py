"""Content-addressed store of token ids.

A rolling hash cuts each document's ids into chunks where its content says so; equal chunks are stored once under their
digest.  A recipe names a document's chunks in order; Merkle manifests over recipes allow to verify what is read back.

Files below the store's folder, all Parquet:

chunks    digest string (hex of 16 bytes), n_ids int, ids binary (little-endian unsigned, `width` bytes each)
recipes   doc_id, start, n_tokens, doc_root, part, rank, digests array<string>, after array<long>; range-partitioned and
          sorted by doc_id, `after` holds the document's ids behind each chunk
manifest  level ('block' of 1024 documents, 'part', 'store'), part, block, root: each root is the sha256 of those below it
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalith.llm.common import new_path, running, small_batches, text_batches
from zonalith.llm.tokens import encoder

_M64 = (1 << 64) - 1
_WINDOW = 8


@dataclass(frozen=True)
class Cutter:
    """Content-defined chunk limits: a cut where the hash of the last ids has `bits` zero bits, sizes within [least, most]."""

    least: int = 64
    bits: int = 8
    most: int = 1024

    def cuts(self, ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """For documents laid end to end in ids and ending at `ends`: the ends of each one's chunks."""
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolled = mixed.copy()
        factor = 1
        for back in range(1, _WINDOW):
            factor = factor * 0x5851F42D4C957F2D & _M64
            rolled[back:] += mixed[:-back] * np.uint64(factor)
        marks = np.flatnonzero(rolled >> np.uint64(64 - self.bits) == 0) + 1
        spans = np.searchsorted(marks, ends, side="left")
        out, begin, k = [], 0, 0
        for end, upto in zip(ends.tolist(), spans.tolist(), strict=True):
            own, at = [], begin
            for m in marks[k:upto].tolist():
                while m - at > self.most:
                    at += self.most
                    own.append(at)
                if m - at >= self.least:
                    own.append(m)
                    at = m
            while end - at > self.most:
                at += self.most
                own.append(at)
            if end > at:
                own.append(end)
            out.append(own)
            begin, k = end, int(np.searchsorted(marks, end, side="right"))
        return out


def digest(ids: bytes) -> str:
    return hashlib.blake2b(ids, digest_size=16).hexdigest()


_ROUTED = "kind int, route string, doc_id long, n int, ids binary, doc_root string, digests array<string>, after array<long>"


class _Encode:
    """Rows of kind 0: a chunk, at its first place in this batch; rows of kind 1: a document's recipe."""

    def __init__(self, path: str, end_id: int, cutter: Cutter):
        self.path, self.end_id, self.cutter = path, end_id, cutter

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(self.path)
        size = encode.width.itemsize
        for batch in text_batches(batches, 4 << 20):
            docs = batch.column(0).to_pylist()
            ids, ends = encode.closed(batch.column(1), self.end_id)
            laid = ids.tobytes()
            chunks: dict[str, tuple[int, bytes]] = {}
            roots, lists, afters, counts, begin = [], [], [], [], 0
            for cuts, end in zip(self.cutter.cuts(ids, ends), ends.tolist(), strict=True):
                own, at = [], begin
                for c in cuts:
                    own.append(d := digest(piece := laid[at * size : c * size]))
                    chunks.setdefault(d, (c - at, piece))
                    at = c
                lists.append(own)
                afters.append([end - c for c in cuts])
                counts.append(end - begin)
                roots.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                begin = end
            k, n = len(chunks), len(docs)
            none = [None] * k
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * k + [1] * n, pa.int32()), pa.array([*chunks, *(f"doc{x}" for x in docs)]), pa.array(none + docs, pa.int64()),
                pa.array([x[0] for x in chunks.values()] + counts, pa.int32()), pa.array([x[1] for x in chunks.values()] + [None] * n, pa.binary()),
                pa.array(none + roots, pa.string()), pa.array(none + lists, pa.list_(pa.string())), pa.array(none + afters, pa.list_(pa.int64())),
            ], names=["kind", "route", "doc_id", "n", "ids", "doc_root", "digests", "after"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every recipe, and each chunk once; equal digests have come to one task."""
    met: set[str] = set()
    for batch in batches:
        keep = []
        for kind, route in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(kind == 1 or route not in met)
            if kind == 0:
                met.add(route)
        yield batch.filter(pa.array(keep))


@dataclass(frozen=True)
class TokenStore:
    path: str

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, cutter: Cutter | None = None) -> TokenStore:
        """Encode docs(doc_id long, text string) and store them in ascending doc_id order.

        A null text is the empty one; each document ends with end_id.  Documents with one doc_id are all kept, in any order
        among themselves; a null doc_id comes first.  An empty table gives an empty store.  Other columns are not looked at.
        """
        spark = docs.sparkSession
        small_batches(spark)
        path = path or new_path(spark, "store")
        routed = docs.select("doc_id", "text").mapInArrow(_Encode(tokenizer, end_id, cutter or Cutter()), _ROUTED)
        # Chunks meet by digest, recipes spread by document; both leave the one pass over the texts.
        routed.repartition("route").mapInArrow(_once, _ROUTED).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/routed")
        raw = spark.read.schema(_ROUTED.replace("kind int, ", "")).parquet(f"{path}/routed/kind=1") if cls._has(spark, f"{path}/routed/kind=1") else spark.createDataFrame([], _ROUTED)
        placed = running(raw.select("doc_id", F.col("n").cast("long").alias("n_tokens"), "doc_root", "digests", "after"), [], ["doc_id", "doc_root"], "n_tokens", "recipes")
        recipes = placed.withColumnRenamed("before", "start")
        recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
        store = cls(path)
        roots = spark.read.parquet(f"{path}/recipes").select("part", "rank", "doc_root")
        manifest(roots).write.parquet(f"{path}/manifest")
        return store

    @staticmethod
    def _has(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def chunks(self, spark: SparkSession) -> DataFrame:
        if not self._has(spark, f"{self.path}/routed/kind=0"):
            return spark.createDataFrame([], "digest string, n_ids int, ids binary")
        return spark.read.schema("route string, n int, ids binary").parquet(f"{self.path}/routed/kind=0").select(F.col("route").alias("digest"), F.col("n").alias("n_ids"), "ids")

    def recipes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/recipes")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/manifest")

    def places(self, spark: SparkSession) -> DataFrame:
        """A row for each chunk of each document."""
        r = self.recipes(spark).select("doc_id", "start", "n_tokens", "doc_root", F.posexplode(F.arrays_zip("digests", "after")).alias("pos", "c"))
        return r.select("doc_id", "start", "n_tokens", "doc_root", "pos", F.col("c.digests").alias("digest"), F.col("c.after").alias("after"))

    def read(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens, ids array<long>: the documents put together again."""
        got = self.places(spark).join(self.chunks(spark), "digest")
        whole = got.groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("c"))
        return whole.select("doc_id", "start", "n_tokens", F.col("c.ids").alias("c")).mapInArrow(_unpack, "doc_id long, start long, n_tokens long, ids array<long>")

    def summaries(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, n_chunks, verified, from the files alone.

        Each stored chunk is read once: its digest and crc are computed from the ids read.  A document's crc is the
        exclusive or of its chunks' crcs, each carried over the ids behind it, so documents need not be put together in
        memory.  verified: all chunks were there, and their digests give the recipe's root and length.
        """
        small_batches(spark)
        read = self.chunks(spark).mapInArrow(_sums, "digest string, n_ids int, crc long, intact boolean")
        got = self.places(spark).join(read, "digest", "left")
        carried = got.mapInArrow(_carry, "doc_id long, start long, n_tokens long, doc_root string, pos int, digest string, n_ids long, crc long, intact boolean")
        whole = carried.groupBy("start").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"),
            F.sum("n_ids").alias("_n"), F.bool_and("intact").alias("_ok"), F.first("doc_root").alias("_root"), F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("_c"),
        )
        sealed = F.sha2(F.array_join(F.col("_c.digest"), ","), 256) == F.col("_root")
        return whole.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", (F.col("_ok") & (F.col("_n") == F.col("n_tokens")) & sealed).alias("verified"))

    def verify(self, spark: SparkSession) -> bool:
        """Whether every document verifies and the manifest follows from the recipes."""
        whole = not self.summaries(spark).filter(~F.col("verified")).limit(1).count()
        return whole and not manifest(self.recipes(spark).select("part", "rank", "doc_root")).exceptAll(self.manifest(spark)).limit(1).count()


def manifest(roots: DataFrame) -> DataFrame:
    """Merkle roots over (part, rank, doc_root): of 1024 documents, of a part's blocks, of the store's parts."""

    def root(order: str, below: str):
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, below))), lambda x: x[below]), ","), 256)

    first = roots.groupBy("part").agg(F.min("rank").alias("_first"))
    blocks = roots.join(first, "part").groupBy("part", F.expr("(rank - _first) div 1024").alias("block")).agg(root("rank", "doc_root").alias("root"))
    parts = blocks.groupBy("part").agg(root("block", "root").alias("root"))
    top = parts.agg(root("part", "root").alias("root"))
    return (
        blocks.select(F.lit("block").alias("level"), "part", "block", "root")
        .unionByName(parts.select(F.lit("part").alias("level"), "part", F.lit(None).cast("long").alias("block"), "root"))
        .unionByName(top.select(F.lit("store").alias("level"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("block"), "root"))
    )


def _width(n: int, size: int) -> np.dtype:
    return np.dtype("<u4") if n and size == 4 * n else np.dtype("<u2")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n_tokens").to_pylist()
        raw = [b"".join(c) for c in b.column("c").to_pylist()]
        ids = [np.frombuffer(x, _width(k, len(x))).astype(np.int64) for k, x in zip(n, raw, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, n = b.column(0).to_pylist(), b.column(1).to_pylist()
        raw = b.column(2).to_pylist()
        crcs = [zlib.crc32(np.frombuffer(x, _width(k, len(x))).astype("<u4").tobytes()) for k, x in zip(n, raw, strict=True)]
        good = [digest(x) == d for d, x in zip(names, raw, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64()), pa.array(good)], names=["digest", "n_ids", "crc", "intact"])


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


_carriers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each k: 4 x 256 words that carry a crc over 2**k zero bytes (the crc is linear over GF(2))."""
    if not _carriers:
        bit = [0xEDB88320] + [1 << i for i in range(31)]
        for _ in range(3):
            bit = [_times(bit, r) for r in bit]
        for _ in range(44):
            rows = np.zeros((4, 256), np.uint32)
            for i in range(32):
                step = 1 << (i % 8)
                rows[i // 8, step : 2 * step] = rows[i // 8, :step] ^ np.uint32(bit[i])
            _carriers.append(rows)
            bit = [_times(bit, r) for r in bit]
    return _carriers


def carried(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc adds to the crc of a text that goes on for n_bytes."""
    out = crc.astype(np.uint32)
    for k, t in enumerate(_tables()):
        if not (n_bytes >> k).any():
            break
        on = (n_bytes >> k & 1).astype(bool)
        v = out[on]
        out[on] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return out


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "doc_root", "pos", "digest", "n_ids", "crc", "intact"]
    for b in batches:
        crc = np.array([x or 0 for x in b.column("crc").to_pylist()], np.uint32)
        after = b.column("after").to_numpy(zero_copy_only=False).astype(np.int64)
        new = {"crc": pa.array(carried(crc, after * 4).astype(np.int64)), "n_ids": b.column("n_ids").cast(pa.int64()), "intact": pa.array([bool(x) for x in b.column("intact").to_pylist()])}
        yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)
