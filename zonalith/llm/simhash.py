"""SimHash fingerprints of documents, linked within a Hamming radius by BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalith.llm import hamming
from zonalith.llm.common import fresh, small_batches, text_batches, utf8, written
from zonalith.llm.components import components, local_roots

#: Queries that walk the trees together.
QUERIES = 1 << 12


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits: a bit is 1 if it is set in over half of the XXH64 of the text's shingles; 0 for a text without words.

    Only A-Z are lower-cased.  A text of fewer words than a shingle has one shingle, the whole sequence.
    """
    own = text.lower().split()
    if not own:
        return 0
    if len(own) <= words:
        return xxhash.xxh64_intdigest(b" ".join(own), seed)
    laid = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    begins = [0, *ends[: -words].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(laid[i : j - 1], seed) for i, j in zip(begins, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(begins))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


class _Prints:
    def __init__(self, words: int, seed: int):
        self.words, self.seed = words, seed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            fps = np.array([fingerprint(t, self.words, self.seed) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "mark", "fp"])


class BKTrees:
    """Burkhard-Keller trees of 64-bit values, one for each group: below a node, one child for each Hamming distance from it."""

    def __init__(self, values: np.ndarray, group: np.ndarray, n_groups: int):
        n = len(values)
        self.values = values
        self.root = np.full(n_groups, -1, np.int64)
        self.root[group[::-1]] = np.arange(n)[::-1]  # the first of each group
        self.child = np.full(n * 65, -1, np.int32)
        at, waiting = self.root[group], np.arange(n)
        at, waiting = at[at != waiting], waiting[at != waiting]
        while len(waiting):
            edge = at * 65 + np.bitwise_count(values[waiting] ^ values[at])
            self.child[edge[::-1]] = waiting[::-1]  # of those that wait for one edge, the first becomes the child
            at = self.child[edge].astype(np.int64)
            stay = at != waiting
            at, waiting = at[stay], waiting[stay]

    def within(self, asked: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, query) positions within the radius, of some queries at a time; these walk their group's tree together, along edges d - r to d + r only."""
        for at in range(0, len(asked), QUERIES):
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            query = np.arange(at, min(at + QUERIES, len(asked)))
            node = self.root[group[query]]
            query, node = query[node >= 0], node[node >= 0]
            while len(node):
                d = np.bitwise_count(asked[query] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                hits.append((node[near], query[near]))
                ahead = []
                for edge in (d + s for s in range(-radius, radius + 1)):
                    below = np.where((edge >= 0) & (edge <= 64), self.child[node * 65 + np.clip(edge, 0, 64)], -1)
                    on = below >= 0
                    ahead.append((query[on], below[on].astype(np.int64)))
                query, node = np.concatenate([x[0] for x in ahead]), np.concatenate([x[1] for x in ahead])
            yield np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])

    def within_wide(self, asked: np.ndarray, group: np.ndarray, radius: int, queries: int = QUERIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """within(), for radii of many edges: the children between edges d - r and d + r are taken as one span instead of edge by edge."""
        below = self.child[self.child >= 0].astype(np.int64)
        before = np.append(0, np.cumsum(self.child >= 0))
        for at in range(0, len(asked), queries):
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            query = np.arange(at, min(at + queries, len(asked)))
            node = self.root[group[query]]
            query, node = query[node >= 0], node[node >= 0]
            while len(node):
                d = np.bitwise_count(asked[query] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                hits.append((node[near], query[near]))
                low = before[node * 65 + np.maximum(d - radius, 0)]
                spans = before[node * 65 + np.minimum(d + radius, 64) + 1] - low
                query = np.repeat(query, spans)
                node = below[np.arange(len(query)) + np.repeat(low - np.cumsum(spans) + spans, spans)]
            yield np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def bk_search(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what near pairs connect; the hits of QUERIES queries are held at once, then only a forest of them."""
    group = np.cumsum(np.append(False, shard[1:] != shard[:-1]))
    stored, asked = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    trees = BKTrees(fp[stored], group[stored], int(group[-1]) + 1)
    root = np.arange(len(fp))
    for node, query in trees.within(fp[asked], group[asked], radius):
        a, b = root[stored[node]], root[asked[query]]
        apart = a != b
        root = local_roots(len(fp), a[apart], b[apart])[root]
    child = np.flatnonzero(root != np.arange(len(fp)))
    return root[child], child


def _grouped(docs: DataFrame, radius: int, words: int, seed: int, most: int) -> DataFrame:
    """doc_id, mark (a hash of the text), fp, root (a fingerprint that names the group), component_id for each row."""
    small_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    prints = written(marked.mapInArrow(_Prints(words, seed), "doc_id long, mark long, fp long"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = hamming.links(nodes.select("fp"), bk_search, radius, most)
    roots = written(components(found), "roots")
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(lows, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_groups(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, most: int = hamming.MOST) -> DataFrame:
    """doc_id, fp long, component_id for docs(doc_id, text): the smallest doc_id reachable by links of at most `radius` bits.

    Equal fingerprints are one node, whatever number of documents has them; null, empty and blank texts have the
    fingerprint 0 and are linked like any other.  Rows that repeat a doc_id each get a row.  A null doc_id is left out of
    the minimum (its component_id is null if it is alone).  An empty table gives no rows.  Other columns are not looked at.

    Trees are built for shards of at most `most` fingerprints (see hamming): whole trees of the corpus would grow with it,
    and neither their broadcast nor a search of each by all would be bounded.
    """
    return _grouped(docs, radius, words, seed, most).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, most: int = hamming.MOST) -> DataFrame:
    """Of each group of near_groups() one row of docs(doc_id, text, ...), with all columns: the smallest doc_id, nulls last.

    Rows that share a doc_id, or have none, but differ in text are documents of their own: within a group the one with the
    smallest hash of its text stays, and groups apart each keep one.  Of rows with equal doc_id and text, any one stays.
    """
    grouped = _grouped(docs, radius, words, seed, most)
    keys = [id_, none, mark] = [fresh(docs, c) for c in ("_id", "_none", "_mark")]
    first = grouped.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("mark").alias(mark))

    def keyed(df: DataFrame, *more) -> DataFrame:
        return df.select("*", F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none), *more)

    kept = keyed(docs, F.xxhash64("text").alias(mark)).join(keyed(first).select(*keys), keys, "left_semi")
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(id_))
    at = fresh(docs, "_row")
    return kept.withColumn(at, row).filter(F.col(at) == 1).select(*docs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    got = near_groups(docs)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
