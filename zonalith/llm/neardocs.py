"""Near copies of documents: SimHash fingerprints of word shingles, searched in BK-trees, then an exact test by Jaccard similarity.

Trees are built where documents share a pigeonhole block of their fingerprints, or a MinHash key: blocks alone reach 3 bits,
and documents of similarity 0.8 are up to 27 bits apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalith.llm import hamming, keyed, linesketch, simhash
from zonalith.llm.common import fresh, small_batches, text_batches, utf8, written

#: Keys of a document and minima in each: a pair of similarity 0.8 shares a key with probability 0.9998.
KEYS = (16, 4)
#: Queries that walk a tree together: all documents of a group of near copies are hits of each other.
QUERIES = 256


def reach(least: float) -> int:
    """Bits that the SimHashes of sets of Jaccard similarity `least` differ in at most, but for one pair in 100,000.

    Large sets differ in 64 * angle / pi bits in the mean; the small ones of 4 and 5 elements differ in a quarter more.
    """
    share = min(0.5, 1.25 * math.acos(max(0.0, 2 * least / (1 + least))) / math.pi)
    return min(64, math.ceil(64 * share + 4.6 * math.sqrt(64 * share * (1 - share))))


def prints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHashes of texts from the distinct hashes of their shingles; 0 for a text without a word."""
    return linesketch.simhashes(hashes, np.full(len(hashes), 8), np.repeat(np.arange(len(counts)), counts), len(counts))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of all texts, sorted within each, and how many each has.

    A text of fewer words has one shingle, the whole sequence, or none at all.  Only A-Z are lower-cased.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    a = 0
    while a < len(texts):  # about linesketch.CHUNK bytes at a time, or one text
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= linesketch.CHUNK):
            size += len(texts[b]) + 1
            b += 1
        laid = b"\n".join(x.lower().translate(_ONE_BLANK) for x in texts[a:b])
        end = np.cumsum(np.fromiter((len(x) + 1 for x in texts[a:b]), np.int64, b - a)) - 1
        begin = np.append(0, end[:-1] + 1)
        word, _, text = linesketch.words_of(np.frombuffer(laid, np.uint8), begin, end)
        n = np.bincount(text, minlength=b - a)
        first, runs = np.cumsum(n) - n, np.maximum(n - words + 1, np.minimum(n, 1))
        at = np.repeat(first, runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
        own = np.repeat(np.arange(b - a), runs)
        x = np.zeros(len(at), np.uint64)
        for k in range(words):
            on = at + k < (first + n)[own]
            x[on] = linesketch.mixed(x[on] + word[at[on] + k])
        order = np.lexsort((x, own))
        x, own = x[order], own[order]
        new = np.append(True, (x[1:] != x[:-1]) | (own[1:] != own[:-1]))[: len(x)]
        hashes.append(x[new])
        counts[a:b] = np.bincount(own[new], minlength=b - a)
        a = b
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


#: White space of any kind as a space, so that a text is one line.
_ONE_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class _Keys:
    """The SimHashes and the MinHash keys of the texts of a batch (text, h); those without a word share a key."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, b: pa.RecordBatch) -> Iterator[keyed.Found]:
        for part in text_batches(iter([b])):
            texts, h = utf8(part.column(0)), part.column(1).to_numpy()
            hashes, counts = shingles(texts, self.words)
            on = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[on]
            key = linesketch.minima(hashes, first, *KEYS) if len(on) else np.zeros((0, KEYS[0]), np.uint64)
            none = np.flatnonzero(counts == 0)
            yield h, keyed.log_size(counts), prints(hashes, counts), np.append(key.reshape(-1), np.ones(len(none), np.uint64)), np.append(np.repeat(on, KEYS[0]), none), np.zeros(len(h), bool)


class _Alike:
    """A spanning forest of the texts of a shard whose shingles have the Jaccard similarity `least`: tested exactly on what the shard's BK-tree has within reach()."""

    def __init__(self, least: float, words: int):
        self.least, self.words = least, words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in hamming.by_shards(batches, 1 << 12):
            h, at = np.unique(rows.column("h").to_numpy(), return_index=True)
            own = np.searchsorted(h, rows.column("h").to_numpy())
            hashes, counts = shingles(utf8(rows.column("text").take(pa.array(at)).combine_chunks()), self.words)
            ends = np.cumsum(counts)
            root, out = np.unique(rows.column("root").to_numpy()[at], return_inverse=True)[1], []
            shard, side, fp = rows.column("shard").to_numpy(), rows.column("side").to_numpy(), prints(hashes, counts)[own]
            group = np.cumsum(np.append(False, shard[1:] != shard[:-1]))
            stored, asked = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            trees = simhash.BKTrees(fp[stored], group[stored], int(group[-1]) + 1)
            for node, query in trees.within_wide(fp[asked], group[asked], reach(self.least), QUERIES):
                a, b = stored[node], asked[query]
                once = (a < b) | (side[b] == 2)  # where side is 0, both ends ask
                a, b = own[a[once]], own[b[once]]
                on = (root[a] != root[b]) & (np.minimum(counts[a], counts[b]) >= self.least * np.maximum(counts[a], counts[b]) - 1e-9)
                for i, j in zip(a[on].tolist(), b[on].tolist(), strict=True):
                    if root[i] != root[j]:
                        both = len(np.intersect1d(hashes[ends[i] - counts[i] : ends[i]], hashes[ends[j] - counts[j] : ends[j]], assume_unique=True))
                        if both >= self.least * (counts[i] + counts[j] - both) - 1e-9:
                            root[root == root[j]] = root[i]
                            out.append((h[i], h[j]))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def keep_one(docs: DataFrame, least: float = 0.8, words: int = 5, most: int = hamming.MOST) -> DataFrame:
    """Of each group of near copies one row of docs(doc_id, text, ...), with all columns: the smallest doc_id, nulls last.

    Texts are linked if the Jaccard similarity of their shingles is at least `least`, tested exactly on texts whose SimHashes
    a BK-tree finds within reach(least); texts that share a block of these or a MinHash key are in one tree.  Null, empty and blank texts are alike.  Rows that share a doc_id, or have none, but differ in text are
    documents of their own.  Of rows with equal doc_id and text, any one stays.  Texts of any length are taken whole; an
    empty table gives no rows; columns beside doc_id and text are passed on, whatever their names.
    """
    small_batches(docs.sparkSession)
    marked = docs.select("text", F.xxhash64("text").alias("h"))
    met = keyed.candidates(marked, _Keys(words), least, most, reach=reach(least))
    texts = written(marked.join(met.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"]).select("h", "text"), "texts")
    roots = keyed.groups(met, texts, _Alike(least, words), most)
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark")).distinct()
    of = rows.join(roots, rows["mark"] == roots["node"], "left").select("doc_id", "mark", F.coalesce("root", "mark").alias("root"))
    low = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")).alias("low"))
    keys = [none, id_, mark] = [fresh(docs, c) for c in ("_none", "_id", "_mark")]
    first = low.select(F.col("low.none").alias(none), F.col("low.id").alias(id_), F.col("low.mark").alias(mark))
    own = docs.select("*", F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(id_), F.xxhash64("text").alias(mark))
    at = fresh(docs, "_row")
    return own.join(first, keys, "left_semi").withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(id_))).filter(F.col(at) == 1).select(*docs.columns)
