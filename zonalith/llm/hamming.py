"""All links between 64-bit fingerprints that differ in few bits, over shards of bounded size.

Fingerprints that differ in at most `radius` bits agree in one of radius + 1 blocks (pigeonhole), so each block value is a
shard.  A shard with more than `most` fingerprints is cut again by the blocks of its other bits; one that is still larger
is cut into parts, and each part is searched by every part.  Within a shard the links found are contracted to a spanning
forest, so no group gives all its pairs, and no link between different fingerprints is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.llm.common import written
from zonalith.llm.components import local_roots

#: Most fingerprints of a shard that is searched as a whole.
MOST = 2048


def pairs(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, end: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all near pairs of rows sorted by shard: each row against the next, the next but one, ..., of its shard, or up to `end`."""
    n = len(fp)
    if end is None:
        last = np.flatnonzero(np.append(shard[1:] != shard[:-1], True))
        end = last[np.searchsorted(last, np.arange(n))]
    at, step = np.arange(n), 1
    while len(at := at[at + step <= end[at]]):
        to = at + step
        near = (np.bitwise_count(fp[at] ^ fp[to]) <= radius) & ((side[at] == 0) | (side[at] != side[to]))
        if near.any():
            yield at[near], to[near]
        step += 1


def waves(found: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What pairs() yields for `rows` rows, in few and large portions: as many as rows, or a wave of doubled length."""
    a, b, n, steps, most = [], [], 0, 0, 1
    for x, y in found:
        a.append(x)
        b.append(y)
        n, steps = n + len(x), steps + 1
        if n >= rows or steps >= most:
            yield np.concatenate(a), np.concatenate(b)
            a, b, n, steps, most = [], [], 0, 0, 2 * most
    if a:
        yield np.concatenate(a), np.concatenate(b)


def near(shard: np.ndarray, fp: np.ndarray, block: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all near pairs within shards of rows that agree in the block of that number; sorted by shard, prints are distinct there.

    Shards of more than `most` are cut again by blocks of the other bits.
    """
    size = np.diff(np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)]), len(shard)))
    large = np.repeat(size, size) > most
    at = np.flatnonzero(~large)
    found = [(at[:0], at[:0])] + [(at[a], at[b]) for a, b in pairs(shard[at], np.zeros(len(at), np.int8), fp[at], radius)]
    for k, (low, n) in enumerate(blocks(64, radius + 1)):
        rows = np.flatnonzero(large & (block == k))
        other = fp[rows] & np.uint64((1 << low) - 1) | (fp[rows] >> np.uint64(low + n) << np.uint64(low) if low + n < 64 else np.uint64(0))
        for inner, m in blocks(64 - n, radius + 1) if len(rows) else ():
            value = other >> np.uint64(inner) & np.uint64((1 << m) - 1)
            order = np.lexsort((value, shard[rows]))
            at, value = rows[order], value[order]
            key = np.cumsum(np.append(True, (value[1:] != value[:-1]) | (shard[at][1:] != shard[at][:-1])))
            found += [(at[a], at[b]) for a, b in pairs(key, np.zeros(len(at), np.int8), fp[at], radius)]
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def by_shards(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Whole shards of batches sorted by shard, about `rows` rows or one shard at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            shard = b.column("shard").to_numpy()
            before = held[-1].column("shard")[-1].as_py()
            cut = int(np.argmax(shard != before)) if (shard != before).any() else b.num_rows
            if cut:
                held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [b.slice(cut)], b.num_rows - cut
        else:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blocks(width: int, n: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of n blocks of `width` bits."""
    edges = [i * width // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _values(column: str, blocks: list[tuple[int, int]]):
    return F.array(*[F.shiftrightunsigned(F.col(column), at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in blocks])


def _others(column: str, at: int, n: int):
    """The bits of a fingerprint without the block (at, n), drawn together."""
    low = F.col(column).bitwiseAND(F.lit((1 << at) - 1))
    high = F.shiftleft(F.shiftrightunsigned(F.col(column), at + n), at) if at + n < 64 else F.lit(0).cast("long")
    return low.bitwiseOR(high)


def sharded(prints: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """prints(fp, ...) copied to shards: shard long (shards may meet under one hash: no harm), block, side (0: stored and searched; 1, 2: stored or searched only)."""
    own = blocks(64, radius + 1)
    rest = prints.columns
    first = prints.select("*", F.posexplode(_values("fp", own)).alias("i", "v"))
    sizes = first.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    large = written(sizes.select("i", "v", F.lit(True).alias("large")), "shards")
    dealt = first.join(large, ["i", "v"], "left").withColumn("block", F.col("i"))
    cold = dealt.filter(F.col("large").isNull()).select(*rest, "block", F.xxhash64("i", "v").alias("shard"), F.lit(0).alias("side"))
    other = F.lit(None).cast("long")
    for i, (at, n) in enumerate(own):
        other = F.when(F.col("i") == i, _others("fp", at, n)).otherwise(other)
    left = 64 - max(n for _, n in own)
    again = dealt.filter(F.col("large").isNotNull()).withColumn("_other", other)
    again = again.select(*rest, "block", "i", "v", F.posexplode(_values("_other", blocks(left, radius + 1))).alias("j", "w"))
    key = F.xxhash64("i", "v", "j", "w")
    again = again.select(*rest, "block", key.alias("shard"))
    sizes = again.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    cuts = written(sizes.select("shard", F.ceil(F.col("n") / most).cast("int").alias("cuts")), "shards")
    dealt = again.join(cuts, "shard", "left").withColumn("cut", F.pmod(F.xxhash64("fp"), F.coalesce("cuts", F.lit(1))).cast("int"))
    whole = dealt.filter(F.col("cuts").isNull()).select(*rest, "block", "shard", F.lit(0).alias("side"))
    # Part x meets part y >= x: x is stored, y searches it.
    met = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least("cut", k).alias("x"), F.greatest("cut", k).alias("y")))
    parts = dealt.filter(F.col("cuts").isNotNull()).select(*rest, "block", "shard", "cut", F.explode(met).alias("m"))
    side = F.when(F.col("m.x") == F.col("m.y"), 0).when(F.col("cut") == F.col("m.x"), 1).otherwise(2)
    parts = parts.select(*rest, "block", F.xxhash64("shard", "m.x", "m.y").alias("shard"), side.alias("side"))
    return cold.unionByName(whole).unionByName(parts)


#: (shard, side, fp, radius) of rows sorted by shard to the positions of near rows.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


class _Forest:
    """A spanning forest of what `search` finds in whole shards."""

    def __init__(self, search: Search, radius: int):
        self.search, self.radius = search, radius

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shards(batches):
            fp = rows.column("fp").to_numpy()
            a, b = self.search(rows.column("shard").to_numpy(), rows.column("side").to_numpy(), fp.view(np.uint64), self.radius)
            root = local_roots(len(fp), a, b)
            child = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[root[child]]), pa.array(fp[child])], names=["a", "b"])


def links(prints: DataFrame, search: Search, radius: int, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct prints(fp long) that connect whatever links of at most `radius` bits connect."""
    dealt = sharded(prints, radius, most).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_Forest(search, radius), "a long, b long")
