"""Best-two-fit packing of documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.llm.common import running, small_batches, text_batches, written
from zonalith.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Pieces:
    def __init__(self, path: str, end_id: int, capacity: int):
        self.path, self.end_id, self.capacity = path, end_id, capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cap = encoder(self.path), self.capacity
        for batch in text_batches(batches, 4 << 20):
            rows: list[tuple] = []
            found, ends = encode.closed(batch.column(1), self.end_id)
            ids, begin = memoryview(found.astype("<u4")).cast("B"), 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                n, at, k = end - begin, 0, 0
                while at < n:
                    to = at + ((n - at) % cap or cap)  # only the first piece can be short
                    rows.append((doc, k, at, to - at, zlib.crc32(ids[4 * (begin + at) : 4 * (begin + to)])))
                    at, k = to, k + 1
                begin = end
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _fill(gap: int, left: Counter, present: list[int]) -> list[int]:
    """Lengths taken from `left`, always the largest that fits."""
    own: list[int] = []
    i = bisect_right(present, gap)
    while i:
        length = present[i - 1]
        if left[length] <= 0:
            i -= 1
            continue
        own.append(length)
        left[length] -= 1
        gap -= length
        i = min(i, bisect_right(present, gap))
    return own


def _two(most: int, above: int, left: Counter, present: list[int]) -> tuple[int, int] | None:
    """The two unpacked lengths of largest sum within (above, most]."""
    best, found = above, None
    j = bisect_right(present, most) - 1
    for i, small in enumerate(present):
        if 2 * small > most:
            break
        while j >= i and (present[j] + small > most or left[present[j]] <= 0):
            j -= 1
        if j < i:
            break
        large = present[j]
        if left[small] <= (small == large):
            continue
        if small + large > best:
            best, found = small + large, (large, small)
            if best == most:
                break
    return found


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of bins alike), packing counts[length] documents of each length.

    A bin takes the largest unpacked document, then greedily the largest that fits.  While it has a gap, its smallest
    document goes back if two unpacked ones fill the gap so made more tightly.  The same bin is repeated as often as the
    counts allow: until a length that it uses runs short, every choice would be made alike.  So the work depends on the
    number of lengths, at most `capacity`, not on the number of documents.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    assert all(0 < n <= capacity for n in left)
    present = sorted(left)
    out: list[tuple[list[int], int]] = []
    while present:
        own = _fill(capacity, left, present)
        gap = capacity - sum(own)
        while gap and len(own) > 1:
            least = min(own)
            pair = _two(gap + least, least, left, present)
            if pair is None:
                break
            own.remove(least)
            left[least] += 1
            own += pair
            for n in pair:
                left[n] -= 1
            gap = capacity - sum(own)
        need = Counter(own)
        times = 1 + min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * (times - 1)
        out.append((sorted(own, reverse=True), times))
        present = [n for n in present if left[n] > 0]
    return out


def slots(found: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, list[tuple[int, list[int]]]]]:
    """By length: the first rank that each pattern takes, and (first sequence, offsets in it) of the pattern."""
    out: dict[int, tuple[list[int], list[tuple[int, list[int]]]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for own, times in found:
        at, offsets = 0, {}
        for n in own:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, places in offsets.items():
            firsts, bins = out.setdefault(n, ([], []))
            firsts.append(ranks[n])
            bins.append((sequence, places))
            ranks[n] += times * len(places)
        sequence += times
    return {n: (np.array(f, np.int64), b) for n, (f, b) in out.items()}


class _Place:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = self.shared.value
        for b in batches:
            sequences, offsets = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True):
                firsts, bins = at[length]
                k = int(np.searchsorted(firsts, rank, side="right")) - 1
                first, places = bins[k]
                q, j = divmod(rank - int(firsts[k]), len(places))
                sequences.append(first + q)
                offsets.append(places[j])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*b.schema.names[:5], "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequence and the place in it.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null text is the empty one and still has its end id;
    documents longer than `capacity` are cut from the end, so the first piece may be shorter; repeated doc_ids are packed
    each on their own; an empty table gives no rows.  Other columns are not looked at.

    What meets on the driver are the counts of the lengths (at most `capacity` numbers) and the patterns found from them
    (a few for each length): neither grows with the documents.  A piece's rank among those of its length gives its place.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(docs.select("doc_id", "text").mapInArrow(_Pieces(tokenizer, end_id, capacity), _PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(patterns(counts, capacity)))
    ranked = running(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "length", "ranked")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_Place(shared), _PIECES + ", sequence_id long, offset long")
