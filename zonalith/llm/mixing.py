"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalith.llm.common import WORD, running, written

#: Most sources whose totals meet on the driver.
MOST_SOURCES = 100_000


def targets(sizes: dict[str | None, int], most: int = 3) -> dict[str | None, tuple[int, int]]:
    """The target of each source as a fraction (dividend, divisor).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  They share the total of all sizes by weight; none gets
    more than `most` times its size, and what is above is shared again by weight among the rest.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    out: dict[str | None, tuple[int, int]] = {}
    rest, free = sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if rest * weight[s] > most * sizes[s] * total}
        if not above:
            return out | {s: (rest * weight[s], total) for s in free}
        for s in above:
            out[s] = (most * sizes[s], 1)
            rest -= most * sizes[s]
        free -= above
    return out


def quality_weight(text) -> object:
    """A quality weight in [0.05, 1]: the share of a text's characters that are no symbols, squared; 1 for no text."""
    clean = F.lit(1.0) - F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(clean * clean, F.lit(0.05)), F.lit(1.0))


def uniform(column) -> object:
    """A number in (0, 1) that depends on the value alone: 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for docs(doc_id, text, source).

    size is the number of words (null text: 0).  A source whose target is q whole sizes and a rest takes every document q
    times, then documents by ascending exponential key, -ln(u) / quality weight with u from the doc_id, as long as at least half of
    a document still fits the rest.  So the words taken differ from the target by half a document at most, and reruns
    agree.  Equal doc_ids tie in u and are told apart by size.  A source without words has the target 0 and takes none of
    its documents.  A null source is a source; an empty table gives no rows.

    The driver sees one row for each source (at most MOST_SOURCES); a source may be spread over any number of tasks.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size"), (-F.log(uniform(F.col("doc_id"))) / quality_weight(F.col("text"))).alias("key")), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets({r["source"]: r["n"] for r in sums}, most)
    rows = []
    for r in sums:
        over, under = goal[r["source"]]
        whole = over // (under * r["n"]) if r["n"] else 0
        rows.append((r["source"], r["n"], over / under, int(whole), float(over - whole * under * r["n"]) / under))
    at = spark.createDataFrame(rows, "_source string, source_size long, target double, whole long, rest double")
    ranked = running(sized, ["source"], ["key", "doc_id", "size"], "size", "mixed")
    joined = ranked.join(at, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("whole") + ((F.col("rest") > 0) & (2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
