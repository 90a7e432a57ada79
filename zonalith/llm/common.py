"""Shared pieces: the shared work folder, written tables, and running totals over any number of tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalith.plans.store import shared_dir

#: A word is a run without space and the characters 9 to 13; bytes.split() cuts UTF-8 at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: texts of 100,000 characters then still fit a worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files; the session's own setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors; its shuffles are deleted."""
    path = new_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it as long as df has such a column."""
    met = {c.lower() for c in df.columns}
    while name.lower() in met:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for operators on whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes."""
    for b in batches:
        rows = max(1, int(b.num_rows * most / max(1, b.nbytes))) if b.nbytes > most else b.num_rows
        for i in range(0, b.num_rows, max(1, rows)):
            yield b.slice(i, rows)


class _Running:
    """Adds the rank and the total of `value` before each row, within its task and group."""

    def __init__(self, by: Sequence[str], value: str):
        self.by, self.value = list(by), value

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, total = None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in self.by), strict=True)) if self.by else [()] * n
            values = b.column(self.value).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks, before = np.empty(n, np.int64), np.empty(n, np.int64)
            starts = [0] + [i for i in range(1, n) if keys[i] != keys[i - 1]] + [n]
            for i, j in zip(starts, starts[1:], strict=False):
                if keys[i] != last:
                    last, rank, total = keys[i], 0, 0
                sums = np.cumsum(values[i:j])
                ranks[i:j] = rank + np.arange(j - i)
                before[i:j] = total + sums - values[i:j]
                rank, total = rank + j - i, total + int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranks), pa.array(before)], names=[*b.schema.names, "_rank", "_before"])


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """df with `rank` (rows before) and `before` (total of the long column `value` before) within each group `by`, in `order`.

    The rows are range-partitioned by group and order, so that one group may span any number of tasks; each task adds up
    its own rows, and the totals of (task, group), a table of tasks plus groups, give what stands before each task.
    Nulls sort first and make a group of their own.  Rows that tie in all of `order` get distinct ranks.
    df is evaluated twice (Spark samples the ranges): pass a written table if that is dear.
    """
    spark = df.sparkSession
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*nullable(dealt.schema), T.StructField("_rank", T.LongType()), T.StructField("_before", T.LongType())])
    own = written(dealt.mapInArrow(_Running(by, value), schema), name)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        own.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
        .select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    )
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & own[c].eqNullSafe(F.col(f"_by_{c}"))
    assert spark is own.sparkSession
    return own.join(at, on).select(*df.columns, F.col("_part").alias("part"), (F.col("_rank") + F.col("_n0")).alias("rank"), (F.col("_before") + F.col("_s0")).alias("before"))
