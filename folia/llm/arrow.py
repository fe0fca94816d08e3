"""Small helpers to run batch kernels inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, name: str) -> str:
    """`name`, longer if need be, so that no column of `df` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """`kernel` over every Arrow batch of `df`; partitions stay as they are. Columns may have any names."""
    names, out = df.columns, StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(out.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (got := kernel(pa.RecordBatch.from_arrays(b.columns, names))) is not None:
                yield pa.RecordBatch.from_arrays(got.columns, plain.names)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, plain).toDF(*out.names)


def trainable(fold: tuple[int, int]):
    """Not null, and crc32(doc_id as text) doesn't leave the remainder fold[1] modulo fold[0]."""
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] != fold[1])


def labelled_ids(labels: DataFrame, label: str, skip: tuple[int, int]) -> DataFrame:
    """(doc_id, y) of all labels to learn from: those of a repeated doc_id are averaged and rounded, null ones passed over."""
    return labels.where(F.col(label).isNotNull() & trainable(skip)).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, skip: tuple[int, int], limit: int) -> DataFrame:
    """At most `limit` labelled documents to learn from: (doc_id, text, y).

    Rows whose crc32(doc_id as text) leaves the remainder skip[1] modulo skip[0] are never taken. Labels
    of a repeated doc_id are averaged and rounded, null labels are passed over, and the sample is the rows
    with the smallest hashes of doc_id, so it doesn't depend on the partitioning.
    """
    chosen = labelled_ids(labels, label, skip).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # `limit` bounds the side that is sent to all executors
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def held_out(fold: tuple[int, int]):
    """crc32(doc_id as text) leaves the remainder fold[1] modulo fold[0]; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))
