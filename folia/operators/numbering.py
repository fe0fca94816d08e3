"""Numbers of rows in a global order, however many rows a group has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.sources.written import written


def number(rows: DataFrame, group: str, order: list[str | Column], out: str, kind: str = "int") -> DataFrame:
    """`rows` with `out`: the row's number, from 0, in its group's order, as a `kind` of integer.

    Rows are dealt into ranges of (group, order), counted by range, and numbered inside each range from the
    count of those before, so no group has to fit one task. Only the counts, one row for each range and group,
    meet in a window.
    """
    dealt = written(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return dealt.withColumn("_i", inside).join(offsets, [group, "_range"]).withColumn(out, (F.col("_before") + F.col("_i") - 1).cast(kind)).drop("_range", "_i", "_before")
