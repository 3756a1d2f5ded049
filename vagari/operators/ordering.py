"""Numbering rows in a total order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.shared import new_path


def in_ranges(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with _range and _place: ranges of the order, nulls first, and a row's place (from 0) in its own.

    Spark samples the bounds and finds a row's range by binary search; ranges
    only balance the work. There are 'ranges' of them, or as many as the session
    has shuffle partitions. The rows are written to the shared folder once, so
    that a range holds the same rows whenever it is read.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    place, path = F.monotonically_increasing_id(), new_path(spark, "ranges")
    dealt.withColumn("_range", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    return spark.read.parquet(path)


def starts_of(sizes: DataFrame, size: str) -> DataFrame:
    """_range and _start, the sum of 'size' over the ranges before it. One row a range: as few as there are tasks."""
    before = W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    return sizes.select("_range", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_start"))


def numbered(rows: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with their place (from 0) in the order of the columns, nulls first; the order must be total.

    Places within a range and the sizes of the ranges before it add up: the table
    is sorted once, and only the ranges' sizes meet in one task.
    """
    placed = in_ranges(rows, order, ranges)
    starts = starts_of(placed.groupBy("_range").agg(F.count("*").alias("_n")), "_n")
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
