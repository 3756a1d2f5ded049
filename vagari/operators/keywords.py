"""Keyword lists: dedup, distinct, unions, lookups. Lists come as arrays or as rows of (key, pos, phrase)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as tx


def last_word(phrase: Column) -> Column:
    return F.lower(F.try_element_at(tx.nouns(phrase), F.lit(-1)))


def longest_by_root(phrases: DataFrame, key: str) -> DataFrame:
    """Of each root (here: the last word) the longest phrase, the first of equals, in the order in which roots first appear. Phrases without words go."""
    own = phrases.withColumn("root", last_word(F.col("phrase"))).filter(F.col("root").isNotNull())
    pick = F.max_by("phrase", F.struct(F.length("phrase"), (-F.col("pos")).alias("p")))
    return own.groupBy(key, "root").agg(pick.alias("phrase"), F.min("pos").alias("first_pos"))


def as_list(rows: DataFrame, key: str, column: str, pos: str) -> DataFrame:
    """Rows back to one ordered list per key."""
    ordered = F.sort_array(F.collect_list(F.struct(pos, column)))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x[column]).alias(column))


def first_of_each(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Each value once, at its first place."""
    return rows.groupBy(key, value).agg(F.min(pos).alias(pos))


def distinct_lower(values: Column) -> Column:
    """Without order; sorted so that it is the same each time."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(v))))


def looked_up(indices: Column, values: Column) -> Column:
    """F13"""
    return F.transform(indices, lambda i: F.get(values, i))


def micro_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Number of the batch of 'size' candidates in which a row goes."""
    n = F.row_number().over(W.Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def once_each(rows: DataFrame, column: str, apply) -> DataFrame:
    """Run 'apply' (DataFrame to DataFrame, keeping the column) on distinct values only, then join back. Catalyst doesn't share UDF calls between rows."""
    return rows.join(apply(rows.select(column).distinct()), column, "left")
