"""Running status counts over the events as a stream. An extension: the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Files of events that appear in a folder, as a stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def with_status(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("success")
    return rows.withColumn("status", kind)


def windowed_counts(rows: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """A13 by event time: rows later than 'late' behind the newest one don't count any more."""
    return with_status(rows).withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))


def only_new(rows: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """R03 on a stream: each key once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Status counts after the stream has read all files that are there."""
    counts = with_status(events(spark, folder)).groupBy("status").agg(F.count("*").alias("n"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("status_counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return {r.status: r.n for r in spark.table("status_counts").collect()}
