"""Generation as a stream that counts in its sink, stops at a target and goes on after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered

BATCH = "batch"


class Reached(Exception):
    """There are enough rows."""


def counted(spark: SparkSession, sink: str) -> int:
    """Rows that are in a sink; none if there is no sink yet. Counts come from the files' footers."""
    return _others(spark, sink, -1)


def _others(spark: SparkSession, sink: str, batch: int) -> int:
    """Rows of all batches but one, which may be a cut-off attempt at the batch that is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not any(s.getPath().getName().startswith(f"{BATCH}=") for s in fs.listStatus(folder)):
        return 0
    return spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH}=*").filter(F.col(BATCH) != batch).count()


def generate_until(requests: DataFrame, make: Callable[[DataFrame], DataFrame], order: list[str], sink: str, checkpoint: str, target: int) -> int:
    """Rows that make() gives for a stream of requests, until the sink holds 'target'; returns how many it holds.

    Each micro-batch writes a folder of its own, whole or not at all, and only as
    many rows as are missing by the sink's own count: the first of the batch in
    the given order, which must be total. A batch that runs again after a cut-off
    replaces its folder. The first batch that finds the target reached ends the
    stream without being taken, so a run with a higher target goes on with it. A
    restart with the same checkpoint and sink goes on with the requests that no
    batch has had. What make() raises ends the run; the next one tries the batch
    again.
    """
    spark, reached = requests.sparkSession, False

    def write(batch: DataFrame, number: int) -> None:
        nonlocal reached
        missing = target - _others(spark, sink, number)
        if missing <= 0:
            reached = True
            raise Reached
        made = make(batch).persist()
        try:
            few = made.count() <= missing
            kept = made if few else numbered(made, order, "_nth").filter(F.col("_nth") < missing).drop("_nth")
            kept.write.mode("overwrite").parquet(f"{sink}/{BATCH}={number}")
        finally:
            made.unpersist()

    query = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not reached:
            raise
    return counted(spark, sink)
