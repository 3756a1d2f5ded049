"""Streams that go on where an earlier run ended, and that tell what they have done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def run_on(spark: SparkSession, source: str, schema, out: str, checkpoint: str, change=lambda rows: rows) -> None:
    """All files of a folder that no run with this checkpoint has read yet, changed and appended to 'out'. A run that is cut off is repeated from its last whole batch."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    query = change(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


class Completed(StreamingQueryListener):
    """Collects each batch's number of rows as it is done, by run."""

    def __init__(self) -> None:
        self.rows: dict[str, list[int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.runId)] = []

    def onQueryProgress(self, event) -> None:
        self.rows.setdefault(str(event.progress.runId), []).append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))
