"""Streams that count in their sink, stop and go on."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vagari.streaming.generate import counted, generate_until


def test_generation_counts_in_its_sink(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for n in range(6):
        spark.range(10 * n, 10 * n + 10, numPartitions=1).write.mode("append").parquet(source)
    requests = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def make(rows):
        seen.append(1)
        if len(seen) == 2:
            raise ValueError("cut off")
        return rows.crossJoin(spark.range(2).withColumnRenamed("id", "k"))  # two rows a request

    with pytest.raises(StreamingQueryException):
        generate_until(requests(), make, ["id", "k"], sink, progress, 50)
    assert counted(spark, sink) == 20
    assert generate_until(requests(), make, ["id", "k"], sink, progress, 50) == 50
    assert generate_until(requests(), make, ["id", "k"], sink, progress, 50) == 50 and len(seen) == 4
    rows = spark.read.parquet(sink)
    assert rows.select("id", "k").distinct().count() == 50
    cut = rows.filter("batch = 2").agg(F.count("*"), F.max("id") - F.min("id")).first()
    assert tuple(cut) == (10, 4)  # the first rows of the batch that overshoots
    assert generate_until(requests(), make, ["id", "k"], sink, progress, 80) == 80
    assert generate_until(requests(), make, ["id", "k"], sink, progress, 1000) == 100  # all requests are used up
    assert counted(spark, str(tmp_path / "none")) == 0
