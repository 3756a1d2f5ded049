"""Sinks: JSON, JSONL, TSV and versioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import store_of


def one_line(column: str) -> Column:
    """Tabs and line ends become spaces; null is empty."""
    return F.coalesce(F.trim(F.translate(F.col(column), "\t\n", "  ")), F.lit("")).alias(column)


def tsv(df: DataFrame, path: str) -> None:
    """K05"""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def append_lines(df: DataFrame, path: str) -> None:
    """K06"""
    df.write.mode("append").json(path)


def documents(df: DataFrame, path: str, key: str) -> None:
    """One JSON document a row, in a folder for each key prefix."""
    df.withColumn("part", F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 2)).write.mode("overwrite").partitionBy("part").json(path)


def new_version(df: DataFrame, path: str) -> str:
    """Results are added as a new version, never changed in place; returns its folder."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    have = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    n = max([int(h[2:]) for h in have if h.startswith("v=")], default=0) + 1
    df.write.parquet(f"{path}/v={n}")
    return f"{path}/v={n}"


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; older ones are pruned by their folder."""
    found = spark.read.option("mergeSchema", True).parquet(path)
    newest = found.agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{path}/v={newest}")


def config_lines(runs: DataFrame, settings: str) -> DataFrame:
    """A JSON line (value) for each entry of the map 'settings', beside the other columns; a run without settings has no line."""
    others = [c for c in runs.columns if c != settings]
    return runs.select(*others, F.explode(settings).alias("_k", "_v")).select(*others, F.to_json(F.create_map("_k", F.col("_v").cast("string"))).alias("value"))


def named_files(df: DataFrame, folder: str) -> int:
    """Each row (name, content) as a file of its own; returns their number. A file appears whole or not at all, so a task that runs twice does no harm. Rows without a name are left out."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        store, place = store_of(folder)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                target = f"{place}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{place}/_{uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, target)
            yield pd.DataFrame({"n": [len(frame)]})

    rows = df.filter("name IS NOT NULL").select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0

