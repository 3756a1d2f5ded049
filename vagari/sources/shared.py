"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all run on one machine, a folder of our own."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    already = sc._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vagari-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vagari-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store_of(uri: str):
    """File system and path (for pyarrow) of a folder that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")
