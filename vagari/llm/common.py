"""What several operators share: the shared folder, stored tables, word counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

# White space that separates words is U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES, SPARK_BATCH_BYTES = "4m", f"{64 << 20}b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (with _ for .) within the block; the session's own come back after it."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives the loss of executors.

    Shuffle files of what led here go when it has been written. Arrow batches are
    small meanwhile.
    """
    path, spark = path or new_path(df.sparkSession, name), df.sparkSession
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxBytesPerBatch=BATCH_BYTES):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_texts(df: DataFrame) -> DataFrame:
    """df; from now on the session's Arrow batches end at BATCH_BYTES, unless it has set a number of its own.

    A batch is held by the executor and by its Python worker; Spark's 64 MB would
    be there twice in every task. Frames are computed after they are returned, so
    this stays set.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == SPARK_BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ before it as it takes to differ from df's columns."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Remove all that this application has stored; call it when its results have been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "x").rsplit("/", 1)[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Stored tables and broadcasts of one operator, removed on leaving the with block. What the operator returns is stored outside of it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def __enter__(self) -> "Scratch":
        return self

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        return stored(df, name, path)

    def share(self, value):
        """A broadcast that ends with the block. For values whose size is fixed."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def __exit__(self, *_) -> None:
        for b in self.shared:
            b.destroy()
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has 0. Each word with its white space becomes one character."""
    marks = F.regexp_replace(text, rf"{SPACE}*+{WORD}+{SPACE}*+", "x")
    return F.when(text.rlike(WORD), F.length(marks)).otherwise(0).cast("long")
