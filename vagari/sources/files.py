"""File sources as DataFrames: listings, JSON and JSONL documents, images, tar shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

IMAGE_NAME = r"(?i)\.(jpg|png|jpeg)$"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path: path, modificationTime, length; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")


def images(files: DataFrame) -> DataFrame:
    """Images among files, with their id. Files of one stem stay apart by path (Q16)."""
    return files.filter(F.col("path").rlike(IMAGE_NAME)).withColumn("image_id", stem(F.col("path")))


def of_datasets(files: DataFrame, datasets: list[str], depth: int = 2) -> DataFrame:
    """Files of the allowed dataset folders, which are 'depth' parts into the path."""
    parts = F.split("path", "/")
    return files.withColumn("dataset", F.get(parts, F.lit(depth))).filter(F.col("dataset").isin(datasets)).withColumn("name", F.element_at(parts, -1))


def model_directories(files: DataFrame, prefix: str = "model_", depth: int = 2) -> DataFrame:
    """S12"""
    return files.select(F.get(F.split("path", "/"), F.lit(depth)).alias("model")).filter(F.col("model").startswith(prefix)).distinct()


def image_index(name: Column) -> Column:
    """The number after the last underscore."""
    return F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1).try_cast("int")


def first_extension(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """F12"""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("extension"))
    return found.filter(rank > 0).groupBy(key).agg(F.min_by("extension", rank).alias("extension"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file with image_id and path; documents that don't parse have _corrupt set, not dropped."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    own = [c for c in df.columns if c != "image_id"]
    return df.select(*own, F.col("_metadata.file_path").alias("path")).withColumn("image_id", stem(F.col("path")))


def json_lines(spark: SparkSession, path: str, schema: str = schemas.SENTENCE) -> DataFrame:
    """S08"""
    return spark.read.schema(schema).json(path)


def as_struct(schema: str) -> str:
    return f"struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array, with the ordinal of each element."""
    return array_rows(spark.read.text(path, wholetext=True), schema)


def array_rows(text: DataFrame, schema: str) -> DataFrame:
    own = [c for c in text.columns if c != "value"]
    return text.select(*own, F.posexplode(F.from_json("value", f"array<{as_struct(schema)}>")).alias("pos", "x")).select(*own, "pos", "x.*")


def keyed_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Model, sentence_idx, sentence and image_idx, image from a document that maps models to sentences."""
    return keyed_rows(spark.read.text(path, wholetext=True), schema)


def keyed_rows(text: DataFrame, schema: str) -> DataFrame:
    models = text.select(F.explode(F.from_json("value", schema)).alias("model", "sentences"))
    sentences = models.select("model", F.posexplode("sentences").alias("sentence_idx", "s"))
    return sentences.select("model", "sentence_idx", "s.sentence", F.posexplode("s.images").alias("image_idx", "image"))


def fuzzy_map(spark: SparkSession, path: str) -> DataFrame:
    """Term and level."""
    text = spark.read.text(path, wholetext=True)
    return mapping_rows(text)


def mapping_rows(text: DataFrame) -> DataFrame:
    return text.select(F.explode(F.from_json("value", as_struct(schemas.FUZZY_MAP))["mapping"]).alias("key", "level"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """S18"""
    return spark.read.schema(schemas.SPLIT_MANIFEST).option("multiLine", True).json(path)


def png_or_jpeg_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG; null for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path, image_id, width, height; unreadable images have null sizes and a failed state."""
    @F.pandas_udf("struct<width:int,height:int>")
    def size(content: pd.Series) -> pd.DataFrame:
        found = [png_or_jpeg_size(bytes(c)) or (None, None) for c in content]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(IMAGE_NAME))
    sized = files.select("path", stem(F.col("path")).alias("image_id"), size("content").alias("s"))
    return sized.select("path", "image_id", "s.width", "s.height", F.when(F.col("s.width").isNull(), "fail").otherwise("ok").alias("state"))


def newest(files: DataFrame, prefix: str) -> DataFrame:
    """The newest file whose name begins with prefix."""
    return files.filter(F.element_at(F.split("path", "/"), -1).startswith(prefix)).orderBy(F.desc("modificationTime"), "path").limit(1)


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents in a column; what doesn't parse is null in every field and has ok = false."""
    got = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("x", got).select("*", "x.*", (F.col("x").isNotNull() & F.col("x._corrupt").isNull()).alias("ok")).drop("x", "_corrupt")
