"""A corpus from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vagari.llm.common import stored
from vagari.llm.langid import LangParams, accepted, identify, learn
from vagari.llm.line_dedup import LineParams, dedup_lines
from vagari.llm.minhash_dedup import MinHashParams, near_duplicates
from vagari.llm.mixing import MixParams, mixed_documents
from vagari.llm.packing import PackParams, pack
from vagari.llm.queries import MIX_MOST, MIX_WEIGHTS, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Null texts and texts without letters go, and texts with letters enough that resemble no language or whose words are dressed in signs."""
    p = LangParams()
    return identify(docs.select(*COLUMNS), learn(docs, p), p, counts=True).filter(accepted()).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are alike to an earlier line of the corpus; n_chars follows. A document that loses lines and has no word left goes: it was a copy of what stands before it."""
    out = dedup_lines(docs.select(*COLUMNS), LineParams()).filter("n_left IS NULL OR n_left > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, Jaccard similarity of at least 0.8), that with the least doc_id.

    Rows that repeat a doc_id are one document, of which the row with the least
    text stays (then language, source and length; null before all). Rows without
    doc_id stay.
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, MinHashParams(words=5, num=80, den=100)).filter("NOT kept").select("doc_id").distinct()
    rows = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return rows
    least = F.min(F.struct(*COLUMNS[1:])).alias("least")
    once = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "least.*").select(*COLUMNS)
    return rows.join(again, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, each as often as the schedule reads it; empty texts aren't read."""
    return mixed_documents(docs.select(*COLUMNS), MixParams(weights=MIX_WEIGHTS, most=MIX_MOST)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return pack(docs, PackParams(tokenizer_file(), with_ids=True))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

# Hyperdimensional profiles, similarity joins and BPE are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
