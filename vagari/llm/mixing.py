"""Mixing sources to target weights by a low-discrepancy schedule. [native]

Slots get points of a golden-ratio sequence; cumulative target weights turn a
point into a source; a slot's rank in its source picks one of that source's
equal blocks of words. Blocks are cut from the source's documents in hash
order, read again from the start where a source repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import free, stored, word_count

# 2^31 and the odd integer next to 2^31 divided by the golden ratio.
RING, GOLDEN = 1 << 31, 1327217885
CELL_BITS = 14


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block_words: int = 256
    slots_chunk: int = 65536
    bucket_docs: int = 256
    span_buckets: int = 4096
    max_sources: int = 100_000


def row_hash() -> Column:
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text).cast("binary"))


def water_fill(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Targets in proportion to weights that sum to all sizes, none above most times its size."""
    caps = [most * s for s in sizes]
    left, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    for at, i in enumerate(order):
        level = left / weight
        if caps[i] / weights[i] > level:
            for j in order[at:]:
                out[j] = weights[j] * level
            break
        out[i] = float(caps[i])
        left, weight = left - caps[i], weight - weights[i]
    return out


def _sources(base: DataFrame, p: MixParams) -> list[dict]:
    found = base.groupBy("source").agg(F.sum("size").alias("total")).limit(p.max_sources + 1).collect()
    if len(found) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    rows = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    weights = [p.weights[i % len(p.weights)] for i in range(len(rows))]
    targets = water_fill([r.total for r in rows], weights, p.most)
    return [{"sid": i, "source": r.source, "total": r.total, "target": t, "words": int(t)} for i, (r, t) in enumerate(zip(rows, targets, strict=True))]


def _schedule(spark: SparkSession, sources: list[dict], p: MixParams) -> DataFrame:
    """slot, sid and rank of each slot: rank counts the source's slots before it."""
    whole = sum(s["words"] for s in sources)
    n = -(-whole // p.block_words)
    bounds, at = [], 0
    for s in sources:
        lo, at = at, at + s["words"]
        bounds.append((s["sid"], lo * RING // max(whole, 1), at * RING // max(whole, 1)))
    ranges = spark.createDataFrame([b for b in bounds if b[2] > b[1]], "sid int, lo long, hi long")
    shift = 31 - CELL_BITS
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(RING)) * GOLDEN, F.lit(RING)).alias("u")).withColumn("cell", F.shiftright("u", shift))
    dealt = slots.join(F.broadcast(cells), "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "sid", F.expr(f"slot div {p.slots_chunk}").alias("chunk"))
    counts = dealt.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(W.Window.partitionBy("sid").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = dealt.withColumn("rn", F.row_number().over(W.Window.partitionBy("sid", "chunk").orderBy("slot")))
    ranked = inside.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("rn") - 1).alias("rank"))
    ranked = stored(ranked, "mix-slots")
    had = {r.sid for r in ranked.select("sid").distinct().collect()}
    late = [(n + i, s["sid"], 0) for i, s in enumerate(s for s in sources if s["words"] and s["sid"] not in had)]
    return ranked.unionByName(spark.createDataFrame(late, "slot long, sid int, rank long"))


def _laid_out(base: DataFrame, table: DataFrame, p: MixParams) -> DataFrame:
    """Each document's first word in its source's shuffled stream, by sums of hash buckets and then within a bucket."""
    buckets = max(1, -(-base.count() // p.bucket_docs))
    rows = base.join(F.broadcast(table), base["source"].eqNullSafe(table["_source"])).drop("_source")
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets, 32))
    # Sums before a bucket in two steps, so that no task holds all buckets of a source.
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("s")).withColumn("span", F.expr(f"bucket div {p.span_buckets}"))
    earlier = lambda c, keys, order: F.coalesce(F.sum(c).over(W.Window.partitionBy(*keys).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.groupBy("sid", "span").agg(F.sum("s").alias("t")).select("sid", "span", earlier("t", ["sid"], "span").alias("base"))
    starts = sums.withColumn("inner", earlier("s", ["sid", "span"], "bucket")).join(spans, ["sid", "span"]).select("sid", "bucket", (F.col("base") + F.col("inner")).alias("start"))
    w = W.Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size")
    inside = rows.withColumn("rn", F.row_number().over(w)).withColumn("upto", F.sum("size").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return inside.join(starts, ["sid", "bucket"]).withColumn("at", F.col("start") + F.col("upto") - F.col("size")).drop("start", "upto")


def mix(docs: DataFrame, p: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(schedule, documents).

    schedule: a row for each piece of a document in a slot: slot, doc_id, copy
    (0 for the first reading of its source), start and length in words.
    documents: doc_id, size, source_size, target, taken and row (the hash of
    doc_id and text that orders a source), one row per input row.

    Null texts and texts without words have size 0 and are never taken. Null
    sources form one source, the last. Repeated rows count each on its own. No
    words at all: no slots, targets 0. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash().alias("h"))
    base = stored(base, "mix-sizes")
    sources = _sources(base, p)
    slots = _schedule(spark, sources, p)
    counts = {r.sid: r["count"] for r in slots.groupBy("sid").count().collect()}
    schema = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("k", T.LongType())])
    table = spark.createDataFrame([(s["sid"], s["source"], s["total"], s["target"], s["words"], counts.get(s["sid"], 0)) for s in sources], schema)
    rows = _laid_out(base, table, p)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(p.most - 1)))).withColumn("a", F.col("at") + F.col("copy") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words")))
    near = lambda x: F.floor(x.cast("double") * F.col("k") / F.col("words"))  # noqa: E731  right to within one block
    used = (F.col("a") < F.col("b")) & (F.col("k") > 0)
    lo, hi = F.greatest(near(F.col("a")) - 1, F.lit(0)), F.least(near(F.col("b") - 1) + 1, F.col("k") - 1)
    # A copy that takes nothing keeps one row, under keys that match no slot and that differ.
    ranks = F.when(used, F.sequence(lo, hi)).otherwise(F.array((-1 - F.col("rn")).cast("long")))
    pieces = copies.withColumn("rank", F.explode(ranks)).withColumn("_q", F.expr("words div nullif(k, 0)")).withColumn("_r", F.expr("words % nullif(k, 0)"))
    start, stop = (F.expr(f"({r}) * _q + (({r}) * _r) div nullif(k, 0)") for r in ("rank", "rank + 1"))
    pieces = pieces.withColumn("p0", F.greatest("a", start)).withColumn("p1", F.least("b", stop)).withColumn("length", F.when(F.col("rank") >= 0, F.greatest(F.col("p1") - F.col("p0"), F.lit(0))).otherwise(0))
    pieces = pieces.filter((F.col("length") > 0) | (F.col("rank") < 0)).drop("_q", "_r")
    joined = pieces.join(slots, ["sid", "rank"], "left")
    schedule = joined.filter(F.col("slot").isNotNull()).select("slot", "doc_id", "copy", (F.col("p0") - F.col("a")).alias("start"), "length")
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(0)).alias("taken")
    documents = joined.groupBy("sid", "bucket", "rn", F.col("h").alias("row"), "doc_id", "size", "source_size", "target").agg(taken).drop("sid", "bucket", "rn")
    return schedule, documents


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs as the mix reads them: each row as often as it is taken, to the nearest whole copy (halves count). The columns stay."""
    _, documents = mix(docs, p)
    row, place, copies, copy = free(docs, "_row", "_nth", "_times", "_copy")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    counts = documents.filter("taken > 0").select(F.col("row").alias(row), times.alias(copies)).filter(F.col(copies) > 0)
    # Rows equal in doc_id and text share a hash: they are told apart by their place among these.
    nth = W.Window.partitionBy(row).orderBy(F.desc(copies))
    counts = counts.withColumn(place, F.row_number().over(nth))
    rows = docs.withColumn(row, row_hash())
    rows = rows.withColumn(place, F.row_number().over(W.Window.partitionBy(row).orderBy(row)))
    return rows.join(counts, [row, place]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(row, place, copies, copy)
