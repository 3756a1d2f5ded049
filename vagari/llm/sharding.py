"""Sharding by extendible hashing. [native]

A directory is indexed by prefix bits of a row's hash. Only buckets over the
byte limit split on another bit, until each fits. All steps are aggregations
and equi-joins: no bucket is ever gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY_BITS, ROW_BITS = 32, 28
BITS = KEY_BITS + ROW_BITS


def _prefix(depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col("_key"), (F.lit(BITS) - depth).cast("int"))


def _keyed(df: DataFrame, key: str, text: str, overhead: int) -> DataFrame:
    """_key: 32 bits of md5(key), which place ordinary rows, then 28 bits that tell rows of one key apart."""
    first = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rest = F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    return df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long").alias("n_bytes"),
        (F.shiftleft(first, ROW_BITS) + rest).alias("_key"),
    )


def _split(rows: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """Cells of 'depth' bits with the least depth in top..depth whose bucket fits (null: none does)."""
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    spread = cells.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(depth)))).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("d")).cast("int")))
    buckets = spread.groupBy("d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | ((F.col("d") == BITS)))
    found = spread.join(fits, ["d", "p"], "left").groupBy("cell").agg(
        F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("d", "p", "shard_bytes", "shard_rows"))).alias("s")
    )
    return found.select("cell", F.col("s.d").alias("depth"), F.col("s.p").alias("prefix"), "s.shard_bytes", "s.shard_rows")


def shard(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", overhead: int = 16, slack_bits: int = 3, step: int = 8) -> DataFrame:
    """One row per input row: key, n_bytes, depth, shard_id, shard_bytes, shard_rows.

    A row counts its text's UTF-8 bytes plus 'overhead', so that empty and null
    texts also fill shards. shard_id is the bucket's prefix as a string of bits
    after "s". Rows that repeat a key share its shard until that shard is too
    large; then they split on bits that differ from row to row. A single row
    over the limit has a shard of its own. An empty table gives an empty result.
    """
    rows = stored(_keyed(df, key, text, overhead), "shard-keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(KEY_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + slack_bits)
    top, pending, done = 0, rows, []
    while True:
        found = stored(_split(pending, top, depth, limit), "shard-directory")
        placed = pending.withColumn("cell", _prefix(depth)).join(found, "cell").drop("cell")
        done.append(placed.filter(F.col("depth").isNotNull()))
        if found.filter(F.col("depth").isNull()).isEmpty():
            break
        pending = placed.filter(F.col("depth").isNull()).select(*rows.columns)
        top, depth = depth + 1, min(BITS, depth + step)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select(F.col("key").alias(key), "n_bytes", F.col("depth").cast("int").alias("depth"), F.concat(F.lit("s"), bits).alias("shard_id"), "shard_bytes", "shard_rows")
