"""Exact top-k search with a bit-sliced index.

A component becomes the integer floor(scale * x). Rows are kept in blocks; a
block stores, for each component, one bitmap per bit of its value (shifted to be
non-negative). A query's scores for a whole block are the weighted sum of these
slices: shifted slices are added by carry-save adders on bitmaps. The highest
rows are then found from the most significant slice of the sum downward, and
among rows with the boundary score the smallest ids are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, stored
from .vectors import matrix

BLOCK_SCHEMA = "block long, n int, dims int, width int, low binary, most binary, ids binary, null_id binary, slices binary, q_at binary, q_values binary"
TASKS = 4  # times the cores, the most tasks that cells are dealt to
LIMIT, LONG, WIDE = 1 << 62, (1 << 63) - 1, 1 << 24


@dataclass(frozen=True)
class TopKParams:
    k: int = 10
    scale: int = 1024
    every: int = 100
    block_rows: int = 16384
    query_rows: int = 64
    stripe_blocks: int = 16
    stripe_groups: int = 64


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers: 64-bit ones where all fit 62 bits, else Python's."""
    values = np.floor(x * scale)
    if np.abs(values).max(initial=0) < LIMIT:
        return values.astype(np.int64)
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        v = float(v)
        out[at] = int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale)
    return out


def _bytes(v: int) -> bytes:
    return int(v).to_bytes((int(v).bit_length() + 8) // 8, "big", signed=True)


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def _order(v: int) -> bytes:
    """Bytes in the order of the integers, whatever their size."""
    size = (abs(v).bit_length() + 7) // 8
    head = (1 << 15) + size if v >= 0 else (1 << 15) - size
    return head.to_bytes(2, "big") + (v if v >= 0 else v + (1 << 8 * size)).to_bytes(size, "big")


def _packed(values: np.ndarray) -> bytes:
    """Rows of integers of 64 bits or, where those don't do, of the width that the first 4 bytes tell."""
    if values.dtype != object:
        return b"\0\0\0\x08" + values.astype("<i8").tobytes()
    width = max((int(v).bit_length() + 8) // 8 for v in values.flat) if values.size else 9
    width = max(width, 9)
    return width.to_bytes(4, "big") + b"".join(int(v).to_bytes(width, "little", signed=True) for v in values.flat)


def _unpacked(data: bytes, rows: int) -> list[list[int]]:
    width = int.from_bytes(data[:4], "big")
    if width == 8:
        return np.frombuffer(data, "<i8", -1, 4).reshape(rows, -1).tolist()
    flat = [int.from_bytes(data[i : i + width], "little", signed=True) for i in range(4, len(data), width)]
    each = len(flat) // max(rows, 1)
    return [flat[i * each : (i + 1) * each] for i in range(rows)]


def _block(number: int, keys: list, x: np.ndarray, p: TopKParams) -> dict:
    """Index of one block. Values are x - low, 'width' bits each; slices[d, b] is the bitmap of bit b of component d."""
    values = quantised(x, p.scale)
    n, dims = values.shape
    low, high = int(values.min()), int(values.max())
    width = max(1, (high - low).bit_length())
    words, kind = -(-n // 64) * 64, np.int64 if high - low < LIMIT else object
    rest = np.zeros((words, dims), kind)
    rest[:n] = values.astype(kind) - low
    slices = np.stack([np.packbits(((rest >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little") for b in range(width)], axis=1)
    ids = np.array([k if k is not None else 0 for k in keys], np.int64)
    null = np.array([k is None for k in keys])
    asks = np.flatnonzero(~null & (ids % p.every == 0))
    return {"block": number, "n": n, "dims": dims, "width": width, "low": _bytes(low), "most": _bytes(max(abs(low), abs(high))), "ids": ids.tobytes(), "null_id": np.packbits(null).tobytes(), "slices": slices.tobytes(), "q_at": asks.astype(np.int32).tobytes(), "q_values": _packed(values[asks])}


def index(vectors: DataFrame, p: TopKParams, key: str = "vec_id", column: str = "embedding", store=stored) -> DataFrame:
    """The index as a stored table, a row per block of up to p.block_rows rows of one length."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("v")).filter(F.col("v").isNotNull())
    parts = max(1, -(-rows.count() // p.block_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == size)
                x, ok, _ = matrix(batch.column(1).take(pa.array(at)))
                wide = (np.abs(x) * p.scale >= WIDE).any(axis=1)
                for kind in (False, True):  # a few rows of large numbers don't widen the others' slices
                    own = ok & (wide == kind)
                    if not own.any():
                        continue
                    name = (int(size), kind)
                    held.setdefault(name, []).append(([keys[i] for i in at[own]], x[own]))
                    if sum(len(k) for k, _ in held[name]) >= p.block_rows:
                        for row in flush(held.pop(name), number):
                            number += 1
                            yield pa.RecordBatch.from_pylist([row], schema)
        for parts in held.values():
            for row in flush(parts, number):
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema)

    def flush(parts: list, number: int) -> Iterator[dict]:
        keys, x = [k for ks, _ in parts for k in ks], np.concatenate([x for _, x in parts])
        for lo in range(0, len(keys), p.block_rows):
            yield _block(number + lo // p.block_rows, keys[lo : lo + p.block_rows], x[lo : lo + p.block_rows], p)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in BLOCK_SCHEMA.split(", "))])
    return store(rows.repartition(parts).mapInArrow(build, BLOCK_SCHEMA), "bit-slices")


def _signed_bits(v: int) -> list[tuple[int, int]]:
    """v as a sum of few signed powers of two: (bit, sign), no two bits next to each other."""
    out, bit = [], 0
    while v:
        if v & 1:
            sign = 2 - (v & 3)
            out.append((bit, sign))
            v -= sign
        v >>= 1
        bit += 1
    return out


def score_slices(slices: np.ndarray, query: list[int], low: int) -> tuple[list[np.ndarray | None], int]:
    """(slices of the sum, offset): score = sum of 2^b * slice b, plus offset. A subtraction adds the complement."""
    dims, width, _ = slices.shape
    flipped = ~slices
    heap: dict[int, list[np.ndarray]] = {}
    offset = low * sum(query)
    for d in range(dims):
        for bit, sign in _signed_bits(query[d]):
            source = slices[d] if sign > 0 else flipped[d]
            if sign < 0:
                offset -= ((1 << width) - 1) << bit
            for b in range(width):
                heap.setdefault(bit + b, []).append(source[b])
    out: list[np.ndarray | None] = []
    weight = 0
    while any(heap.values()):
        column = heap.pop(weight, [])
        carry = heap.setdefault(weight + 1, [])
        while len(column) > 2:
            # Three slices of one weight become one of it and one of the next.
            a, b, c = column.pop(), column.pop(), column.pop()
            half = a ^ b
            column.append(half ^ c)
            carry.append((a & b) | (half & c))
        if len(column) == 2:
            a, b = column
            carry.append(a & b)
            column = [a ^ b]
        out.append(column[0] if column else None)
        weight += 1
    return out, offset


def top_rows(sums: list[np.ndarray | None], eligible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely in the top k, and of the rows tied at the boundary."""
    sure, tied = np.zeros_like(eligible), eligible
    count = 0
    for s in reversed(sums):
        if s is None:
            continue
        high = tied & s
        n = int(np.bitwise_count(high).sum())
        if count + n > k:
            tied = high
        else:
            sure, tied, count = sure | high, tied & ~s, count + n
            if count == k:
                return sure, np.zeros_like(tied)
    return sure, tied


def _rows(bits: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little"))


def _asked(blocks: DataFrame, p: TopKParams) -> DataFrame:
    """q_block, q_dims, q_part, q_ids, q_at, q_values: groups of up to p.query_rows queries of a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, ids = np.frombuffer(r["q_at"], np.int32), np.frombuffer(r["ids"], np.int64)
                head, body = r["q_values"][:4], r["q_values"][4:]
                each = len(body) // len(at)
                for lo in range(0, len(at), p.query_rows):
                    own = at[lo : lo + p.query_rows]
                    yield pa.RecordBatch.from_pydict({"q_block": pa.array([r["q_block"]], pa.int64()), "q_dims": pa.array([r["q_dims"]], pa.int32()), "q_part": pa.array([lo // p.query_rows], pa.int32()), "q_ids": [ids[own].tobytes()], "q_at": [own.tobytes()], "q_values": [head + body[lo * each : (lo + len(own)) * each]]})

    ask = blocks.select(F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), "ids", "q_at", "q_values").filter(F.length("q_at") > 0)
    return ask.mapInArrow(cut, "q_block long, q_dims int, q_part int, q_ids binary, q_at binary, q_values binary")


def _stripes(heads: DataFrame, order: list[str], each: int, enough: int) -> DataFrame:
    """heads (with dims) with their stripe: 'each' heads a stripe, or fewer, so that there are 'enough' stripes if there are heads enough."""
    same = W.Window.partitionBy("dims")
    n = F.count("*").over(same)
    stripes = F.least(n, F.greatest(F.lit(enough), F.ceil(n / each)))
    return heads.withColumn("stripe", ((F.row_number().over(same.orderBy(*order)) - 1) % stripes).cast("int"))


def search(blocks: DataFrame, p: TopKParams, key: str = "vec_id", store=stored) -> DataFrame:
    """query_id, rank, key, score of each query row's p.k best rows; see top_k.

    Blocks stand in stripes, and so do groups of queries. A cell of their grid
    joins two stripes, so a block goes to as many cells as there are stripes of
    queries, not to each group of these.
    """
    spark = blocks.sparkSession
    asked = store(_asked(blocks, p), "top-k-queries")
    enough = math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1
    rows = store(_stripes(blocks.select("block", "dims"), ["block"], p.stripe_blocks, enough), "top-k-rows")
    queries = store(_stripes(asked.select("q_block", "q_part", F.col("q_dims").alias("dims")), ["q_block", "q_part"], p.stripe_groups, enough), "top-k-groups")
    cells = rows.select("dims", F.col("stripe").alias("a")).distinct().join(queries.select("dims", F.col("stripe").alias("b")).distinct(), "dims")
    cells = store(cells.withColumn("cell", F.row_number().over(W.Window.orderBy("dims", "a", "b")) - 1), "top-k-cells")
    empty = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    left = queries.join(cells.withColumnRenamed("b", "stripe"), ["dims", "stripe"]).select("cell", "dims", "q_block", "q_part").join(asked, ["q_block", "q_part"])
    left = left.select("cell", "dims", F.lit(0).alias("side"), F.col("q_block").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("width"), *empty("low", "most"), F.col("q_ids").alias("ids"), *empty("null_id", "slices"), "q_at", "q_values")
    right = rows.join(cells.withColumnRenamed("a", "stripe"), ["dims", "stripe"]).select("cell", "block").join(blocks, "block")
    right = right.select("cell", "dims", F.lit(1).alias("side"), F.col("block").alias("at"), "n", "width", "low", "most", "ids", "null_id", "slices", *empty("q_at", "q_values"))
    n = max(1, cells.count())
    many = min(n, TASKS * spark.sparkContext.defaultParallelism)
    meets = left.unionByName(right).repartitionById(many, F.expr(f"cast(cell * {many}L div {n} as int)")).sortWithinPartitions("cell", "side", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["cell"] != now:
                    now, held = r["cell"], []
                if r["side"] == 0:
                    held.append(r)
                elif held:
                    yield found(r, r["dims"], held)

    def found(r: dict, dims: int, groups: list[dict]) -> pa.RecordBatch:
        n, words = r["n"], -(-r["n"] // 64)
        slices, low, most = np.frombuffer(r["slices"], np.uint64).reshape(dims, r["width"], words), _number(r["low"]), _number(r["most"])
        ids, null = np.frombuffer(r["ids"], np.int64), np.unpackbits(np.frombuffer(r["null_id"], np.uint8), count=n).astype(bool)
        every = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
        out: list[tuple] = []
        for g in groups:
            q_ids, q_at = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["q_at"], np.int32)
            for q, value in enumerate(_unpacked(g["q_values"], len(q_at))):
                sums, offset = score_slices(slices, value, low)
                eligible = every.copy()
                if g["at"] == r["at"]:
                    eligible[q_at[q] // 64] &= ~(np.uint64(1) << np.uint64(q_at[q] % 64))
                sure, tied = top_rows(sums, eligible, p.k)
                best, edge = _rows(sure, n), _rows(tied, n)
                edge = edge[np.lexsort((ids[edge], null[edge]))][: p.k - len(best)]
                at = np.concatenate([best, edge])
                wide = len(sums) >= 62 or most * sum(map(abs, value)) >= LIMIT
                score = np.full(len(at), offset, object if wide else np.int64)
                for b, s in enumerate(sums):
                    if s is not None:
                        bits = ((s[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
                        score += bits.astype(object) * (1 << b) if wide else bits << b
                out += [(int(q_ids[q]), g["at"], int(q_at[q]), None if null[x] else int(ids[x]), max(-LONG - 1, min(LONG, int(y))), _order(int(y))) for x, y in zip(at, score, strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["query_id", "q_block", "q_at", key, "score", "exact"])

    hits = meets.mapInArrow(run, f"query_id long, q_block long, q_at long, {key} long, score long, exact binary")
    best = W.Window.partitionBy("query_id", "q_block", "q_at").orderBy(F.desc("exact"), F.asc_nulls_last(key))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k).select("query_id", "rank", key, "score")


def top_k(vectors: DataFrame, p: TopKParams = TopKParams(), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The p.k highest integer inner products of each query row with every other row; ties go to the smaller key, null keys last.

    Queries are the rows whose key is divisible by p.every. A row never finds
    itself, but may find another row that repeats it. Rows that are null, empty
    or hold null or non-finite components take no part; rows of different length
    don't meet. Fewer than p.k other rows: all of them. Components may have any
    finite value: ranks are by the exact integer, scores beyond 64 bits are shown
    as the nearest number of 64 bits. Work grows as queries times rows, which is
    the search's size; a task holds one block and p.stripe_groups groups of
    queries.
    """
    with Scratch(vectors.sparkSession) as scratch:
        return stored(search(index(vectors, p, key, column, scratch.store), p, key, scratch.store), "top-k")
