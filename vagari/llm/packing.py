"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document's ids are cut into whole sequences and a rest. The rests of a group
are packed first-fit decreasing; a tree over the bins holds the most free room
below each node and leads to the first bin that has enough. Then the emptiest
bins are cut up to fill the gaps of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import whole_texts
from .kernels import chunks
from .token_files import ids_crc32


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    length: int = 2048
    end_id: int = 1
    group_docs: int = 1024
    least_cut: int = 16
    with_ids: bool = False


class Bins:
    """Bins of one capacity under a tournament tree of free room; they open from left to right."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for size; takes that room."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        at = node - self.leaves
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (their indices) of each bin."""
    tree, bins = Bins(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.put(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, start, length). While the gaps of at least 'least' in the other bins can take the emptiest bin, it is cut into them. The emptiest bin that remains is cut into bins that hold a power of two, which need no padding."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (used[i], i))
    room = {i: capacity - used[i] for i in order if least <= capacity - used[i] < capacity}
    total, gone = sum(room.values()), set()
    targets = order[::-1]
    t = 0
    for i in order:
        own = room.get(i, 0)
        if not room or used[i] == capacity or total - own < used[i]:
            break
        total -= room.pop(i, 0)
        gone.add(i)
        for item, start, length in bins[i]:
            while length:
                while targets[t] not in room:
                    t += 1
                to = targets[t]
                n = min(length, room[to])
                bins[to].append((item, start, n))
                start, length, total = start + n, length - n, total - n
                room[to] -= n
                if not room[to]:
                    del room[to]
    left = [b for i, b in enumerate(bins) if i not in gone]
    if left:
        at = min(range(len(left)), key=lambda i: (sum(p[2] for p in left[i]), i))
        rest = sum(p[2] for p in left[at])
        if capacity - rest >= least:
            pieces = left.pop(at)
            for bit in range(rest.bit_length() - 1, -1, -1):
                need, own = rest & (1 << bit), []
                while need:
                    item, start, length = pieces.pop()
                    n = min(length, need)
                    own.append((item, start, n))
                    need -= n
                    if length > n:
                        pieces.append((item, start + n, length - n))
                if own:
                    left.append(own)
    return left


class _Group:
    """Documents of one group as they come; flush() gives the pieces of their rests."""

    def __init__(self, number: int, p: PackParams):
        self.base, self.p, self.sequences = number << 32, p, 0
        self.rests: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        n, length = len(ids), self.p.length
        whole = n // length * length
        for start in range(0, whole, length):
            yield key, start, ids[start : start + length], n, self.base + self.sequences, 0
            self.sequences += 1
        if n > whole:
            self.rests.append((key, whole, ids[whole:].copy(), n))

    def flush(self) -> Iterator[tuple]:
        sizes = [len(r[2]) for r in self.rests]
        bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, self.p.length)] if sizes else []
        for b in fill_gaps(bins, self.p.length, self.p.least_cut):
            offset = 0
            for item, start, length in b:
                key, at, ids, n = self.rests[item]
                yield key, at + start, ids[start : start + length], n, self.base + self.sequences, offset
                offset += length
            self.sequences += 1


def pack(docs: DataFrame, p: PackParams, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with p.with_ids also ids, its 32-bit ids as bytes.

    Every document has p.end_id as its last id, so null and empty texts have one
    id. Rows are dealt to groups at random, by a hash of key and text, and stand
    there in a fixed order, so the result doesn't depend on the order of rows and
    a task that runs again gives the same. Where more than p.group_docs rows have
    the same key and text, these rows, and only these, are dealt by their place,
    so that they spread. A sequence holds at most p.length ids without
    gaps; at most p.least_cut - 1 places of a group's sequences stay empty, and
    none where a sequence's size is a power of two. Whole texts are encoded once,
    in the task that packs them. An empty table has no pieces.
    """
    groups = max(1, -(-docs.count() // p.group_docs))
    rows = whole_texts(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("hash"))
    often = rows.groupBy("hash").count().filter(F.col("count") > p.group_docs).select("hash", F.lit(True).alias("often"))
    salt = F.lit(0).cast("long")
    if not often.isEmpty():
        rows, salt = rows.join(often, "hash", "left"), F.when(F.col("often"), F.monotonically_increasing_id()).otherwise(0)
    dealt = rows.select(F.pmod(F.xxhash64("hash", salt), F.lit(groups)).cast("long").alias("g"), "key", "text", "hash")
    tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionById(tasks, F.expr(f"cast(g * {tasks} div {groups} as int)")).sortWithinPartitions("g", "key", "hash").select("g", "key", "text")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        keys, starts, ids, n, seq, offset = zip(*rows, strict=True)
        data = {key: pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "length": pa.array(map(len, ids), pa.int64()), "ids_crc32": pa.array(map(ids_crc32, ids), pa.int64()), "doc_tokens": pa.array(n, pa.int64()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())}
        if p.with_ids:
            data["ids"] = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
        return pa.RecordBatch.from_pydict(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, group, now, rows = encoder(p.tokenizer), None, None, []
        for batch in batches:
            gs, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo, hi, buf, offs in chunks(batch.column(2)):
                ids, counts = enc.encode_chunk(buf, offs)
                ends = np.cumsum(counts)
                for i in range(hi - lo):
                    if gs[lo + i] != now:
                        if group:
                            rows += group.flush()
                        now = gs[lo + i]
                        group = _Group(int(now), p)
                    own = np.append(ids[ends[i] - counts[i] : ends[i]], enc.kind(p.end_id))
                    rows += group.add(keys[lo + i], own)
                if rows:
                    yield out(rows)
                    rows = []
        if group and (rows := list(group.flush())):
            yield out(rows)

    more = ", ids binary" if p.with_ids else ""
    return dealt.mapInArrow(run, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{more}")
