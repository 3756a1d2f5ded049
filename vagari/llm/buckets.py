"""Counts of hashes over all rows in a table of fixed size, small enough for the driver and every worker.

A hash counts in the bucket of its upper bits. One byte per bucket holds the
count: itself up to 64, then steps of an eighth of a doubling. A bucket's count
is never below that of a hash in it, so a count of 1 proves a hash unique; order
by count is the same for every row. Flags are a larger table with one bit per
bucket, for a count of at least 1 or 2: a bit of 0 proves a hash absent, or unique.
Flags of rows whose number is known grow with it, up to 2^MOST_BITS bits (128 MB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE_BITS, FLAG_BITS, MOST_BITS, PART_BITS = 22, 25, 30, 18
EXACT, STEPS = 64, 8
PARTS_SCHEMA = "part int, at binary, n binary"


def bucket(hashes: np.ndarray, bits: int = CODE_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def code_of(counts: np.ndarray) -> np.ndarray:
    big = EXACT + np.floor(STEPS * np.log2(np.maximum(counts, EXACT) / EXACT))
    return np.where(counts <= EXACT, counts, np.minimum(big, 255)).astype(np.uint8)


def mean_count(codes: np.ndarray) -> float:
    """About the mean count of a bucket."""
    wide = codes.astype(np.float64)
    return float(np.where(codes <= EXACT, wide, EXACT * 2.0 ** ((wide - EXACT) / STEPS)).mean())


class Flags:
    """Which of 2^bits buckets have a count of at least 'least', packed."""

    def __init__(self, packed: np.ndarray, bits: int = FLAG_BITS):
        self.packed, self.bits = packed, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = bucket(hashes, self.bits)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _parts(bits: int, first: int, used: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part of 2^PART_BITS buckets with counts, numbered from 'first' on."""
    cuts = np.searchsorted(used, np.arange((1 << bits - PART_BITS) + 1) << PART_BITS)
    for part in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[part], cuts[part + 1])
        at, n = (used[own] & ((1 << PART_BITS) - 1)).astype(np.uint32), counts[own].astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"part": pa.array([first + part], pa.int32()), "at": [at.tobytes()], "n": [n.tobytes()]})


class Counter:
    """Counts of one task; parts() gives them for the sum over tasks."""

    def __init__(self, bits: int = CODE_BITS) -> None:
        self.bits, self.table = bits, np.zeros(1 << bits, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.table, bucket(hashes, self.bits), np.uint32(1))

    def parts(self, first: int = 0) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(self.table)
        yield from _parts(self.bits, first, used, self.table[used])


class Seen:
    """Whether buckets of one task occurred once and again, two bits a bucket; parts() gives 1 or 2 for the sum over tasks."""

    def __init__(self, bits: int = FLAG_BITS) -> None:
        self.bits = bits
        self.once, self.again = (np.zeros(1 << bits - 3, np.uint8) for _ in range(2))

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(bucket(hashes, self.bits), return_counts=True)
        i, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
        more = (n > 1) | (self.once[i] & bit > 0)
        np.bitwise_or.at(self.again, i[more], bit[more])
        np.bitwise_or.at(self.once, i, bit)

    def parts(self, first: int = 0) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.once)
        row, bit = np.nonzero(np.unpackbits(self.once[some]).reshape(-1, 8))
        used = some[row] * 8 + bit
        yield from _parts(self.bits, first, used, 1 + (self.again[used >> 3] >> (7 - bit).astype(np.uint8) & 1))


def _summed(parts: DataFrame, many: int, flags_from: int, least: int) -> list:
    """part and data of all 'many' parts: codes, or from part 'flags_from' on packed bits for the buckets that have 'least'."""
    tasks = min(many, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            data = np.packbits(total >= least) if now >= flags_from else code_of(total)
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "data": [data.tobytes()]})

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now:
                    if now is not None:
                        yield done()
                    now, total = r["part"], np.zeros(1 << PART_BITS, np.int64)
                total[np.frombuffer(r["at"], np.uint32)] += np.frombuffer(r["n"], np.uint32)
        if now is not None:
            yield done()

    dealt = parts.repartitionById(tasks, F.expr(f"cast(part * {tasks}L div {many} as int)")).sortWithinPartitions("part")
    return dealt.mapInArrow(add, "part int, data binary").collect()


def _filled(rows: list, first: int, bits: int, flags: bool) -> np.ndarray:
    """The table whose parts are numbered from 'first' on."""
    size = (1 << PART_BITS) // (8 if flags else 1)
    out = np.zeros(size << bits - PART_BITS, np.uint8)
    for r in rows:
        at = (r.part - first) * size
        if 0 <= at < len(out):
            out[at : at + size] = np.frombuffer(bytes(r.data), np.uint8)
    return out


def table(parts: DataFrame, bits: int = CODE_BITS, least: int = 0) -> np.ndarray:
    """The codes of a table, from Counter.parts of all tasks; with 'least', packed bits for the buckets that have as many."""
    return _filled(_summed(parts, 1 << bits - PART_BITS, 0 if least else 1 << 31, least), 0, bits, least > 0)


Hashes = Callable[[pa.RecordBatch], np.ndarray]


def counted(df: DataFrame, hashes: Hashes, bits: int = CODE_BITS, least: int = 0) -> np.ndarray:
    """The table of the hashes that 'hashes' finds in each batch of df."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or (Seen(bits) if least else Counter(bits))
            own.add(hashes(batch))
        if own:
            yield from own.parts()

    return table(df.mapInArrow(count, PARTS_SCHEMA), bits, least)


def rarity_and_repeats(df: DataFrame, hashes: Hashes) -> tuple[np.ndarray, Flags]:
    """In one pass over df: the codes of the hashes' counts, and flags of hashes that may occur twice; the others occur once at most."""
    codes = 1 << CODE_BITS - PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, again = None, None
        for batch in batches:
            own, again = own or Counter(), again or Seen()
            found = hashes(batch)
            own.add(found)
            again.add(found)
        if own:
            yield from own.parts()
            yield from again.parts(codes)

    rows = _summed(df.mapInArrow(count, PARTS_SCHEMA), codes + (1 << FLAG_BITS - PART_BITS), codes, 2)
    return _filled(rows, 0, CODE_BITS, False), Flags(_filled(rows, codes, FLAG_BITS, True))


def flags(df: DataFrame, column: str) -> Flags:
    """Flags of the hashes in a long column of df, a stored table: 32 bits a row, between 2^FLAG_BITS and 2^MOST_BITS."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    bits = min(MOST_BITS, max(FLAG_BITS, (32 * df.count()).bit_length()))
    return Flags(counted(df.select(column), hashes, bits, 1), bits)
