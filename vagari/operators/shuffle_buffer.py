"""A seeded shuffle buffer over shards, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as sc


def buffered(rows: DataFrame, shard: str, order: list[str], seed: str, places: int = 1000, name: str = "place") -> DataFrame:
    """rows with the place (from 0) at which each leaves its shard's buffer.

    Rows come in the order of their shard. The first ones fill the buffer; each
    later one takes the place of a row drawn by a hash of seed and key, which
    leaves; at the end the buffer empties in the order of these draws. So each
    row leaves once, none earlier than its own place less the buffer's size, and
    every run gives the same. order must be total within a shard and names the
    key that is hashed; null shards are one. Rows of a shard pass through one
    task, which holds the buffer and one Arrow batch.
    """
    kept = rows.columns
    draw = sc.hash_draw(F.lit(seed), F.concat_ws(":", *(F.col(c).cast("string") for c in order)))
    source = rows.withColumn("_draw", draw.cast("long")).repartition(shard).sortWithinPartitions(shard, *order)
    at, drawn = kept.index(shard), len(kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows in the buffer, by place
        now, come, left = None, 0, 0

        def out(table: pa.Table, leave: list[int], first: int) -> Iterator[pa.RecordBatch]:
            if leave:
                part = table.take(pa.array(leave, pa.int64())).select(range(drawn))
                yield from part.append_column(name, pa.array(np.arange(first, first + len(leave)))).combine_chunks().to_batches()

        def drain() -> Iterator[pa.RecordBatch]:
            if held is not None and held.num_rows:
                draws = held.column(drawn).to_numpy()
                keys = [held.column(kept.index(c)).to_pylist() for c in order]
                yield from out(held, sorted(range(held.num_rows), key=lambda i: (draws[i], [(k[i] is not None, k[i]) for k in keys])), left)

        for batch in batches:
            marks = batch.column(at)
            cuts = [0, *(i for i in range(1, batch.num_rows) if marks[i] != marks[i - 1] and not (marks[i].as_py() is None and marks[i - 1].as_py() is None)), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                own = marks[lo].as_py()
                if held is None or own != now:
                    yield from drain()
                    held, now, come, left = None, own, 0, 0
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                table = part if held is None else pa.concat_tables([held, part])
                base = table.num_rows - part.num_rows
                slots, leave = list(range(base)), []
                for i, x in enumerate(part.column(drawn).to_numpy().tolist()):
                    if come < places:
                        slots.append(base + i)
                    else:
                        slot = x % places
                        leave.append(slots[slot])
                        slots[slot] = base + i
                    come += 1
                yield from out(table, leave, left)
                left += len(leave)
                held = table.take(pa.array(slots, pa.int64())).combine_chunks()
        yield from drain()

    return source.mapInArrow(run, schema)
