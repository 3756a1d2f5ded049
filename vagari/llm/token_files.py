"""Token ids in binary files: one long array of ids and an Elias-Fano index of document ends.

A shard is two files, <name>.ids (little-endian unsigned ids, 16-bit where the
vocabulary allows it) and <name>.idx (magic, id width, numbers of null, negative
and other keys, and three Elias-Fano lists: negative keys, other keys, ends).
Shards hold consecutive ranges of the key, so a document's place in the corpus
is its shard's base plus its own start. No list holds an entry of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, store_of
from .bpe import encoder
from .common import whole_texts
from .elias_fano import EliasFano
from .kernels import chunks

MAGIC = b"VGRIDS02"
LEAST = -1 << 63
SALTS = 64
READ_IDS = 1 << 20
SHARD_SCHEMA = "shard int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text") -> list:
    """Encode all texts in order of key into shards under folder; returns a row for each shard, in order.

    Null text is empty and has only the end id; a null key comes first; rows that
    repeat a key stand next to each other, in the order of their texts' hash, so
    places don't depend on the order of rows. A key that many rows repeat is cut
    into several shards like any other range. Ids and ends are written as they come,
    so a shard needs memory for its ends only. A task that runs twice writes
    files of another name; only those of the task that counted are listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, out, base = encoder(tokenizer), None, 0
        keys, ends = [], []
        for batch in batches:
            ks = batch.column(0).cast(pa.int64())
            for lo, hi, buf, offs in chunks(batch.column(1)):
                if out is None:
                    store, place = store_of(folder)
                    store.create_dir(place, recursive=True)
                    name = f"{shard:08d}-{uuid4().hex}"
                    out = store.open_output_stream(f"{place}/{name}.ids")
                ids, counts = enc.encode_chunk(buf, offs)
                upto = np.cumsum(counts)
                out.write(np.insert(ids, upto, end_id).astype(ids.dtype.newbyteorder("<")).tobytes())
                ends.append(base + upto + np.arange(1, hi - lo + 1))
                base = int(ends[-1][-1])
                keys.append(ks.slice(lo, hi - lo))
        if out is None:
            return
        out.close()
        keys = pa.chunked_array(keys)
        n = len(keys)
        known = keys.drop_null().to_numpy()  # nulls come first, then rising keys
        low = int(np.searchsorted(known, 0))
        with store.open_output_stream(f"{place}/{name}.idx") as idx:
            idx.write(MAGIC + np.array([enc.kind().itemsize, n - len(known), low, len(known) - low], "<i8").tobytes())
            for rising in (known[:low] - LEAST, known[low:], np.concatenate(ends)):
                idx.write(EliasFano.of(rising).to_bytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([base], pa.int64())})

    # Rows alike in key and text are interchangeable, so a salt may deal them to several shards.
    order = ["key", "hash", "salt"]
    rows = whole_texts(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return sorted(ordered.mapInArrow(write, SHARD_SCHEMA).collect(), key=lambda r: r.shard)


class Shard:
    """One shard's files, read by document range."""

    def __init__(self, path: str):
        self.store, self.place = store_of(path)
        with self.store.open_input_file(f"{self.place}.idx") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{path} is no index of token ids")
        self.width, self.nulls, self.below, above = np.frombuffer(data, "<i8", 4, 8).tolist()
        self.n = self.nulls + self.below + above
        lists, at = [], 40
        for _ in range(3):
            lists.append(EliasFano.from_bytes(data[at:]))
            at += len(lists[-1])
        self.negative, self.rest, self.ends = lists

    def keys(self, lo: int, hi: int) -> pd.array:
        """Keys of documents lo..hi-1."""
        span = lambda first, n: (min(max(lo - first, 0), n), min(max(hi - first, 0), n))
        a, b = span(0, self.nulls)
        known = [self.negative.select(*span(self.nulls, self.below)) + LEAST, self.rest.select(*span(self.nulls + self.below, self.rest.n))]
        out = pd.array(np.concatenate([np.zeros(b - a, np.int64), *known]), "Int64")
        out[: b - a] = pd.NA
        return out

    def offsets(self, lo: int, hi: int) -> np.ndarray:
        """Start of document lo, then the end of each of lo..hi-1."""
        got = self.ends.select(max(lo - 1, 0), hi)
        return got if lo else np.concatenate(([0], got))

    def ids(self, start: int, end: int) -> np.ndarray:
        with self.store.open_input_file(f"{self.place}.ids") as f:
            f.seek(start * self.width)
            return np.frombuffer(f.read((end - start) * self.width), f"<u{self.width}")

    def documents(self, block: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, offsets, ids) of runs of documents with READ_IDS ids or so."""
        for lo in range(0, self.n, block):
            offs = self.offsets(lo, min(lo + block, self.n))
            at = 0
            while at < len(offs) - 1:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + READ_IDS, "right")) - 1)
                yield lo + at, offs[at : to + 1], self.ids(int(offs[at]), int(offs[to]))
                at = to


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def read_digest(spark: SparkSession, shards: list, key: str = "doc_id") -> DataFrame:
    """One row per document from the files: key, start, n_tokens, ids_crc32, shard."""
    base, rows = 0, []
    for r in shards:
        rows.append((r.shard, r.path, base))
        base += r.n_ids

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, path, base in frame.itertuples(index=False):
                shard = Shard(path)
                for first, offs, ids in shard.documents():
                    to = first + len(offs) - 1
                    crcs = [ids_crc32(ids[a - offs[0] : b - offs[0]]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                    yield pd.DataFrame({key: shard.keys(first, to), "start": base + offs[:-1], "n_tokens": np.diff(offs), "ids_crc32": crcs, "shard": number})

    listed = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)))
    return listed.mapInPandas(read, f"{key} long, start long, n_tokens long, ids_crc32 long, shard int")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as files in the shared folder and read them back as read_digest does. An empty table has no shard and no row."""
    spark = docs.sparkSession
    return read_digest(spark, write_ids(docs, tokenizer, new_path(spark, "token-ids"), end_id, key, text), key)
