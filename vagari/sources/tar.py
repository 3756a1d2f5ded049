"""Tar shards of any size: an index of their members from headers only, and members read by byte ranges.

A shard is never a value. One task walks a shard's headers, 512 bytes a member;
the members are then dealt out by ranges of bytes, so many tasks read one shard
and a task holds a few of its members at a time. Faults are rows of the index.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, store_of

BLOCK = tarfile.BLOCKSIZE
INDEX = "shard string, member string, at long, size long, fault string"
RANGE_BYTES, BATCH_BYTES, MOST_TASKS = 64 << 20, 8 << 20, 20_000


def headers(f, end: int) -> Iterator[tuple[str | None, int, int, str | None]]:
    """(member, place of its data, size, fault) of the files of an archive, in order; at a fault one row that tells it, and nothing after. f reads and seeks."""
    at, long_name, extra = 0, None, {}
    while at < end:
        f.seek(at)
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            yield None, at, 0, "header cut off"
            return
        if not block.strip(b"\0"):  # the end of the archive
            return
        try:
            info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        except tarfile.HeaderError as e:
            yield None, at, 0, f"bad header: {e}"
            return
        data = at + BLOCK
        size = int(extra.get("size", info.size)) if info.type not in (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK, tarfile.XHDTYPE, tarfile.XGLTYPE) else info.size
        whole = info.isreg() or info.type in (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK, tarfile.XHDTYPE, tarfile.XGLTYPE)
        after = data + (-(-size // BLOCK) * BLOCK if whole else 0)
        if whole and data + size > end:
            yield long_name or extra.get("path", info.name), data, size, "data cut off"
            return
        if info.type == tarfile.GNUTYPE_LONGNAME:
            long_name = f.read(size).rstrip(b"\0").decode("utf-8", "surrogateescape")
        elif info.type == tarfile.XHDTYPE:
            extra = _records(f.read(size))
        elif info.type not in (tarfile.GNUTYPE_LONGLINK, tarfile.XGLTYPE):
            if info.isreg():
                yield extra.get("path", long_name or info.name), data, size, None
            long_name, extra = None, {}
        at = after


def _records(data: bytes) -> dict[str, str]:
    """Keys and values of an extended header: lines of 'length key=value'."""
    out, at = {}, 0
    while at < len(data):
        space = data.find(b" ", at)
        if space < 0 or not data[at:space].isdigit():
            break
        n = int(data[at:space])
        key, _, value = data[space + 1 : at + n - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "surrogateescape")
        at += max(n, 1)
    return out


def index(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """shard, member, at, size and fault of all members of the shards below a path. Contents aren't read."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = store_of(shard)
                with store.open_input_file(place) as f:
                    found = []
                    for row in headers(f, length):
                        found.append((shard, *row))
                        if len(found) == 10_000:
                            yield _batch(found)
                            found = []
                    if found:
                        yield _batch(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return files.repartition("path").mapInArrow(walk, INDEX)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    shard, member, at, size, fault = zip(*found, strict=True)
    clean = [m if m is None else m.encode("utf-8", "replace").decode() for m in member]
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(clean, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(fault, pa.string())], names=["shard", "member", "at", "size", "fault"])


def members(listed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """shard, member, data of the index's members without a fault. Tasks take ranges of about range_bytes of a shard; the bytes of one are read from front to back, a batch at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, f, held, size = None, None, [], 0
            for shard, member, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != now:
                    if f:
                        f.close()
                    store, place = store_of(shard)
                    now, f = shard, store.open_input_file(place)
                f.seek(at)
                held.append((shard, member, f.read(n)))
                size += n
                if size > BATCH_BYTES:
                    yield _data(held)
                    held, size = [], 0
            if f:
                f.close()
            if held:
                yield _data(held)

    good = listed.filter("fault IS NULL")
    total = good.agg(F.sum("size")).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-total // range_bytes)))  # given as a number: by its own few bytes the index would be one task's work
    ranged = good.withColumn("range", F.expr(f"at div {range_bytes}L")).repartition(tasks, "shard", "range").sortWithinPartitions("shard", "at")
    return ranged.select("shard", "member", "at", "size").mapInArrow(read, "shard string, member string, data binary")


def _data(held: list[tuple]) -> pa.RecordBatch:
    shard, member, data = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(member, pa.string()), pa.array(data, pa.binary())], names=["shard", "member", "data"])


def samples(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(samples, faults): shard, key, captions, image and metadata of each stem, renamed from json, jpg and metadata.json; and the members that can't be read, with why.

    A part that is missing is null; of parts that a sample holds twice the
    greatest stays; other parts are left out, but make a sample. What stands
    before a fault stays. Texts that aren't UTF-8 keep their good characters. The
    index is stored in the shared folder, so headers are read once.
    """
    stored = new_path(spark, "tar-index")
    index(spark, path).write.parquet(stored)
    listed = spark.read.schema(INDEX).parquet(stored)
    name = F.element_at(F.split("member", "/"), -1)
    parts = members(listed, range_bytes).select("shard", F.substring_index(name, ".", 1).alias("key"), F.lower(F.expr("substring(element_at(split(member, '/'), -1), length(substring_index(element_at(split(member, '/'), -1), '.', 1)) + 2)")).alias("ext"), "data")
    part = lambda e, n: F.max(F.when(F.col("ext") == e, F.col("data"))).alias(n)
    wide = parts.groupBy("shard", "key").agg(part("json", "captions"), part("jpg", "image"), part("metadata.json", "metadata"))
    wide = wide.withColumn("captions", F.col("captions").cast("string")).withColumn("metadata", F.col("metadata").cast("string"))
    return wide, listed.filter("fault IS NOT NULL")


def write_shards(df: DataFrame, folder: str) -> int:
    """Samples (shard, key, parts: name of each part to its data) as tar files, one for each shard; returns their number.

    Members are written as rows come, so a task holds one batch whatever a
    shard's size. A file gets its name when it is whole, so a task that runs twice
    does no harm. Rows without a shard or a key are left out; null data is empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        now, tar, out, part, done, store, place = None, None, None, None, 0, None, None

        def close() -> None:
            tar.close()
            out.close()
            store.move(part, f"{place}/{now}.tar")

        for batch in batches:
            for shard, key, parts in zip(*(batch.column(i) for i in range(3)), strict=True):
                shard = shard.as_py()
                if shard != now:
                    if tar:
                        close()
                        done += 1
                    store, place = store_of(folder)
                    store.create_dir(place, recursive=True)
                    now, part = shard, f"{place}/_{uuid4().hex}"
                    out = store.open_output_stream(part)
                    tar = tarfile.open(fileobj=out, mode="w|")
                for ext, content in sorted(parts.as_py() or []):
                    info = tarfile.TarInfo(f"{key.as_py()}.{ext}")
                    info.size = len(content or b"")
                    tar.addfile(info, io.BytesIO(content or b""))
        if tar:
            close()
            done += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    rows = df.filter("shard IS NOT NULL AND key IS NOT NULL").select(F.col("shard").cast("string").alias("shard"), F.col("key").cast("string").alias("key"), F.col("parts").cast("map<string,binary>").alias("parts"))
    return rows.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
