"""Folders of JSON lines as Python data sources, planned by size, with filters taken over, and as a stream.

spark.read.format("split_manifest").load(folder) reads a split manifest;
spark.read.format("hub_dataset").option("name", ...).option("config", ...)
.load(root) reads a configuration of a dataset in a local hub, root/name/config.
A schema that the reader is given has only the columns that are wanted: others
aren't parsed into rows. The driver lists files and their sizes; it reads none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import store_of

PART_BYTES, BATCH_ROWS = 64 << 20, 8192


class Ranges(InputPartition):
    """Byte ranges of files: (path, from, to)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def listed(folder: str) -> list[tuple[str, int]]:
    """Files of a folder and their sizes, by name; names that begin with _ or . are no data."""
    from pyarrow import fs

    store, place = store_of(folder)
    found = store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    prefix = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def planned(files: list[tuple[str, int]], part_bytes: int) -> list[Ranges]:
    """Large files are cut, small ones share a partition: each has about part_bytes."""
    out, own, size = [], [], 0
    for path, length in files:
        for lo in range(0, length, part_bytes):
            hi = min(lo + part_bytes, length)
            if own and size + hi - lo > part_bytes:
                out.append(Ranges(own))
                own, size = [], 0
            own.append((path, lo, hi))
            size += hi - lo
    return [*out, Ranges(own)] if own or not out else out  # no file: one partition without rows


def lines_of(path: str, lo: int, hi: int) -> Iterator[bytes]:
    """Lines that begin in a byte range: each line of a file is in one of its ranges."""
    store, place = store_of(path)
    with store.open_input_file(place) as raw:
        at = max(lo - 1, 0)
        raw.seek(at)
        rest, first = b"", lo > 0
        while True:
            chunk = raw.read(1 << 20)
            if not chunk:
                break
            parts = (rest + chunk).split(b"\n")
            rest = parts.pop()
            for line in parts:
                start, at = at, at + len(line) + 1
                if first:  # what ends here began before
                    first = False
                    continue
                if start >= hi:
                    return
                yield line
        if rest and not first and at < hi:
            yield rest


def rows_of(ranges: list[tuple[str, int, int]], schema: StructType, wanted: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """Batches of the objects in the ranges. Lines that are no object are skipped; missing keys are null; a column whose values must be among some that are wanted leaves the others out."""
    names, arrow = schema.names, to_arrow_schema(schema)
    held: list[dict] = []
    for path, lo, hi in ranges:
        for line in lines_of(path, lo, hi):
            try:
                item = json.loads(line)
            except ValueError:
                continue
            if isinstance(item, dict) and all(item.get(c) in values for c, values in wanted.items()):
                held.append({n: item.get(n) for n in names})
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


class LinesReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, part_bytes: int):
        self.folder, self.schema, self.part_bytes = folder, schema, part_bytes
        self.wanted: dict[str, list] = {}

    def pushFilters(self, filters):
        """Takes over equality with a value and membership in a list; Spark keeps the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                old = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if old is None else [v for v in old if v in values]
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in self.wanted):
                yield f

    def partitions(self):
        return planned(listed(self.folder), self.part_bytes)

    def read(self, partition):
        yield from rows_of(partition.ranges, self.schema, self.wanted)


class LinesStream(DataSourceStreamReader):
    """Files of the folder by name, which new files must follow; an offset is the number of files read."""

    def __init__(self, folder: str, schema: StructType, part_bytes: int):
        self.folder, self.schema, self.part_bytes = folder, schema, part_bytes

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        return {"files": len(listed(self.folder))}

    def partitions(self, start, end):
        return planned(listed(self.folder)[start["files"] : end["files"]], self.part_bytes)

    def read(self, partition):
        yield from rows_of(partition.ranges, self.schema, {})


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "split_manifest"

    def schema(self) -> str:
        return "file string, split string, size bigint"

    def folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("the folder of the manifest must be given")
        return self.options["path"]

    def part_bytes(self) -> int:
        return int(self.options.get("part_bytes", PART_BYTES))

    def reader(self, schema):
        return LinesReader(self.folder(), schema, self.part_bytes())

    def streamReader(self, schema):
        return LinesStream(self.folder(), schema, self.part_bytes())


class HubSource(ManifestSource):
    @classmethod
    def name(cls) -> str:
        return "hub_dataset"

    def schema(self) -> str:
        raise ValueError("a dataset's columns must be given as a schema")

    def folder(self) -> str:
        if "name" not in self.options:
            raise ValueError("the name of the dataset must be given")
        return "/".join([super().folder().rstrip("/"), self.options["name"], self.options.get("config", "default")])


def register(spark: SparkSession) -> None:
    """Make both sources known to the session and let Spark hand them filters."""
    spark.dataSource.register(ManifestSource)
    spark.dataSource.register(HubSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
