"""Tables of a store by name: spark.read.format("docweave").option("root", ...).option("table", ...).

A data source in Python, for sessions that have not opened the store. Its partitions are the writes that a version names;
filters on a table's whole key choose the parts that are read (spark.sql.python.filterPushdown.enabled has to be set).
As a stream it gives what versions add; a part that was written anew comes again, so a sink takes rows by their key.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from docweave.streaming.store import TABLES

#: Keys that filters may name before all parts are read.
MOST_KEYS = 10_000
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(root: str):
    """The file system of a root and the path in it, by Hadoop's name of it."""
    from pyarrow import fs

    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), root
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def part_of(values: tuple, parts: int) -> int:
    """The part of a key of texts, as Spark's xxhash64 has it."""
    h = 42
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(v.encode(), h)
    return (h - (h >> 63 << 64)) % parts


@dataclass
class Write(InputPartition):
    part: str
    v: str

    def __init__(self, part: str, v: str):
        super().__init__((part, v))
        self.part, self.v = part, v


class Stored(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docweave"

    def schema(self) -> str:
        return TABLES[self.options["table"]][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoredReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StoredStream(self.options, schema)


class StoredReader(DataSourceReader):
    """options: root, table, and version for one before the newest."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.table, self.schema = options["root"].rstrip("/"), options["table"], schema
        self.key, self.asked = TABLES[self.table][1], {}
        self.version = options.get("version")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.key:
                self.asked[f.attribute[0]] = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
            yield f  # parts are chosen by it; Spark applies it to their rows

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The newest whole version, or this one, and what its file says."""
        from pyarrow import fs

        system, at = opened(self.root)
        found = sorted((int(f.base_name) for f in system.get_file_info(fs.FileSelector(f"{at}/versions", allow_not_found=True)) if f.base_name.isdigit()), reverse=True)
        for n in found if version is None else [version] if version in found else []:
            with system.open_input_stream(f"{at}/versions/{n:012d}") as f:
                try:
                    return n, json.loads(f.read())
                except ValueError:  # not whole yet
                    continue
        return 0, {}

    def chosen(self, state: dict) -> set[str] | None:
        if set(self.asked) != set(self.key):
            return None
        keys = list(itertools.islice(itertools.product(*(self.asked[k] for k in self.key)), MOST_KEYS + 1))
        return None if len(keys) > MOST_KEYS else {str(part_of(k, state["parts"])) for k in keys}

    def partitions(self) -> list[Write]:
        _, state = self.state(None if self.version is None else int(self.version))
        chosen = self.chosen(state) if state else None
        return [Write(p, v) for p, vs in state.get("heads", {}).get(self.table, {}).items() if chosen is None or p in chosen for v in vs] or [Write("", "")]

    def read(self, partition: Write) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.v:
            return
        system, at = opened(self.root)
        names, types = self.schema.names, to_arrow_schema(self.schema)
        data = ds.dataset(f"{at}/{self.table}/part={partition.part}/v={partition.v}", format="parquet", filesystem=system)
        for batch in data.to_batches(columns=names, batch_size=4096):
            yield batch.cast(types)


class StoredStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.inner = StoredReader(options, schema)

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": self.inner.state()[0]}

    def partitions(self, start: dict, end: dict) -> list[Write]:
        writes = lambda n: {(p, v) for p, vs in self.inner.state(n)[1].get("heads", {}).get(self.inner.table, {}).items() for v in vs} if n else set()
        new = {(p, v) for p, v in writes(end["version"]) if int(v.partition("-")[0]) > start["version"]}
        return [Write(p, v) for p, v in sorted(new)] or [Write("", "")]

    def read(self, partition: Write) -> Iterator:
        return self.inner.read(partition)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Stored)
