"""A connector as a Spark data source of its own: JSON lines in Zstandard frames, with pushed filters and a committing writer.

``register(spark)``, then ``df.write.format("zjsonl").save(path)`` and ``spark.read.format("zjsonl").load(path)``. Every task
writes a file of its own; a table's files count only once the manifest names them, which the writer's commit does at the end. The manifest
also holds each column's least and greatest value in a file, so a pushed filter skips files before it skips rows. It is the model for
connectors to stores that Spark has no reader for: paths are opened by pyarrow's file systems, on the driver and on the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

MANIFEST = "_manifest.json"
KINDS = (BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType)
#: Rows of one Arrow batch.
ROWS = 8_192


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _manifest(path: str) -> dict:
    system, at = _where(path)
    if system.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return {"schema": None, "files": []}
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass(frozen=True)
class Condition:
    """A pushed filter on one column: of which rows it holds, and whether any row of a file can meet it."""

    column: str
    how: str
    value: object = None

    def holds(self, v) -> bool:
        if self.how == "null":
            return v is None
        if self.how == "known":
            return v is not None
        if self.how == "same" and self.value is None:
            return v is None
        if v is None:
            return False
        return {"=": lambda: v == self.value, "same": lambda: v == self.value, "<": lambda: v < self.value, "<=": lambda: v <= self.value, ">": lambda: v > self.value, ">=": lambda: v >= self.value, "in": lambda: v in self.value, "starts": lambda: v.startswith(self.value)}[self.how]()

    def possible(self, low, high, nulls: bool) -> bool:
        """From a file's bounds, null if it has no value in the column; what isn't sure is possible."""
        if self.how == "null" or (self.how == "same" and self.value is None):
            return nulls
        if low is None:
            return False
        if self.how in ("=", "same"):
            return low <= self.value <= high
        if self.how == "in":
            return any(x is not None and low <= x <= high for x in self.value)
        return {"<": lambda: low < self.value, "<=": lambda: low <= self.value, ">": lambda: high > self.value, ">=": lambda: high >= self.value, "starts": lambda: high >= self.value and low[: len(self.value)] <= self.value, "known": lambda: True}[self.how]()


_HOW = {D.EqualTo: "=", D.EqualNullSafe: "same", D.LessThan: "<", D.LessThanOrEqual: "<=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.In: "in", D.IsNull: "null", D.IsNotNull: "known", D.StringStartsWith: "starts"}


@dataclass
class Files(D.InputPartition):
    name: str


class Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.conditions = path, schema, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            how = _HOW.get(type(f))
            if how is None or len(f.attribute) != 1:
                yield f
            else:
                self.conditions.append(Condition(f.attribute[0], how, getattr(f, "value", None)))

    def partitions(self) -> list[Files]:
        return [Files(f["name"]) for f in _manifest(self.path)["files"] if all(c.possible(*f["bounds"].get(c.column, (None, None, True))) for c in self.conditions)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, at = _where(self.path)
        schema = pa.schema([(f.name, _arrow(f.dataType)) for f in self.schema])
        with system.open_input_stream(f"{at}/{partition.name}") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as text:
            rows = []
            for line in _lines(text):
                row = json.loads(line)
                if all(c.holds(row.get(c.column)) for c in self.conditions):
                    rows.append(row)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _lines(text) -> Iterator[bytes]:
    rest = b""
    while block := text.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _arrow(kind: DataType) -> pa.DataType:
    return {"boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32(), "integer": pa.int32(), "long": pa.int64(), "short": pa.int16(), "string": pa.string()}[kind.typeName()]


@dataclass
class Written(D.WriterCommitMessage):
    files: list[dict]


class Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if wrong := [f.name for f in schema if not isinstance(f.dataType, KINDS)]:
            raise ValueError(f"zjsonl can't hold the types of {', '.join(wrong)}")
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _where(self.path)
        name, rows, bounds = f"part-{uuid.uuid4().hex}.jsonl.zst", 0, {}
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{name}") as raw, zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(json.dumps(row, allow_nan=True).encode() + b"\n")
                    rows += 1
                    for c, v in row.items():
                        low, high, nulls = bounds.get(c, (None, None, False))
                        if v is None or v != v:  # null, and NaN, which has no place among the others
                            bounds[c] = (low, high, True)
                        else:
                            bounds[c] = (v if low is None else min(low, v), v if high is None else max(high, v), nulls)
        if not rows:
            system.delete_file(f"{at}/{name}")
            return Written([])
        return Written([{"name": name, "rows": rows, "bounds": bounds}])

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _where(self.path)
        before = _manifest(self.path)["files"]
        files = ([] if self.overwrite else before) + [f for m in messages if m for f in m.files]
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{MANIFEST}.new") as out:
            out.write(json.dumps({"schema": self.schema.json(), "files": files}).encode())
        system.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        for f in before if self.overwrite else []:
            system.delete_file(f"{at}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _where(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{at}/{f['name']}")


class ZstdLines(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "zjsonl"

    def schema(self) -> StructType:
        found = _manifest(self.options["path"])["schema"]
        if found is None:
            raise ValueError(f"no table at {self.options['path']}")
        return StructType.fromJson(json.loads(found))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``zjsonl`` known to a session, and let filters reach it."""
    spark.dataSource.register(ZstdLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
