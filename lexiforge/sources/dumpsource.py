"""SQL dumps as a data source: ``spark.read.format("sql_dump")``.

Plain dumps are read in ranges of bytes, each by a task of its own; a statement
belongs to the range that its line begins in.  Gzipped ones are a task for each
file.  Named columns take their fields by place, so a schema with few of them
builds few fields, and comparisons with constants are settled while reading.

    use_dumps(spark)
    spark.read.format("sql_dump").option("columns", "id,namespace,title").schema("id long, title string").load(path)
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lexiforge.sources.office import tuples

#: Columns that every dump has: the file, the byte its statement begins at, the tuple's place in it, and all fields.
BASE = {"file": "string", "statement": "long", "pos": "int", "fields": "array<string>"}
ROWS = 2000


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int | None  # None: the whole of a compressed file


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def statements(file: str, start: int, stop: int | None) -> Iterator[tuple[int, str]]:
    """(first byte, line) of the lines that begin in the range."""
    store, path = _open(file)
    if stop is None:
        with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as lines:
            at = 0
            for line in lines:
                yield at, line.decode("utf-8", "replace")
                at += len(line)
        return
    with store.open_input_file(path) as raw:
        # a line that begins at the start ends the one before it there
        at = max(0, start - 1)
        raw.seek(at)
        lines = io.BufferedReader(raw, 1 << 20)
        if start:
            at += len(lines.readline())
        while at < stop and (line := lines.readline()):
            yield at, line.decode("utf-8", "replace")
            at += len(line)


class DumpSource(DataSource):
    """Options: ``path``; ``columns``, names of the fields in their order, apart by commas; ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "sql_dump"

    def schema(self) -> str:
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ", ".join(f"`{c}` {t}" for c, t in (BASE | dict.fromkeys(names, "string")).items())

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(schema, self.options)


class DumpReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        names = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
        self.places = {c: i for i, c in enumerate(names)}
        unknown = [f.name for f in schema.fields if f.name not in BASE and f.name not in self.places]
        if unknown:
            raise ValueError(f"columns {unknown} have no place in a tuple: name all fields in the option columns")
        self.wanted: list[tuple[int, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of named text columns with constants is settled here; Spark keeps the rest."""
        texts = {f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType)}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.places and name in texts and isinstance(f, (EqualTo, In)):
                self.wanted.append((self.places[name], set(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[ByteRange]:
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        prefix = self.path[: self.path.index(path)] if path in self.path else ""
        out = []
        for x in sorted(found, key=lambda x: x.path):
            name = prefix + x.path
            out += [ByteRange(name, 0, None)] if x.path.endswith(".gz") else [ByteRange(name, a, min(a + self.split, x.size)) for a in range(0, x.size, self.split)]
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.schema), []
        for at, line in statements(part.file, part.start, part.stop):
            for pos, fields in enumerate(tuples(line)):
                if all(len(fields) > i and fields[i] in values for i, values in self.wanted):
                    rows.append(self._row(part.file, at, pos, fields))
                if len(rows) == ROWS:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    def _row(self, file: str, at: int, pos: int, fields: list[str]) -> list:
        base = {"file": file, "statement": at, "pos": pos, "fields": fields}
        return [base[f.name] if f.name in base else _typed(fields[self.places[f.name]] if self.places[f.name] < len(fields) else None, f.dataType) for f in self.schema.fields]


def _typed(value: str | None, kind: T.DataType):
    """A field as its column's type; what is NULL, missing or no such value is null."""
    if value is None or isinstance(kind, T.StringType):
        return value
    try:
        return int(value) if isinstance(kind, T.IntegralType) else float(value) if isinstance(kind, T.FractionalType) else json.loads(value)
    except ValueError:
        return None


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def use_dumps(spark: SparkSession) -> None:
    """Make the source known to a session, which must let Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DumpSource)
