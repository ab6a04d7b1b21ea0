"""Traces as a data source of Spark: `spark.read.format("tidewater_trace").load(path)` after register().

Columns: type, t and line, the event as JSON, to be taken apart with parse_json and variant_get. A file is a partition;
the options `type`, `from` and `to` (ticks, both included) are conditions that the readers hold lines against by their
first two fields. They are options as Spark 4.1 keeps one set of pushed filters for all scans of a loaded source, so
that two conditions on one frame would get in each other's way. Paths are those that pyarrow opens (files, hdfs, s3).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = pa.schema([("type", pa.string()), ("t", pa.int32()), ("line", pa.string())])
#: Lines of a batch.
BATCH = 4096
_HEAD = re.compile(r'\{"type":"([a-z_]+)"(?:,"t":(-?\d+)[,}])?')


@dataclass
class File(InputPartition):
    path: str


class TraceReader(DataSourceReader):
    def __init__(self, path: str, kind: str | None = None, since: int | None = None, until: int | None = None):
        self.path, self.kind, self.since, self.until = path, kind, since, until

    def wanted(self, kind: str | None, t: int | None) -> bool:
        if self.kind is not None and kind != self.kind:
            return False
        return (self.since is None or t is not None and t >= self.since) and (self.until is None or t is not None and t <= self.until)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(base)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        return [File(f.path) for f in files if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        out: list[tuple] = []
        with system.open_input_stream(partition.path) as stream:
            for raw in _lines(stream):
                head = _HEAD.match(raw)
                kind, t = (head[1], head[2] and int(head[2])) if head and head[2] else _fields(raw)
                if self.wanted(kind, t):
                    out.append((kind, t, raw))
                if len(out) >= BATCH:
                    yield _batch(out)
                    out = []
        yield _batch(out)


def _lines(stream) -> Iterator[str]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole if x.strip())
    if rest.strip():
        yield rest.decode()


def _fields(raw: str) -> tuple[str | None, int | None]:
    """type and t of a line in any form; lines that are no objects have neither."""
    try:
        event = json.loads(raw)
    except ValueError:
        return None, None
    return (event.get("type"), event.get("t")) if isinstance(event, dict) else (None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SCHEMA)], schema=SCHEMA)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewater_trace"

    def schema(self) -> str:
        return "type string, t int, line string"

    def reader(self, schema) -> TraceReader:
        number = lambda name: int(self.options[name]) if self.options.get(name) else None
        return TraceReader(self.options["path"], self.options.get("type") or None, number("from"), number("to"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)


def trace(spark: SparkSession, path: str, kind: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """type, t, line of a trace's events, of one kind and some ticks if so asked."""
    register(spark)
    given = {"type": kind, "from": since, "to": until}
    return spark.read.format(TraceSource.name()).options(**{k: v for k, v in given.items() if v is not None}).load(path)


def fields(line: str | Column, **paths: str) -> list[Column]:
    """Columns of a JSON text by (name=type of its field), without a schema: what is missing or of another type is null."""
    value = F.try_parse_json(F.col(line) if isinstance(line, str) else line)
    return [F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in paths.items()]
