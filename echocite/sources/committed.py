"""A sink for results that must be whole: CSV or JSON lines, visible only once every task has written its part.

`df.write.format("committed").option("path", …).option("kind", "csv")` writes each task's rows to a file of its own in a
folder of the run. The commit then writes the run's manifest, which names the files and the schema, under a temporary name
and renames it; an abort deletes the run's folder. Readers (`spark.read.format("committed")`) go by manifests alone, so a
run that fails, at whatever point, is as if it had never been: files of task attempts that were lost, or that a task still
wrote while its run was given up, may stay in the folder but are not seen.
With mode `overwrite` the new manifest also ends all earlier runs, with `append` they stay. A CSV file has its header
whether or not there are rows. Texts are quoted and missing values are empty, so the two are told apart.
"""

from __future__ import annotations

import csv
import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from echocite.sources.harvest_source import open_fs

MANIFESTS = "_runs"
KINDS = ("csv", "json")


@dataclass
class Part(WriterCommitMessage):
    """A task's file, or none where it had no rows."""

    file: str | None
    rows: int


def _plain(value):
    """A value as JSON holds it."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


def _typed(value, kind: T.DataType):
    """A value of JSON or CSV as Spark takes it for a type."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _typed(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else value == "true"
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(kind, T.FractionalType):
        return Decimal(value) if isinstance(kind, T.DecimalType) else float(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat(value)
    return date.fromisoformat(value) if isinstance(kind, T.DateType) else value


def _cell(value):
    if isinstance(value, bool):
        return "true" if value else "false"
    return _plain(value)


def csv_lines(names: list[str], rows: Iterator, header: bool = True) -> Iterator[str]:
    """Lines of CSV; texts are quoted where they need it or are empty."""
    text = io.StringIO()
    plain, quoted = csv.writer(text, lineterminator="\n"), csv.writer(text, quoting=csv.QUOTE_STRINGS, lineterminator="\n")
    if header:
        plain.writerow(names)
    for row in rows:
        cells = [_cell(v) for v in row]
        if cells == [None]:
            raise ValueError("a CSV file of one column cannot hold a missing value")
        (quoted if "" in cells else plain).writerow(cells)
        yield text.getvalue()
        text.seek(0)
        text.truncate()
    yield text.getvalue()


class CommittedWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.kind, self.schema, self.overwrite = options["path"], options.get("kind", "csv"), schema, overwrite
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}, not {self.kind!r}")
        nested = [f.name for f in schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        if self.kind == "csv" and nested:
            raise ValueError(f"CSV cannot hold the nested columns {nested}")
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _files(self) -> tuple[fs.FileSystem, str]:
        files, root = open_fs(self.path)
        return files, root.rstrip("/")

    def _lines(self, rows: Iterator[Row]) -> Iterator[str]:
        if self.kind == "csv":
            return csv_lines(self.schema.names, rows)
        return (json.dumps(_plain(r), ensure_ascii=False) + "\n" for r in rows)

    def _put(self, name: str, lines: Iterator[str]) -> None:
        files, root = self._files()
        files.create_dir(f"{root}/run={self.run}", recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            for line in lines:
                out.write(line.encode())

    def write(self, iterator: Iterator[Row]) -> Part:
        held = iter(iterator)
        first = next(held, None)
        if first is None:
            return Part(None, 0)
        count = 1

        def rows() -> Iterator[Row]:
            nonlocal count
            yield first
            for row in held:
                count += 1
                yield row

        name = f"run={self.run}/part-{uuid.uuid4().hex}.{self.kind}"
        self._put(name, self._lines(rows()))
        return Part(name, count)

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None and m.file]
        names = [p.file for p in parts]
        if not names and self.kind == "csv":
            names = [f"run={self.run}/part-header.csv"]
            self._put(names[0], self._lines(iter(())))
        files, root = self._files()
        manifest = {
            "run": self.run,
            "kind": self.kind,
            "overwrite": self.overwrite,
            "rows": sum(p.rows for p in parts),
            "files": names,
            "schema": json.loads(self.schema.json()),
        }
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        final = f"{root}/{MANIFESTS}/{self.run}.json"
        with files.open_output_stream(f"{final}.tmp") as out:
            out.write(json.dumps(manifest, ensure_ascii=False, indent=1).encode())
        files.move(f"{final}.tmp", final)

    def abort(self, messages: list) -> None:
        files, root = self._files()
        folder = f"{root}/run={self.run}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


def committed_runs(path: str) -> list[dict]:
    """The manifests of all runs that count, in the order of their start."""
    files, root = open_fs(path)
    folder = fs.FileSelector(f"{root.rstrip('/')}/{MANIFESTS}", allow_not_found=True)
    names = sorted(i.path for i in files.get_file_info(folder) if i.path.endswith(".json"))
    runs = []
    for name in names:
        with files.open_input_stream(name) as held:
            manifest = json.loads(held.read())
        runs = [manifest] if manifest["overwrite"] else [*runs, manifest]
    return runs


class File(InputPartition):
    def __init__(self, name: str, kind: str):
        super().__init__((name, kind))
        self.name, self.kind = name, kind


class CommittedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema

    def partitions(self) -> list[File]:
        found = [File(name, m["kind"]) for m in committed_runs(self.path) for name in m["files"]]
        return found or [File("", "none")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.name:
            return
        files, root = open_fs(self.path)
        with files.open_input_stream(f"{root.rstrip('/')}/{partition.name}") as held:
            text = io.TextIOWrapper(held, "utf-8", newline="")
            if partition.kind == "json":
                for line in text:
                    own = json.loads(line)
                    yield tuple(_typed(own.get(f.name), f.dataType) for f in self.schema)
                return
            rows = csv.reader(text, quoting=csv.QUOTE_NOTNULL)
            names = next(rows)
            at = {name: k for k, name in enumerate(names)}
            for row in rows:
                yield tuple(_typed(row[at[f.name]] if f.name in at else None, f.dataType) for f in self.schema)


class CommittedSource(DataSource):
    """Options: `path` and, to write, `kind`: csv or json."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> T.StructType:
        runs = committed_runs(self.options["path"])
        if not runs:
            raise ValueError(f"no committed run below {self.options['path']}")
        return T.StructType.fromJson(runs[-1]["schema"])

    def reader(self, schema: T.StructType) -> CommittedReader:
        return CommittedReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options, schema, overwrite)


def write_committed(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(CommittedSource)
    df.write.format("committed").option("kind", kind).mode(mode).save(path)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CommittedSource)
    return spark.read.format("committed").load(path)
