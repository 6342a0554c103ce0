r"""COPY text as a data source: ``spark.read.format("copytext")``, ``df.write``, ``spark.readStream`` and ``writeStream``.

``register(spark)`` makes the format known.  Options: ``path``; ``table``, a table of the model, whose schema is taken where none
is given; ``columns``, the order of the columns in the files, where it is another one; ``splitbytes``.

Reading is planned in byte ranges of at most ``splitbytes``: a line belongs to the range it begins in, and a range holds one
batch of lines at a time.  Writing goes to a folder of its own first; the driver moves the files of the tasks that succeeded
when all have, so a failed or repeated task leaves nothing behind.  Files are named by the moment of the commit, a stream's by the
number of its batch: a repeated batch writes the same names.  A stream of such a folder reads files in the order of their names,
each once.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ballotlake.model import SCHEMAS
from ballotlake.sources.copytext import ESCAPES

SPLIT_BYTES = 64 << 20
ROWS = 10_000
_LETTERS = {letter.encode(): character.encode() for letter, character in ESCAPES}
_ESCAPED = re.compile(rb"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", re.S)
_PLAIN = re.compile("[" + "".join(re.escape(c) for _, c in ESCAPES) + r"\\]")
_SHORT = {character: "\\" + letter for letter, character in ESCAPES} | {"\\": "\\\\"}


def _unescaped(found: re.Match) -> bytes:
    code = found[1]
    if code[:1] == b"x" and len(code) > 1:
        return bytes([int(code[1:], 16)])
    return bytes([int(code, 8) & 0xFF]) if code[:1].isdigit() and code[:1] < b"8" else _LETTERS.get(code, code)


def _value(field: bytes) -> str | None:
    if field == b"\\N":
        return None
    return (_ESCAPED.sub(_unescaped, field) if b"\\" in field else field).decode()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/(?!/)", path):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[fs.FileInfo]:
    """The data files of a folder, or the one file, by name; hidden ones and those of running writes are left out."""
    system, inner = _place(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in some bytes."""
    file: str
    begin: int
    end: int


def _ranges(files: list[fs.FileInfo], split_bytes: int) -> list[Range]:
    return [Range(f.path, a, min(a + split_bytes, f.size)) for f in files for a in range(0, f.size, split_bytes)]


class _Lines:
    """Reads ranges into Arrow batches of a schema."""

    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.arrow = to_arrow_schema(schema)
        self.columns = [c.strip() for c in options.get("columns", "").split(",") if c.strip()] or schema.names
        if missing := set(schema.names) - set(self.columns):
            raise ValueError(f"the files have no columns {sorted(missing)}")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        with system.open_input_file(part.file) as stream:
            at = part.begin
            stream.seek(max(0, at - 1))
            rest = b""
            if at:
                # The line that holds the byte before belongs to the range before, unless it ends there.
                rest, at = self._skip(stream, at)
            rows: list[list[bytes]] = []
            while at < part.end:
                end = rest.find(b"\n")
                if end < 0:
                    more = stream.read(1 << 20)
                    if more:
                        rest += more
                        continue
                    end = len(rest)
                    if not rest:
                        break
                lines, taken = [rest[:end]], end + 1
                last = rest.rfind(b"\n")
                if last > end:  # all whole lines at hand that begin in the range
                    lines = rest[:last].split(b"\n")
                    taken = last + 1
                for line in lines:
                    if at >= part.end:
                        break
                    at += len(line) + 1
                    if line != b"\\.":
                        rows.append(line.split(b"\t"))
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
                rest = rest[taken:]
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _skip(stream, at: int) -> tuple[bytes, int]:
        rest, at = stream.read(1 << 20), at - 1
        while (end := rest.find(b"\n")) < 0:
            at += len(rest)
            rest = stream.read(1 << 20)
            if not rest:
                return b"", 1 << 62
        return rest[end + 1:], at + end + 1

    def _batch(self, rows: list[list[bytes]]) -> pa.RecordBatch:
        if any(len(r) != len(self.columns) for r in rows):
            wrong = next(r for r in rows if len(r) != len(self.columns))
            raise ValueError(f"wrong number of columns: {wrong!r}")
        out = []
        for field in self.arrow:
            k = self.columns.index(field.name)
            out.append(pc.cast(pa.array([_value(r[k]) for r in rows], pa.string()), field.type))
        return pa.RecordBatch.from_arrays(out, schema=pa.schema([pa.field(f.name, f.type) for f in self.arrow]))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.lines = _Lines(schema, options)

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.lines.path), self.lines.split_bytes) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.lines.batches(partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    """Files by name; an offset is the last name read."""

    def __init__(self, schema: StructType, options: dict):
        self.lines = _Lines(schema, options)

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        names = [f.base_name for f in _files(self.lines.path)]
        return {"file": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = [f for f in _files(self.lines.path) if start["file"] < f.base_name <= end["file"]]
        return _ranges(files, self.lines.split_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.lines.batches(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class _Files:
    """Writes each task's rows to a file in a folder for this write alone, and moves the files at the commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staging = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = _place(self.path)
        file, out = f"{inner}/{self.staging}/{uuid.uuid4().hex}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(f"{inner}/{self.staging}", recursive=True)
                out = system.open_output_stream(file)
            columns = [pc.cast(c, pa.string()).to_pylist() for c in batch.columns]
            out.write("".join("\t".join(map(_text, row)) + "\n" for row in zip(*columns)).encode())
        if out is not None:
            out.close()
        return Written(file if out is not None else None)

    def publish(self, messages: list[Written | None], prefix: str, replace: bool) -> None:
        system, inner = _place(self.path)
        system.create_dir(inner, recursive=True)
        old = _files(self.path) if self.overwrite else []
        if replace:  # what an earlier try of this batch had moved
            old = [f for f in _files(self.path) if f.base_name.startswith(prefix)]
        for file in old:
            system.delete_file(file.path)
        for k, message in enumerate(m for m in messages if m and m.file):
            system.move(message.file, f"{inner}/{prefix}{k:05d}.copy")
        self.drop()

    def drop(self) -> None:
        system, inner = _place(self.path)
        if system.get_file_info(f"{inner}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staging}")


def _text(value: str | None) -> str:
    return "\\N" if value is None else _PLAIN.sub(lambda m: _SHORT[m[0]], value)


class _Writer(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, f"part-{time.time_ns():020d}-", False)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop()


class _StreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"batch-{batchId:020d}-", True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop()


class CopyText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "copytext"

    def schema(self) -> StructType:
        if "table" not in self.options:
            raise ValueError("name a table of the model, or give a schema")
        return SCHEMAS[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options), False)


def register(spark: SparkSession) -> None:
    """Makes ``format("copytext")`` known to a session."""
    spark.dataSource.register(CopyText)
