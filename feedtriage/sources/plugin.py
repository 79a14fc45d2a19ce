"""Source kinds written in Python, read with ``spark.read.format(kind)`` or as a stream.

A kind is a function from the bytes of one landed file to its entries. Spark deals the
files to tasks by size; a file is read by the task that parses it.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: (title, url, summary, published) of each entry of a file; published may be None.
Parse = Callable[[bytes], Iterable[tuple[str | None, str | None, str | None, datetime | None]]]

ENTRIES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("fetched_at", T.TimestampType()),
    T.StructField("entry_ord", T.IntegerType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("published", T.TimestampType()), T.StructField("error", T.StringType())])

#: Files of a task add up to about so many bytes.
TASK_BYTES = 32 << 20

#: Bytes of a file that a task holds at a time, besides a line, if its kind goes by lines.
CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class ByLine:
    """A kind whose files are UTF-8 text with a document a line: ``parse`` gets one line at a
    time, so that a task holds a line, not a file."""
    parse: Parse

    def __call__(self, body: bytes) -> Iterable[tuple]:
        return self.parse(body)


@dataclass
class Files(InputPartition):
    """Files of one task as (path, nanoseconds of last change)."""
    paths: list[tuple[str, int]]


def landed_files(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of all files below ``path``, in the order they landed. Names that
    begin with a dot or an underscore are not payloads."""
    where, root = fs.FileSystem.from_uri(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found
                  if f.type == fs.FileType.File and f.base_name[0] not in "._")


def deal(files: list[tuple[int, str, int]], task_bytes: int = TASK_BYTES) -> list[Files]:
    """Neighbouring files together, up to ``task_bytes``; a larger file is a task by itself."""
    parts, held = [], 0
    for at, name, size in files:
        if not parts or held + size > task_bytes:
            parts.append(Files([]))
            held = 0
        parts[-1].paths.append((name, at))
        held += size
    return parts


def _check_text(stream) -> None:
    """Raise if the stream cannot be read to its end, or is no UTF-8 there."""
    decoder, at = codecs.getincrementaldecoder("utf-8")(), 0
    while True:
        chunk = stream.read(CHUNK_BYTES)
        held = len(decoder.getstate()[0])
        try:
            decoder.decode(chunk, final=not chunk)
        except UnicodeDecodeError as fault:
            raise _NoText(fault, at - held) from None
        if not chunk:
            return
        at += len(chunk)


class _NoText(Exception):
    """A UnicodeDecodeError in the middle of a file, told by its place in the file."""

    def __init__(self, fault: UnicodeDecodeError, before: int):
        first, last = fault.start + before, fault.end - 1 + before
        where = f"byte 0x{fault.object[fault.start]:02x} in position {first}" if first == last else f"bytes in position {first}-{last}"
        super().__init__(f"'{fault.encoding}' codec can't decode {where}: {fault.reason}")


def _lines(stream) -> Iterator[bytes]:
    rest = []
    while chunk := stream.read(CHUNK_BYTES):
        first, *others = chunk.split(b"\n")
        rest.append(first)
        if others:
            yield b"".join(rest)
            yield from others[:-1]
            rest = [others[-1]]
    yield b"".join(rest)


def _entries(where: fs.FileSystem, name: str, parse: Parse) -> Iterator[tuple]:
    if isinstance(parse, ByLine):
        with where.open_input_stream(name, compression="detect") as stream:
            _check_text(stream)  # a file that is no text as a whole gives no entries
        with where.open_input_stream(name, compression="detect") as stream:
            for line in _lines(stream):
                yield from parse.parse(line)
    else:
        with where.open_input_stream(name, compression="detect") as stream:
            body = stream.read()
        yield from parse(body)


def _read(partition: Files, parse: Parse, path: str) -> Iterator[tuple]:
    """The entries of each file; of a file that cannot be read to its end, those before the
    fault, and a row that holds the error."""
    where, _ = fs.FileSystem.from_uri(path)
    for name, at in partition.paths:
        fetched = datetime.fromtimestamp(at / 1e9, timezone.utc)
        k = 0
        try:
            for entry in _entries(where, name, parse):
                yield (name, fetched, k, *entry, None)
                k += 1
        except Exception as fault:
            kind = "UnicodeDecodeError" if isinstance(fault, _NoText) else type(fault).__name__
            yield name, fetched, k, None, None, None, None, f"{kind}: {fault}"


class _Reader(DataSourceReader):
    def __init__(self, parse: Parse, path: str):
        self.parse, self.path = parse, path

    def partitions(self) -> list[Files]:
        return deal(landed_files(self.path)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(partition, self.parse, self.path)


class _StreamReader(DataSourceStreamReader):
    """Files in the order of (time of last change, path); the last one read is the offset.

    Files are put in place by a rename, none with an earlier time than one that was read.
    """

    def __init__(self, parse: Parse, path: str):
        self.parse, self.path = parse, path

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = landed_files(self.path)
        return {"at": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = (start["at"], start["path"]), (end["at"], end["path"])
        return deal([f for f in landed_files(self.path) if first < f[:2] <= last]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(partition, self.parse, self.path)


def data_source(kind: str, parse: Parse) -> type[DataSource]:
    class PluginSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> T.StructType:
            return ENTRIES

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(parse, self.options["path"])

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _StreamReader(parse, self.options["path"])

    return PluginSource


def register_format(spark: SparkSession, kind: str, parse: Parse) -> None:
    """Make ``spark.read.format(kind).load(path)`` read files that ``parse`` understands."""
    spark.dataSource.register(data_source(kind, parse))
