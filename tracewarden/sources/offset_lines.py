"""Lines of log files with their place: a batch and stream source that never loses equal lines.

A line is known by its file and the byte at which it begins.  Files are cut into byte ranges that are read
independently; a line belongs to the range in which its first byte lies.  Files are numbered in the order of their
names when they are first seen, so ``file_no`` and ``start`` put all lines in order.  The stream form resumes at the
byte offsets of the last committed batch and leaves a line alone until its line feed is written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "offset_lines"
SCHEMA = "file string, file_no int, start bigint, line string, file_time timestamp"
#: Bytes of a range, of one read, and lines of one Arrow batch.
RANGE, READ, BATCH = 64 << 20, 1 << 20, 2_000
#: Bits of an order number that hold the offset in the file: files of up to a tebibyte.
OFFSET_BITS = 40

_ARROW = pa.schema(
    [("file", pa.string()), ("file_no", pa.int32()), ("start", pa.int64()), ("line", pa.string()), ("file_time", pa.timestamp("us", tz="UTC"))]
)


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [low, high)."""

    file: str
    file_no: int
    low: int
    high: int
    micros: int  # when the file was last written


@dataclass
class LogFile:
    path: str
    size: int
    micros: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


def list_files(path: str) -> list[LogFile]:
    """Files of a folder, or the file itself, by name; hidden files and those of sinks are left out."""
    system, place = _place(path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    base = place.rstrip("/")
    return [
        LogFile(prefix + f.path, f.size, int((f.mtime_ns or 0) // 1_000))
        for f in sorted(found, key=lambda f: f.path)
        if f.is_file and not any(part[:1] in "._" for part in f.path[len(base) :].split("/") if part)
    ]


def cut_ranges(file: LogFile, file_no: int, low: int, high: int, size: int) -> list[Range]:
    return [Range(file.path, file_no, at, min(at + size, high), file.micros) for at in range(low, high, size)]


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of every line that begins in the range; the last one may lack its line feed."""
    system, place = _place(part.file)
    with system.open_input_file(place) as source:
        at = part.low
        if at:  # a line begins behind a line feed
            source.seek(at - 1)
            rest = b""
            while True:
                block = source.read(READ)
                end = block.find(b"\n")
                if end >= 0:
                    at = source.tell() - len(block) + end + 1
                    break
                if not block:
                    return
            if at >= part.high:
                return
        source.seek(at)
        rest: list[bytes] = []
        while at < part.high:
            block = source.read(READ)
            if not block:
                line = b"".join(rest)
                if line:
                    yield at, line
                return
            pieces = block.split(b"\n")
            for piece in pieces[:-1]:
                line = b"".join([*rest, piece]) if rest else piece
                rest = []
                yield at, line
                at += len(line) + 1
                if at >= part.high:
                    return
            if pieces[-1]:
                rest.append(pieces[-1])


def _batch(part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    count = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part.file] * count, pa.string()),
            pa.array([part.file_no] * count, pa.int32()),
            pa.array([start for start, _ in rows], pa.int64()),
            pa.array([line.decode("utf-8", "replace") for _, line in rows], pa.string()),
            pa.array([part.micros] * count, pa.timestamp("us", tz="UTC")),
        ],
        schema=_ARROW,
    )


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes]] = []
    size = 0
    for row in lines_of(part):
        rows.append(row)
        size += len(row[1])
        if len(rows) >= BATCH or size >= 4 * READ:
            yield _batch(part, rows)
            rows, size = [], 0
    if rows:
        yield _batch(part, rows)


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        files = list_files(self.path)
        return [r for no, f in enumerate(files) for r in cut_ranges(f, no, 0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition) if partition else ()


def complete_until(file: LogFile, low: int) -> int:
    """The byte behind the last line feed at or behind low, else low."""
    system, place = _place(file.path)
    with system.open_input_file(place) as source:
        high = file.size
        while high > low:
            begin = max(low, high - READ)
            source.seek(begin)
            end = source.read(high - begin).rfind(b"\n")
            if end >= 0:
                return begin + end + 1
            high = begin
    return low


class _StreamReader(DataSourceStreamReader):
    """Offsets: for each file its number and the byte up to which complete lines are known.

    Numbers are given in the order in which files appear and kept in the folder ``numbers``, so that a restarted query
    goes on with them.
    """

    def __init__(self, path: str, size: int, numbers: str):
        self.path, self.size, self.numbers = path, size, numbers
        self.known: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        if self.known is None:
            self.known = _load(self.numbers)
        fresh = [f.path for f in files if f.path not in self.known]
        if fresh:
            first = len(self.known)
            self.known |= {path: first + i for i, path in enumerate(fresh)}
            _store(self.numbers, self.known)
        return {"files": json.dumps({f.path: [self.known[f.path], complete_until(f, 0)] for f in files}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        found = {f.path: f for f in list_files(self.path)}
        out: list[Range] = []
        for path, (number, high) in after.items():
            low = before.get(path, (number, 0))[1]
            if high > low:
                out += cut_ranges(found.get(path, LogFile(path, high, 0)), number, low, high, self.size)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


_NUMBERS = "files.json"


def _load(folder: str) -> dict[str, int]:
    system, place = _place(folder)
    if not system.get_file_info(f"{place}/{_NUMBERS}").is_file:
        return {}
    with system.open_input_file(f"{place}/{_NUMBERS}") as source:
        return json.loads(source.read())


def _store(folder: str, numbers: dict[str, int]) -> None:
    """Written aside and moved: a reader sees the old numbers or the new ones."""
    system, place = _place(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/_{_NUMBERS}") as out:
        out.write(json.dumps(numbers).encode())
    system.move(f"{place}/_{_NUMBERS}", f"{place}/{_NUMBERS}")


class OffsetLines(DataSource):
    """``spark.read`` or ``readStream`` format ``offset_lines``.

    Options: path (folder or file, or a URI that pyarrow knows), rangeBytes of a task, and for streams numbers, a folder
    of the stream's own.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        path = self.options.get("path")
        if not path:
            raise ValueError(f"{NAME} needs a path")
        return path, int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE)))

    def reader(self, schema) -> _Reader:
        return _Reader(*self._given())

    def streamReader(self, schema) -> _StreamReader:
        if not self.options.get("numbers"):
            raise ValueError(f"a stream of {NAME} needs a folder for the numbers of its files")
        return _StreamReader(*self._given(), self.options["numbers"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OffsetLines)
