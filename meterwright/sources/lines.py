"""Lines of append-only transcript files as a data source of its own, for batch and stream.

``spark.read.format("transcript_lines").option("paths", ...)`` gives one row per
line with its number, from one scan. A partition is a set of small whole files
or a range of bytes of a large one. A line belongs to the range in which it starts, and
its number is one more than the line ends before it: a task counts those of its
own range, and the index of a large file, made by ``line_index``, says how many
lie before each range.

``spark.readStream.format("transcript_lines")`` gives what was appended since
the last batch. Its offsets are cursors, the bytes read of each file, so a batch
that is run again after a failure reads the same bytes. Only whole lines are
read: a line still being written waits for its end.

Files are opened by ``pyarrow.fs`` (local, HDFS, S3, Google, Azure paths).
Patterns may have ``*``, ``?`` and ``[...]`` within a level of the path.

Defined results: blank lines are counted but not returned by a batch read (a
stream returns them, as its lines are numbered later); ``\\r`` before a line end is dropped; a last
line without an end counts in a batch; bytes that are no UTF-8 become
replacement characters; empty files have no rows; a stream reads nothing of a file that has
shrunk until it has grown past its cursor.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "transcript_lines"
SCHEMA = "path string, mtime timestamp, size long, line_no long, raw string"
TAIL_SCHEMA = "path string, mtime timestamp, byte long, raw string"
#: Bytes of a partition where the session names none, bytes read at once, rows of a batch.
SPLIT, CHUNK, ROWS = 128 << 20, 1 << 20, 8192
_STAMP = pa.timestamp("us", tz="UTC")


@dataclass(frozen=True)
class Listed:
    """A file: its path with scheme, its time in microseconds, and its size."""

    path: str
    mtime: int
    size: int


@dataclass(frozen=True)
class Range:
    """Lines of ``file`` that start in [start, end); ``before`` line ends lie before ``start``."""

    file: Listed
    start: int
    end: int
    before: int


@dataclass
class Ranges(InputPartition):
    ranges: tuple[Range, ...]


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path there, what to put before a path there)."""
    if "://" not in path or path.startswith("file://"):
        return fs.LocalFileSystem(), path.removeprefix("file://"), "file://"
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@?=&*[]"))
    return system, inner, path[: path.rindex(inner)]


def list_files(patterns: list[str], modified_after: datetime | None = None) -> list[Listed]:
    """Files of all patterns, each once, by path."""
    found: dict[str, Listed] = {}
    for pattern in patterns:
        system, inner, prefix = file_system(pattern)
        levels = inner.split("/")
        wild = next((k for k, x in enumerate(levels) if any(c in x for c in "*?[")), None)
        if wild is None:
            own = system.get_file_info(inner)
            infos = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        else:
            infos = system.get_file_info(fs.FileSelector("/".join(levels[:wild]) or "/", recursive=True, allow_not_found=True))
            infos = [i for i in infos if len(p := i.path.split("/")) == len(levels) and all(map(fnmatch.fnmatchcase, p, levels))]
        for i in infos:
            if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")):
                if modified_after is None or i.mtime > modified_after:
                    found[prefix + i.path] = Listed(prefix + i.path, i.mtime_ns // 1000, i.size)
    return [found[p] for p in sorted(found)]


def _ranges(size: int, split: int) -> list[tuple[int, int]]:
    return [(k, min(k + split, size)) for k in range(0, size, split)]


def planned(files: list[Listed], split: int, index: dict[str, list[int]]) -> list[Ranges]:
    """Partitions of about ``split`` bytes. A file without an entry in the index is read in one piece."""
    out, small, room = [], [], split
    for f in files:
        if f.path in index:  # the file may have grown since it was counted: its last range has the rest
            known = index[f.path]
            cuts = [(k * split, (k + 1) * split if k + 1 < len(known) else max(f.size, (k + 1) * split)) for k in range(len(known))]
            out += [Ranges((Range(f, a, b, before),)) for (a, b), before in zip(cuts, known, strict=True)]
            continue
        cuts = [(0, f.size)] if f.size else []
        for a, b in cuts:
            if small and b - a > room:
                out.append(Ranges(tuple(small)))
                small, room = [], split
            small.append(Range(f, a, b, 0))
            room -= b - a
    return [*out, Ranges(tuple(small))] if small else out


def _lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that start in [start, end); first comes a pair (-1, b"") if a line end
    had to be passed to reach the first one."""
    system, inner, _ = file_system(path)
    with system.open_input_file(inner) as file:
        at = start
        if start > 0:  # the byte before tells whether a line starts here
            at = start - 1
        file.seek(at)
        held, passing = b"", start > 0
        while at < end or held or passing:
            if at >= end and not passing:
                break
            cut = held.find(b"\n")
            while cut < 0:
                more = file.read(CHUNK)
                if not more:
                    break
                cut = more.find(b"\n")
                cut, held = (len(held) + cut if cut >= 0 else -1), held + more
            if cut < 0:  # the end of the file
                if held and not passing:
                    yield at, held
                return
            line, rest = held[:cut], held[cut + 1 :]
            if passing:
                passing = False
                if at + cut >= start:  # a line end within the range belongs to a line of the range before
                    yield -1, b""
            else:
                yield at, line
            at += cut + 1
            # many short lines: go through the chunk without copying the rest each time
            if at < end and rest:
                base, pos = at, 0
                while (nxt := rest.find(b"\n", pos)) >= 0 and base + pos < end:
                    yield base + pos, rest[pos:nxt]
                    pos = nxt + 1
                at, rest = base + pos, rest[pos:]
            held = rest


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == ROWS or size > 8 * CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.patterns = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("splitBytes", SPLIT))
        self.index = json.loads(options.get("index", "{}"))
        after = options.get("modifiedAfter")
        self.after = datetime.fromisoformat(after).replace(tzinfo=UTC) if after else None

    def partitions(self):
        return planned(list_files(self.patterns, self.after), self.split, self.index)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in partition.ranges:
                number = r.before
                for place, line in _lines(r.file.path, r.start, r.end):
                    number += 1
                    text = _text(line) if place >= 0 else ""
                    if text:
                        yield r.file.path, r.file.mtime, r.file.size, number, text

        kinds = [("path", pa.string()), ("mtime", _STAMP), ("size", pa.int64()), ("line_no", pa.int64()), ("raw", pa.string())]
        return _batches(rows(), pa.schema(kinds))


class TailReader(DataSourceStreamReader):
    """Appended lines. An offset is {path: bytes read}: one number for each file there is."""

    def __init__(self, options):
        self.patterns = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("splitBytes", SPLIT))
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"read": {}}

    def latestOffset(self) -> dict:
        for f in list_files(self.patterns):
            if self.ends.get(f.path, (-1, 0))[0] != f.size:
                self.ends[f.path] = (f.size, self._last_line_end(f))
        return {"read": {p: end for p, (_, end) in self.ends.items()}}

    @staticmethod
    def _last_line_end(f: Listed) -> int:
        system, inner, _ = file_system(f.path)
        at = f.size
        with system.open_input_file(inner) as file:
            while at > 0:
                start = max(0, at - 65_536)
                file.seek(start)
                cut = file.read(at - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict):
        out = []
        for path, last in sorted(end["read"].items()):
            first = start["read"].get(path, 0)
            f = Listed(path, 0, last)
            out += [Ranges((Range(f, first + a, first + b, 0),)) for a, b in _ranges(max(last - first, 0), self.split)]
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in partition.ranges:
                system, inner, _ = file_system(r.file.path)
                mtime = system.get_file_info(inner).mtime_ns // 1000
                for place, line in _lines(r.file.path, r.start, r.end):
                    if place >= 0:
                        yield r.file.path, mtime, place, _text(line)

        return _batches(rows(), pa.schema([("path", pa.string()), ("mtime", _STAMP), ("byte", pa.int64()), ("raw", pa.string())]))

    def commit(self, end: dict) -> None:
        pass


class TranscriptLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TAIL_SCHEMA if self.options.get("tail", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def line_index(spark: SparkSession, files: list[Listed], split: int) -> dict[str, list[int]]:
    """For each file of more than ``split`` bytes: the line ends before each of its ranges. The bytes are counted by tasks;
    one number a range comes back."""
    large = [(f.path, a, b) for f in files if f.size > split for a, b in _ranges(f.size, split)]
    if not large:
        return {}

    def counted(batches):
        for batch in batches:
            n = []
            for path, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                system, inner, _ = file_system(path)
                with system.open_input_file(inner) as file:
                    file.seek(a)
                    left, ends = b - a, 0
                    while left > 0 and (some := file.read(min(CHUNK, left))):
                        left, ends = left - len(some), ends + some.count(b"\n")
                n.append(ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["path", "start", "n"])

    ranges = spark.createDataFrame(large, "path string, start long, stop long").repartition(min(len(large), 1000))
    out: dict[str, list[int]] = {}
    total: dict[str, int] = {}
    for r in ranges.mapInArrow(counted, "path string, start long, n long").orderBy("path", "start").collect():
        out.setdefault(r["path"], []).append(total.get(r["path"], 0))
        total[r["path"]] = total.get(r["path"], 0) + r["n"]
    return out


def split_of(spark: SparkSession) -> int:
    """Bytes of a partition: those of the session's file scans."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get("spark.sql.files.maxPartitionBytes", str(SPLIT)).lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit.removesuffix("b") if len(unit) > 1 else unit]


def read_lines(spark: SparkSession, patterns: list[str], modified_after: str | None = None, split: int | None = None) -> DataFrame:
    """path, mtime, size, line_no, raw of all files: one scan; of files larger than a split the line ends are counted before."""
    spark.dataSource.register(TranscriptLines)
    split = split or split_of(spark)
    after = datetime.fromisoformat(modified_after).replace(tzinfo=UTC) if modified_after else None
    reader = spark.read.format(NAME).option("paths", json.dumps(patterns)).option("splitBytes", split)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.option("index", json.dumps(line_index(spark, list_files(patterns, after), split))).load()


def tail_lines(spark: SparkSession, patterns: list[str], split: int | None = None) -> DataFrame:
    """Stream of appended lines: path, mtime, byte (where the line starts), raw."""
    split = split or split_of(spark)
    spark.dataSource.register(TranscriptLines)
    return spark.readStream.format(NAME).option("paths", json.dumps(patterns)).option("splitBytes", split).option("tail", "true").load()
