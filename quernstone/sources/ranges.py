"""Line files read by byte ranges, and the two ends of files, without reading them whole.

A range is a partition: its task seeks to it and reads on to the end of the line that it ends in, so one large file is
read by many tasks. Paths are URIs that pyarrow opens (file, s3, hdfs, gs) or plain paths that all executors see.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 1 << 20
#: Bytes of a file's head and tail, and of the tail where those tell no title.
HEAD, TAIL, ESCALATED = 65_536, 65_536, 1 << 20
ROWS = 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str, glob: str) -> list[tuple[str, int, float]]:
    """Name, bytes and time of the files at or below a path, by name. Hidden ones (., _) are passed over."""
    store, at = opened(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    named = [(f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob) and f.base_name[0] not in "._"]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + p, n, t) for p, n, t in named)


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def lines_between(f: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    """Offset, bytes (without the line end) and whether a line end closes it, of the lines that begin in [begin, end)."""
    f.seek(max(0, begin - 1))
    skip = begin > 0 and f.read(1) != b"\n"
    at, held = begin, []  # what is held begins at byte `at`
    while at < end and (block := f.read(STEP)):
        *whole, rest = block.split(b"\n")
        for piece in whole:
            line = b"".join([*held, piece])
            held = []
            if not skip and at < end:
                yield at, line, True
            skip, at = False, at + len(line) + 1
        held.append(rest)
    if at < end and not skip and (left := b"".join(held)):
        yield at, left, False


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob, self.chunk = options["path"], options.get("glob", "*"), int(options.get("chunk", 64 << 20))
        self.after = json.loads(options.get("after", "{}"))

    def partitions(self) -> list[Range]:
        """A file that is shorter than the offset to go on from has been written anew and is read from its beginning."""
        found = []
        for path, size, _ in files_below(self.path, self.glob):
            begin = self.after.get(path, 0)
            begin = begin if begin <= size else 0
            found += [Range(path, b, min(b + self.chunk, size)) for b in range(begin, size, self.chunk)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        store, at = opened(partition.path)
        with store.open_input_file(at) as f:
            rows: list[tuple] = []
            for begin, line, closed in lines_between(f, partition.begin, partition.end):
                rows.append((partition.path, begin, line.removesuffix(b"\r").decode("utf-8", "replace"), begin, begin + len(line) + closed, closed))
                if len(rows) == ROWS:
                    yield batch(rows, LINES)
                    rows = []
            if rows:
                yield batch(rows, LINES)


LINES = pa.schema([("path", pa.string()), ("line", pa.int64()), ("text", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("closed", pa.bool_())])
ENDS = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string())), ("read", pa.int64())])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


class RangeLines(DataSource):
    """path; options glob, chunk (bytes of a range), after (JSON: offset to go on from, by path)."""

    @classmethod
    def name(cls) -> str:
        return "range_lines"

    def schema(self) -> str:
        return "path string, line long, text string, begin long, end long, closed boolean"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


def whole_lines(data: bytes, drop_first: bool, drop_last: bool) -> list[str]:
    parts = data.split(b"\n")
    parts = parts[1 if drop_first else 0 : len(parts) - 1 if drop_last else len(parts)]
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in parts if x.strip()]


def ends_of(path: str, size: int, titles: list[str]) -> tuple[list[str], list[str], int]:
    """Whole lines of the head and of the tail, and the bytes that were read for them. The tail is read further back
    only where no line has one of the title keys; a file that fits in the head has no tail."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        head = whole_lines(f.read(min(HEAD, size)), False, size > HEAD)
        tail, read = [], min(HEAD, size)
        if size > HEAD:
            for most in (TAIL, ESCALATED):
                n = min(most, size)
                f.seek(size - n)
                tail, read = whole_lines(f.read(n), n < size, False), read + n
                if not titles or n == size or any(f'"{t}"' in line for t in titles for line in head + tail):
                    break
    return head, tail, read


class EndsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob, self.per = options["path"], options.get("glob", "*"), int(options.get("files", 64))
        self.titles = [t for t in options.get("titles", "").split(",") if t]

    def partitions(self) -> list[Files]:
        found = files_below(self.path, self.glob)
        return [Files(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, size, at in partition.files:
            head, tail, read = ends_of(path, size, self.titles)
            yield batch([(path, size, int(at * 1e6), head, tail, read)], ENDS)


class FileEnds(DataSource):
    """path; options glob, files (of a task), titles (JSON keys, comma-separated, that spare a longer tail)."""

    @classmethod
    def name(cls) -> str:
        return "file_ends"

    def schema(self) -> str:
        return "path string, bytes long, modified timestamp, head array<string>, tail array<string>, read long"

    def reader(self, schema) -> EndsReader:
        return EndsReader(self.options)


def line_ranges(spark: SparkSession, path: str, glob: str = "*", chunk: int = 64 << 20, after: dict[str, int] | None = None) -> DataFrame:
    """path, line (the line's first byte, which orders it), text, begin, end, closed: every line of the files, also a
    last one that no line end closes (`closed` is false: leave it for later). after: where to go on, by path."""
    spark.dataSource.register(RangeLines)
    return spark.read.format("range_lines").options(glob=glob, chunk=chunk, after=json.dumps(after or {})).load(path)


def consumed(lines: DataFrame) -> DataFrame:
    """path, at: the byte after the last whole line of each file, to go on from."""
    return lines.where("closed").groupBy("path").agg({"end": "max"}).withColumnRenamed("max(end)", "at")


def file_ends(spark: SparkSession, path: str, glob: str = "*", titles: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes, modified, head and tail (whole lines), read (bytes): a file's first and last 64 KiB, the last MiB
    where those have none of the title keys."""
    spark.dataSource.register(FileEnds)
    return spark.read.format("file_ends").options(glob=glob, titles=",".join(titles)).load(path)
