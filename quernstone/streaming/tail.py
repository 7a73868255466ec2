"""A stream of growing line files: what was appended since the last batch, whole lines only."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Appended(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class TailReader(DataSourceStreamReader):
    """The offset is, per file, the byte after the last whole line; a file that shrank is read anew. Each file's range
    is a partition, read by a task, so the folder must be one that all executors see."""

    def __init__(self, options: dict):
        self.pattern = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: self.whole(p) for p in sorted(glob.glob(self.pattern, recursive=True)) if os.path.isfile(p)}

    @staticmethod
    def whole(path: str, step: int = 1 << 16) -> int:
        """The byte after the last line end, looked for from the end."""
        at = os.path.getsize(path)
        with open(path, "rb") as f:
            while at > 0:
                begin = max(0, at - step)
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Appended]:
        ranges = [(p, start.get(p, 0) if start.get(p, 0) <= e else 0, e) for p, e in end.items()]
        return [Appended(p, b, e) for p, b, e in ranges if e > b]

    def read(self, partition: Appended) -> Iterator[tuple]:
        at = partition.begin
        with open(partition.path, "rb") as f:
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing to release; offsets live in the query's checkpoint


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("tail_lines").load("/shared/**/*.jsonl")"""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "path string, begin long, text string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
