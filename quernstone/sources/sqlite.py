"""Tables of SQLite files, read from their bytes in the tasks, so that any store Spark reads will do."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def pick(present: list[str], candidates: list[str]) -> str | None:
    """The first candidate there is, whatever its case."""
    low = {p.lower(): p for p in present}
    return next((low[c.lower()] for c in candidates if c.lower() in low), None)


def sqlite_table(spark: SparkSession, path: str, tables: list[str], columns: dict[str, list[str]], glob: str = "*") -> DataFrame:
    """path and one text column for each entry of columns: of the first table that a file has, the first candidate
    column it has, null if none. Files that are no SQLite, or without such a table, give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, data in zip(b["path"], b["content"]):
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(bytes(data))
                    name = pick([r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")], tables)
                    if not name:
                        continue
                    present = [r[1] for r in con.execute(f'PRAGMA table_info("{name}")')]
                    chosen = [pick(present, c) for c in columns.values()]
                    asked = ", ".join(f'CAST("{c}" AS TEXT)' if c else "NULL" for c in chosen)
                    for rows in iter(lambda q=con.execute(f'SELECT {asked} FROM "{name}" ORDER BY rowid'): q.fetchmany(10_000), []):
                        yield pd.DataFrame([(where, *r) for r in rows], columns=["path", *columns])
                except sqlite3.DatabaseError:
                    continue
                finally:
                    con.close()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, ", ".join(["path string", *[f"{c} string" for c in columns]]))
