"""Runs registered queries beside their oracle SQL: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return str(x) if x is not None and not isinstance(x, (int, bool, str)) else x


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows_of(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty, or what differs."""
    mine = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    theirs = rows_of([c[0] for c in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{a} and {b}"[:600]
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sys.argv[1]), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            df = f(spark, sys.argv[1])
            said = compare(df, con, sql[name]) if name in sql else f"no oracle, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        ok = not said or said.startswith("no oracle")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - t:.1f}s {said}", flush=True)
    sys.exit(bad > 0)
