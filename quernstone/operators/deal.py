"""Dealing rows over as many tasks as they need, so that no task's memory grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a few numbers that a task sorts or groups.
PER_TASK = 500_000


def dealt(rows: DataFrame, by: list[str], n_rows: int, per: int = PER_TASK) -> DataFrame:
    """Rows by a hash of some columns in tasks of about `per` rows, of n_rows in all. Numbers compress so well that by
    their bytes too many of them would be put in a task. Tables dealt by the same n_rows join without moving again."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n_rows // per)), *by)
