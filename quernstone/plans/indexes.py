"""Stored indexes and tables of the registered queries, made once a session and source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from quernstone.operators.index import Terms, TextIndex
from quernstone.operators.stored import new_path
from quernstone.plans.tables import table

_made: dict[tuple, object] = {}


def once[T](spark: SparkSession, d: str, what: tuple, make: Callable[[], T]) -> T:
    """As a store would keep it beside its source; sources don't change during a session."""
    key = (spark.sparkContext.applicationId, d, *what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def index_of(spark: SparkSession, d: str, of: str, key: str, columns: dict[str, float], only: Terms) -> TextIndex:
    """Of the terms that a registered query asks, as far more is written for all terms than one query reads."""
    rows = table(spark, d, of).selectExpr(f"{key} AS key", *columns)
    return once(spark, d, ("index", of, key, *columns, only), lambda: TextIndex.build(rows, "key", columns, new_path(spark, "index"), only))
