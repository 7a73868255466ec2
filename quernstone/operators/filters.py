"""The predicate algebra: small builders of conditions, semi- and anti-joins."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import like_pattern
from quernstone.operators.deal import dealt


def all_of(conditions: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def point_between(at: Column, since: str | None = None, until: str | None = None) -> Column:
    return all_of([at >= F.lit(since).cast("timestamp_ntz") if since else None, at <= F.lit(until).cast("timestamp_ntz") if until else None])


def overlaps(start: Column, end: Column, since: str | None = None, until: str | None = None) -> Column:
    """An interval with open ends allowed: a missing end is the other one."""
    return all_of([F.coalesce(end, start) >= F.lit(since).cast("timestamp_ntz") if since else None, F.coalesce(start, end) <= F.lit(until).cast("timestamp_ntz") if until else None])


def equal_or_like(value: Column, wanted: str) -> Column:
    return value.ilike(wanted.replace("\\", "\\\\").replace("_", "\\_").replace("*", "%")) if "%" in wanted or "*" in wanted else value == wanted


def any_like(values: Column, pattern: str) -> Column:
    """Some element matches; a null array matches nothing."""
    return F.coalesce(F.exists(values, lambda x: x.ilike(like_pattern(pattern))), F.lit(False))


def not_in_or_null(value: Column, excluded: list[str]) -> Column:
    return value.isNull() | ~value.isin(excluded) if excluded else F.lit(True)


def tri_state(flag: Column, mode: str) -> Column:
    return {"include": F.lit(True), "only": flag, "exclude": ~flag}[mode]


def matching(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def linked_to(rows: DataFrame, links: DataFrame, key: str, a: str, b: str, target) -> DataFrame:
    """Rows that an undirected edge ties to the target."""
    ends = links.where(F.col(a) == target).select(F.col(b).alias(key)).union(links.where(F.col(b) == target).select(F.col(a).alias(key)))
    return rows.join(ends, key, "left_semi")


def roll_up(rows: DataFrame, key: str, parent: str, child: Column) -> DataFrame:
    """Hides children whose parent is among the rows; orphans stay."""
    n = rows.count()
    parents = dealt(rows.select(F.col(key).alias("__parent")), ["__parent"], n).distinct()
    # rows without a parent, most of them as a rule, would all meet in one task of the join
    children = dealt(rows.where(F.col(parent).isNotNull()), [parent], n)
    shown = children.join(parents, F.col(parent) == F.col("__parent"), "left").where(~child | F.col("__parent").isNull()).drop("__parent")
    return rows.where(F.col(parent).isNull()).union(shown)


def ignored(path: Column, entries: list[str]) -> Column:
    """A path equal to an entry, under it, or with it as a segment; case doesn't matter."""
    low = F.lower(path)
    hits = [(low == e.lower()) | low.startswith(e.lower().rstrip("/") + "/") | (F.array_contains(F.split(low, "/"), e.lower()) if "/" not in e else F.lit(False)) for e in entries]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def resolve_prefix(rows: DataFrame, key: str, text: str, top: Column, most: int = 25) -> DataFrame:
    """Rows whose key starts with the text, or, if none does, holds it; top-level ones first."""
    tiers = rows.withColumn("tier", F.when(F.col(key).startswith(text), 0).when(F.contains(F.col(key), F.lit(text)), 1)).where("tier IS NOT NULL")
    best = tiers.agg(F.min("tier").alias("best"))
    return tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best", "tier").orderBy(F.when(top, 0).otherwise(1), key).limit(most)


def resolve_name(rows: DataFrame, path: str, text: str) -> DataFrame:
    """Distinct paths by the best tier that has one: equal, last segment equal, contains."""
    from quernstone.functions.text import last_segment

    p = F.lower(F.col(path))
    tier = F.when(p == text.lower(), 0).when(last_segment(p) == text.lower(), 1).when(F.contains(p, F.lit(text.lower())), 2)
    tiers = rows.select(path, tier.alias("tier")).where("tier IS NOT NULL").distinct()
    return tiers.join(F.broadcast(tiers.agg(F.min("tier").alias("best"))), F.col("tier") == F.col("best")).drop("best")


def at_least(rows: DataFrame, counts: DataFrame, on: str, count: str, n: int) -> DataFrame:
    return rows.join(counts.where(F.col(count) >= n), on, "left_semi")


def holds_marker(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers], F.lit(False))


def valid_date(text: str) -> bool:
    """YYYY-MM-DD, alone or before a time."""
    try:
        date.fromisoformat(text[:10])
        return len(text) == 10 or (text[10] in "T " and bool(datetime.fromisoformat(text.replace("Z", "+00:00"))))
    except (ValueError, IndexError):
        return False


def has_metadata_filters(filters: dict) -> bool:
    """Dates and ghost modes don't count as filters on metadata."""
    return any(v not in (None, [], "include") for k, v in filters.items() if k not in ("since", "until", "ghosts"))
