"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; clamped to -1..1."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def l2_to_cosine(distance: Column) -> Column:
    """Of unit vectors."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - distance * distance / 2))


def token_cosine(a: Column, b: Column) -> Column:
    """|A ∩ B| / sqrt(|A| |B|) of two arrays taken as sets; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.size(x).cast("double") * F.size(y)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.sqrt(n))


def text_windows(text: Column, size: int, stride: float = 0.75, most: int | None = None) -> Column:
    """Overlapping windows of a text: begin (from 1) and text; all of them, or the first `most` (256 is usual for cards)."""
    step = max(1, int(size * stride))
    last = F.greatest(F.lit(1), F.char_length(text) - size + step)
    starts = F.sequence(F.lit(1), last, F.lit(step))
    starts = starts if most is None else F.slice(starts, 1, most)
    return F.transform(starts, lambda s: F.struct(s.alias("begin"), F.substr(text, s, F.lit(size)).alias("text")))
