"""Listing, looking up, tagging and linking sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators.deal import dealt
from quernstone.operators.stored import kept

#: Pairs of keys that a task counts.
PAIRS = 2_000_000


def with_counts(rows: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Adds how many rows of each child table (name=(rows, foreign key)) belong to a row; children are counted before
    they are joined."""
    for name, (child, foreign) in children.items():
        counts = child.groupBy(F.col(foreign).alias("__of")).agg(F.count("*").alias(name))
        rows = rows.join(counts, rows[key] == F.col("__of"), "left").drop("__of").fillna(0, [name])
    return rows


def first_by(rows: DataFrame, key: str, order: str, value: Column, where: Column, name: str) -> DataFrame:
    """key and the value of the first row, in order, that meets the condition."""
    return rows.where(where).groupBy(key).agg(F.min_by(value, F.col(order)).alias(name))


def merged_page(branches: list[DataFrame], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One ordered page over several relations: each is cut to what the page can need before they meet."""
    cut = [b.orderBy(*order).limit(offset + limit) for b in branches]
    out = cut[0]
    for b in cut[1:]:
        out = out.unionByName(b)
    return out.orderBy(*order).offset(offset).limit(limit)


def look_up(wanted: DataFrame, key: str, *relations: DataFrame) -> DataFrame:
    """Rows of the wanted keys from the first relation that has them."""
    out, left = None, wanted
    for r in relations:
        found = r.join(left, key, "left_semi")
        out = found if out is None else out.unionByName(found)
        left = left.join(r, key, "left_anti")
    return out


def conversation_keys(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """key, conversation: a child's parent if that exists (one level), else the row itself."""
    n, both = rows.count(), rows.select(key, parent)
    parents = dealt(rows.select(F.col(key).alias("__p")), ["__p"], n).distinct()
    # rows without a parent, most of them as a rule, would all meet in one task of the join
    children = dealt(both.where(F.col(parent).isNotNull()), [parent], n)
    found = children.join(parents, F.col(parent) == F.col("__p"), "left").select(key, F.coalesce("__p", key).alias("conversation"))
    return both.where(F.col(parent).isNull()).select(key, F.col(key).alias("conversation")).union(found)


def tag_changes(tags: DataFrame, key: str, tag: str, add: DataFrame, remove: DataFrame) -> DataFrame:
    """The bridge table after adding and removing (key, tag) rows; a pair in both is removed."""
    return tags.select(key, tag).union(add.select(key, tag)).distinct().join(remove, [key, tag], "left_anti")


def tag_arrays(rows: DataFrame, tags: str, add: list[str], remove: list[str]) -> DataFrame:
    changed = F.array_except(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, add))), F.array(*map(F.lit, remove)) if remove else F.array().cast("array<string>"))
    return rows.withColumn(tags, F.array_sort(changed))


def histogram(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def links_of(links: DataFrame, a: str, b: str, target) -> DataFrame:
    """other, direction: the far ends of an undirected edge table."""
    out = links.where(F.col(a) == target).select(F.col(b).alias("other"), F.lit("out").alias("direction"))
    return out.union(links.where(F.col(b) == target).select(F.col(a), F.lit("in")))


def link_changes(links: DataFrame, a: str, b: str, add: DataFrame, remove: DataFrame) -> DataFrame:
    """An undirected edge table after changes: either direction names an edge, which is kept once, loops never."""
    every = links.select(a, b).union(add.select(a, b))
    n = every.count()
    pair = lambda df: dealt(df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)), [a, b], n).distinct()
    return pair(every).join(pair(remove), [a, b], "left_anti")


def shared_pairs(items: DataFrame, key: str, feature: str, least: int, most_holders: int, known: DataFrame | None = None) -> DataFrame:
    """a, b, shared: unordered pairs of keys that share at least `least` features, without known links.

    A feature that more than most_holders keys hold says nothing about a pair and is left out, which also bounds the
    pairs that one feature gives.
    """
    holders = items.select(F.col(feature).alias("f"), F.col(key).alias("k"))
    pairs = kept(dealt(holders, ["f", "k"], items.count()).distinct())
    rare = kept(pairs.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_holders)))
    size = rare.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("met")).first()
    telling = dealt(kept(pairs.join(rare.select("f"), "f")), ["f"], size.rows)
    met = telling.withColumnRenamed("k", "a").join(telling.withColumnRenamed("k", "b"), "f").where("a < b").select("a", "b")
    found = dealt(met, ["a", "b"], size.met, PAIRS).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return found if known is None else found.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def last_rows(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The last k rows of each group."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).where(F.col("__n") <= k).drop("__n")


def slice_rows(rows: DataFrame, group: str, order: str, first: int, last: int) -> DataFrame:
    """Rows first..last (from 1) of each group."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("place").between(first, last))


def with_neighbours(rows: DataFrame, wanted: DataFrame, group: str, order: str, reach: int = 1) -> DataFrame:
    """The wanted rows (group, order) and those up to `reach` places before and after, each once."""
    marked = rows.join(wanted.select(group, order).distinct().withColumn("__w", F.lit(1)), [group, order], "left")
    near = F.max("__w").over(W.partitionBy(group).orderBy(order).rowsBetween(-reach, reach))
    return marked.withColumn("__near", near).where("__near = 1").drop("__w", "__near")


def hidden(all_rows: DataFrame, shown: DataFrame) -> DataFrame:
    """How many rows an exclusion hides, 0 at least."""
    return all_rows.agg(F.count("*").alias("a")).join(shown.agg(F.count("*").alias("b"))).select(F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("hidden"))
