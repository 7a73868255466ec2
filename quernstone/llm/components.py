"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool, most_rows: int) -> DataFrame:
    """edges: a > b. Large: every larger neighbour of a node is linked to the node's least one. Small: the node and
    its smaller neighbours are."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    # stored, so that both sides of the join are plain shuffles, of which a hot node's partition can be split
    least = stored(sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least(F.col("a"), F.col("m")).alias("m")), most_rows)
    joined = sides.join(least, sides.a == least.of)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node of edges (two columns of one ordered type).

    Loops, repeated edges and edges with a null end are allowed and ignored. No node's links meet in one task: least
    neighbours are aggregated before the shuffle and joins may split a node's rows.
    """
    ends = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now = stored(ends.where("a > b").distinct())
    state = None
    for _ in range(most_rounds):
        after = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if state == after or after.n == 0:
            break
        state = after
        now = stored(_star(_star(now, True, 2 * after.n), False, 2 * after.n), 2 * after.n)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
