"""Folding an ordered log of turns into exchanges, and what is derived from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fold_exchanges(turns: DataFrame, group: str, order: str, role: str, text: str, opens: Column | None = None) -> DataFrame:
    """group, seq, user_text, assistant_text, n_turns: a new exchange opens at each prompt; assistant texts are joined
    by a blank line, other roles' text is folded into the prompt by a line end; turns before the first prompt are
    dropped, and so are exchanges without text, whose numbers stay used.

    One group is ordered within a task; groups are conversations, bounded by their own length.
    """
    opens = F.col(role) == "user" if opens is None else opens
    seq = F.sum(F.when(opens, 1).otherwise(0)).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = turns.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"), seq.cast("long").alias("seq")).where("seq > 0")
    kept = lambda own: F.transform(F.array_sort(F.collect_list(F.when(own & F.col("t").isNotNull(), F.struct("o", "t")))), lambda x: x.t)
    said = F.col("r") == "assistant"
    out = rows.groupBy("g", "seq").agg(F.array_join(kept(~said), "\n").alias("user_text"), F.array_join(kept(said), "\n\n").alias("assistant_text"), F.count("*").alias("n_turns"))
    return out.where("trim(user_text) <> '' OR trim(assistant_text) <> ''").withColumnRenamed("g", group)


def last_values(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The last value of each column that is not null, in order."""
    return rows.groupBy(group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def pair_results(calls: DataFrame, results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Calls with the last result of the same keys, and whether any of its results was an error; results without a call
    are dropped."""
    last = results.groupBy(*keys).agg(F.max_by("result", order).alias("result"), F.max("is_error").alias("is_error"))
    return calls.join(last, keys, "left")


def census(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def chunks(units: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Greedy chunk number of each unit: a chunk closes when the next unit would exceed `most`. Each depends on the one
    before, so a group's ordered sizes, without its texts, are run over in one pass of a task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        chunk, used, out = 0, 0, []
        g = g.sort_values("o")
        for n in g["n"]:
            chunk, used = (chunk + 1, n) if used > 0 and used + n > most else (chunk, used + n)
            out.append(chunk)
        return pd.DataFrame({group: g["g"], order: g["o"], "chunk": out})

    rows = units.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    kind = {c: units.schema[c].dataType.simpleString() for c in (group, order)}
    return rows.groupBy("g").applyInPandas(run, f"{group} {kind[group]}, {order} {kind[order]}, chunk long")
