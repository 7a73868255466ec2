"""Upserts, replaced children, manifests, logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Old rows with the new ones put over them; of the columns in keep an old value outlives a null."""
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col("n.__n").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        fresh = F.coalesce(f"n.{c}", f"o.{c}") if c in keep else F.col(f"n.{c}")
        return F.when(there, fresh).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows after the given parents were read again: all of their old ones go."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def write_replacing(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that rows have. Children are written before their parents, so that a reader
    that starts from parents never meets one without children."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def to_copy(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, bytes, modified, content) whose size or time changed and whose content did too, with its digest."""
    known = manifest.select("path", F.col("bytes").alias("__b"), F.col("modified").alias("__m"), F.col("sha256").alias("__d"))
    rows = files.join(known, "path", "left").where(F.col("__b").isNull() | (F.col("__b") != F.col("bytes")) | (F.col("__m") != F.col("modified")))
    return rows.withColumn("sha256", F.sha2("content", 256)).where(F.col("__d").isNull() | (F.col("__d") != F.col("sha256"))).drop("__b", "__m", "__d")


def append_log(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def export_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("name"), F.to_json(F.struct("*")).alias("value"))


def export_markdown(exchanges: DataFrame, group: str, order: str, title: Column, most: int = 500) -> DataFrame:
    """name, value: a page for each group with its first exchanges (user_text, assistant_text)."""
    part = F.concat(F.lit("## "), F.col(order).cast("string"), F.lit("\n\n**You:** "), "user_text", F.lit("\n\n"), "assistant_text")
    listed = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t")))), 1, most)
    return exchanges.groupBy(F.col(group).cast("string").alias("name")).agg(F.concat(F.lit("# "), F.max(title), F.lit("\n\n"), F.array_join(F.transform(listed, lambda x: x.t), "\n\n"), F.lit("\n")).alias("value"))


def write_pages(pages: DataFrame, path: str) -> None:
    """One folder a name with its page as text, written by the tasks."""
    pages.write.mode("overwrite").partitionBy("name").text(path)
