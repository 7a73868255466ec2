"""Counts by harness and project, the loss audit, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the order in which harnesses are listed.
HARNESSES = ["claude", "codex", "cursor", "pi", "gemini", "copilot", "opencode"]


def harness_stats(sessions: DataFrame, exchanges: DataFrame, harness: str, key: str, foreign: str, sums: dict[str, Column], first: Column, last: Column) -> DataFrame:
    """One row for a harness: sums of conditions and counts, first and last time, and the number of exchanges, which
    are counted per session before the join."""
    per = exchanges.groupBy(F.col(foreign).alias("__of")).agg(F.count("*").alias("__n"))
    rows = sessions.join(per, sessions[key] == F.col("__of"), "left")
    return rows.groupBy(harness).agg(F.count("*").alias("sessions"), *[F.sum(c).alias(n) for n, c in sums.items()], F.coalesce(F.sum("__n"), F.lit(0)).alias("exchanges"), F.min(first).alias("first_ts"), F.max(last).alias("last_ts"))


def with_ghosts(stats: DataFrame, ghosts: DataFrame, harness: str) -> DataFrame:
    """Full outer merge of live and ghost counts (harness, ghosts, first_ts, last_ts); missing counts are 0."""
    g = ghosts.select(F.col(harness).alias("__h"), "ghosts", F.col("first_ts").alias("__f"), F.col("last_ts").alias("__l"))
    both = stats.join(g, stats[harness] == F.col("__h"), "full_outer")
    counts = [c for c in stats.columns if c not in (harness, "first_ts", "last_ts")]
    return both.select(F.coalesce(harness, "__h").alias(harness), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("ghosts", F.lit(0)).alias("ghosts"), F.least("first_ts", "__f").alias("first_ts"), F.greatest("last_ts", "__l").alias("last_ts"))


def with_total(rows: DataFrame, by: str, sums: list[str], total: str = "total") -> DataFrame:
    """The rows' sums and one more row with those of all, in one grouping-sets pass."""
    name = F.when(F.grouping(by) == 1, F.lit(total)).otherwise(F.col(by)).alias("name")
    return rows.rollup(by).agg(name, *[F.sum(c).alias(c) for c in sums]).drop(by).withColumnRenamed("name", by)


def enum_order(value: Column, order: list[str] = HARNESSES) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(99)


def ever_and_deleted(key: str, on_disk: DataFrame, *others: DataFrame) -> DataFrame:
    """key, deleted: every id that one of the sources knows, and whether it is off the disk."""
    every = on_disk.select(key)
    for o in others:
        every = every.union(o.select(key))
    there = on_disk.select(key).distinct().withColumn("__there", F.lit(True))
    return every.distinct().join(there, key, "left").select(key, F.col("__there").isNull().alias("deleted"))


def project_totals(log: DataFrame, on_disk: DataFrame, key: str, project: str) -> DataFrame:
    """project, total, alive, prompts (lost), last_ts. log: key, project, prompts, last_ts; on_disk: key, project.

    A logged session counts under its logged project (blank or null: `unknown`), one that only the disk has under the
    disk's; a session on disk also counts as alive under the disk's project.
    """
    named = log.select(key, F.coalesce(F.nullif(F.trim(project), F.lit("")), F.lit("unknown")).alias("project"), "prompts", "last_ts")
    disk = on_disk.select(key).distinct().withColumn("__there", F.lit(1))
    logged = named.join(disk, key, "left").select("project", F.lit(1).alias("total"), F.coalesce("__there", F.lit(0)).alias("alive"), F.when(F.col("__there").isNull(), F.col("prompts")).otherwise(0).alias("prompts"), "last_ts")
    known = named.select(key, F.lit(1).alias("__known")).distinct()
    live = on_disk.select(key, F.col(project).alias("project")).join(known, key, "left").select("project", F.when(F.col("__known").isNull(), 1).otherwise(0).alias("total"), F.lit(1).alias("alive"), F.lit(0).cast("long").alias("prompts"), F.lit(None).cast(named.schema["last_ts"].dataType).alias("last_ts"))
    return logged.union(live).groupBy("project").agg(F.sum("total").alias("total"), F.sum("alive").alias("alive"), F.sum("prompts").alias("prompts"), F.max("last_ts").alias("last_ts"))


def ancestors(path: Column) -> Column:
    """Every proper ancestor of a slash path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def roll_up_wiped(totals: DataFrame) -> DataFrame:
    """owner, sessions, prompts, last_ts of the projects of which nothing is left.

    A wiped project under a living one goes with it and is not listed; one under another wiped project is counted
    there (the longest such). Folders with two or more projects below them are containers and neither shield nor own.
    Paths are joined with their own ancestors by equality, so no pair of unrelated projects meets.
    """
    rows = totals.where("total > 0").select("project", "alive", F.col("total"), "prompts", "last_ts")
    above = rows.where(F.size(F.split("project", "/")) > 1).select(F.col("project").alias("child"), F.explode(ancestors(F.col("project"))).alias("above")).where("above <> ''")
    names = rows.select(F.col("project").alias("above"), "alive")
    known = above.join(names, "above")
    containers = known.groupBy("above").agg(F.count("*").alias("n")).where("n >= 2").select("above")
    telling = known.join(containers, "above", "left_anti")
    shielded = telling.where("alive > 0").select(F.col("child").alias("project")).distinct()
    owners = telling.where("alive = 0").groupBy("child").agg(F.max_by("above", F.length("above")).alias("owner"))
    wiped = rows.where("alive = 0").join(shielded, "project", "left_anti").join(owners, F.col("project") == F.col("child"), "left")
    return wiped.groupBy(F.coalesce("owner", "project").alias("owner")).agg(F.sum("total").alias("sessions"), F.sum("prompts").alias("prompts"), F.max("last_ts").alias("last_ts"))


def sweep(rows: DataFrame, modified: Column, now: Column, period: int) -> DataFrame:
    """days_left until each file is older than the period, in whole days."""
    return rows.withColumn("days_left", F.lit(period) - F.floor((F.unix_millis(now) - F.unix_millis(modified)) / 86_400_000))


def sweep_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("days_left") <= 7).alias("within_7"), F.count_if(F.col("days_left") <= 1).alias("within_1"))


def retention(user: Column, local: Column, managed: Column, default: int = 30) -> Column:
    """The managed setting before the local before the user's."""
    return F.coalesce(managed, local, user, F.lit(default))


def freshness(sessions: DataFrame, files: DataFrame, path: str, indexed: str, modified: str) -> DataFrame:
    """fresh, stale and missing sessions against a file listing (path, modified)."""
    there = files.select(F.col(path).alias("__p"), F.col(modified).alias("__m"))
    rows = sessions.join(there, sessions[path] == F.col("__p"), "left")
    state = F.when(F.col("__p").isNull(), "missing").when(F.col("__m") > F.col(indexed), "stale").otherwise("fresh")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def fingerprint(rows: DataFrame, parts: list[str], group: str | None = None) -> DataFrame:
    """One digest of a file listing that changes when any line does. The lines' digests are added up in four parts of 60
    bits, so that no task holds a group's lines and their order doesn't matter."""
    line = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    hashed = rows.select(*([group] if group else []), line.alias("__h"))
    sums = [F.sum(F.conv(F.substring("__h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).cast("string") for i in range(4)]
    digest = F.sha2(F.concat_ws(":", *sums), 256).alias("fingerprint")
    return (hashed.groupBy(group) if group else hashed.groupBy()).agg(digest, F.count("*").alias("n"))


def map_sum(rows: DataFrame, counts: str) -> DataFrame:
    """Adds up a column of maps by key."""
    return rows.select(F.explode(counts).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))


def type_census(rows: DataFrame, keys: list[str], novel: Column) -> DataFrame:
    """Record types by count, novel ones first."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(novel).alias("novel")).orderBy(F.desc("novel"), F.desc("n"), *keys)
