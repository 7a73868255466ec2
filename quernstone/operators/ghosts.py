"""Sessions that only a prompt log remembers, rebuilt by set difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import derived_title, substantive

MOST_CHARS = 8_000


def prompt_log(rows: DataFrame, session: str, at: str, text: str, project: str, order: str) -> DataFrame:
    """Sessions of a prompt log: session, project (first non-empty), prompts, first_ts, last_ts, first_prompt (first
    non-empty in file order, cut), texts (by time, file order on ties). Rows without a session are left out."""
    cut = F.substring(text, 1, MOST_CHARS)
    said, named = F.col(text) != "", F.col(project) != ""
    listed = F.transform(F.array_sort(F.collect_list(F.when(said, F.struct(F.col(at).alias("ts"), F.col(order).alias("o"), cut.alias("text"))))), lambda x: F.struct(x.ts.alias("ts"), x.text.alias("text")))
    own = rows.where(F.col(session).isNotNull() & (F.col(session).cast("string") != ""))
    return own.groupBy(session).agg(
        F.min_by(F.when(named, F.col(project)), F.when(named, F.col(order))).alias("project"),
        F.count("*").alias("prompts"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"),
        F.min_by(cut, F.when(said, F.col(order))).alias("first_prompt"), listed.alias("texts"),
    )


def orphans(rows: DataFrame, session: str) -> DataFrame:
    return rows.where(F.col(session).isNull() | (F.col(session).cast("string") == "")).agg(F.count("*").alias("n"))


def rebuild(log: DataFrame, on_disk: DataFrame, index: DataFrame, session: str, order: str | None = None) -> DataFrame:
    """Ghosts: logged sessions that are not on disk, with a title: the index's summary, else the first substantive
    prompt, cut, else the id. index: session, summary, message_count, branch; of an id the first row by `order` counts
    (without one the least row, so that the result is the same each time)."""
    fields = F.struct("summary", "message_count", "branch")
    first = index.groupBy(session).agg(F.min_by(fields, F.col(order) if order else fields).alias("x")).select(session, "x.*")
    gone = log.join(on_disk.select(session).distinct(), session, "left_anti").join(first, session, "left")
    good = F.filter("texts", lambda x: substantive(x.text))
    title = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), derived_title(F.get(good, F.lit(0)).text), F.concat(F.lit("session "), F.substring(F.col(session).cast("string"), 1, 8)))
    return gone.withColumn("title", title)


def ghost_prompts(ghosts: DataFrame, session: str) -> DataFrame:
    """id, session, seq (from 0), ts, text."""
    rows = ghosts.select(session, F.posexplode("texts").alias("seq", "x"))
    return rows.select(F.concat_ws(":", F.col(session).cast("string"), "seq").alias("id"), session, "seq", "x.ts", "x.text")


def ghost_fingerprint(prompts: DataFrame, version: int) -> DataFrame:
    return prompts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"), F.lit(version).alias("version"))
