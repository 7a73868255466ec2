"""What was lost, what survives and what goes next: one row from the files on disk, the prompt log and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import substantive
from quernstone.operators import ghosts as G
from quernstone.operators import sinks as K
from quernstone.operators.stats import sweep

#: What a harness that runs without a person calls itself.
SDK = "sdk-ts"


def audit(files: DataFrame, log: DataFrame, index: DataFrame, session: str, now: Column, period: int) -> DataFrame:
    """One row of counts.

    files: session, project, bytes, modified, title, entrypoint, is_sidechain; log: as `ghosts.prompt_log` gives it;
    index: session, is_sidechain. Sessions are those of any of the three, side chains left out; a deleted one has no
    file. Each session is one row before it is counted, so nothing is counted twice; the three tables meet in one
    shuffle by session."""
    own = files.where(~F.col("is_sidechain"))
    said = F.coalesce(F.exists("texts", lambda x: substantive(x.text)), F.lit(False))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    parts = [
        own.select(session, F.lit(True).alias("file"), zero.alias("prompts"), no.alias("logged"), no.alias("said")),
        log.select(session, no.alias("file"), F.col("prompts").cast("long").alias("prompts"), F.lit(True).alias("logged"), said.alias("said")),
        index.where(~F.col("is_sidechain")).select(session, no.alias("file"), zero.alias("prompts"), no.alias("logged"), no.alias("said")),
    ]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(session).agg(F.max("file").alias("file"), F.sum("prompts").alias("prompts"), F.max("logged").alias("logged"), F.max("said").alias("said"))
    gone = ~F.col("file")
    total = lambda own: F.coalesce(F.sum(F.when(own, F.col("prompts"))), F.lit(0))
    sessions = each.agg(
        F.count("*").alias("sessions_ever"), F.count_if("file").alias("on_disk"), F.count_if(gone).alias("deleted"), total(gone).alias("prompts_lost"), total(F.col("file")).alias("prompts_surviving"),
        F.count_if(gone & F.col("logged") & ~F.col("said")).alias("deleted_without_title"), F.count_if("logged").alias("logged"), F.count_if(F.col("logged") & F.col("file")).alias("logged_on_disk"),
    )
    times = log.agg(F.min("first_ts").alias("log_first_ts"), F.max("last_ts").alias("log_last_ts"))
    due = sweep(files, F.col("modified"), now, period).withColumn("own", ~F.col("is_sidechain"))
    on_disk = due.agg(
        F.count_if("own").alias("files"), F.count_if("is_sidechain").alias("sidechain_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.countDistinct(F.when(F.col("own"), F.col("project"))).alias("projects"),
        F.count_if(F.col("own") & (F.col("entrypoint") == SDK)).alias("sdk_sessions"), F.count_if(F.col("own") & (F.coalesce("title", F.lit("")) != "")).alias("titled_sessions"),
        F.count_if(F.col("own") & (F.col("days_left") <= 7)).alias("within_7"), F.count_if(F.col("own") & (F.col("days_left") <= 1)).alias("within_1"),
    )
    return sessions.join(times).join(on_disk)  # one row each


def ghost_pass(log: DataFrame, on_disk: DataFrame, index: DataFrame, held: DataFrame, held_prompts: DataFrame, session: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ghosts table and its prompts after a pass, and one row of what the pass did.

    held: session, title, message_count, branch, prompts of earlier passes; held_prompts: id, session, seq, ts, text. A
    ghost's count and branch outlive a null; its prompts are replaced as a whole; ghosts of earlier passes stay, unless
    their session has come back to disk."""
    columns = [session, "title", "message_count", "branch", "prompts"]
    found = G.rebuild(log, on_disk, index, session)
    back = on_disk.select(session).distinct()
    ghosts = K.upsert(held.select(*columns), found.select(*columns), session, ["message_count", "branch"]).join(back, session, "left_anti")
    prompts = K.replace_children(held_prompts, G.ghost_prompts(found, session), found, session).join(back, session, "left_anti")
    written = ~F.col("title").startswith("session ")  # a title that says more than the id
    done = ghosts.agg(F.count("*").alias("ghosts"), F.count_if(written).alias("titled"), F.coalesce(F.sum("prompts"), F.lit(0)).alias("prompts"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("messages"))
    return ghosts, prompts, done.join(held.join(back, session, "left_semi").agg(F.count("*").alias("came_back")))
