"""Registered queries on folding, filters, browsing, statistics and audits, and the same in plain SQL.

Orders stand for sessions (project o_custkey, harness o_orderpriority, status o_orderstatus), their lines for
exchanges, events for a prompt log, labels for tags, orders without lines for ghosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import audit as AU
from quernstone.operators import browse as B
from quernstone.operators import filters as P
from quernstone.operators import fold as X
from quernstone.operators import ghosts as G
from quernstone.operators import sinks as K
from quernstone.operators import stats as A
from quernstone.operators.deal import dealt
from quernstone.operators.stored import kept
from quernstone.plans.tables import table
from quernstone.sources import jsonl as J
from quernstone.streaming import sessions as S

day = lambda c: F.date_format(c, "yyyy-MM-dd")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("ended", F.expr("CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + make_dt_interval(o_orderkey % 20) END"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")


def folded(spark: SparkSession, d: str) -> DataFrame:
    return X.fold_exchanges(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


def x1_fold_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).select("conv_id", "seq", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"), "n_turns", T.exchange_id(F.col("conv_id"), F.col("seq")).alias("id"))


def m0_top_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = folded(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_exchanges"), F.sum(F.char_length("user_text") + F.char_length("assistant_text")).alias("chars"))
    return rows.orderBy(F.desc("n_exchanges"), "conv_id").limit(10)


def x4_paired_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    calls = e.where("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_id").alias("call"))
    results = e.where("event_type = 'view'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_id").alias("at"), F.col("value").alias("result"), (F.col("value") > 20).alias("is_error"))
    return X.pair_results(calls, results, ["user_id", "k"], "at").select("call", "result", "is_error")


def x5_last_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("last_error"), F.when(F.col("value") > 10, F.col("event_type")).alias("last_type"))
    return X.last_values(rows, "user_id", "event_id", ["last_error", "last_type"])


def x7_type_census(spark: SparkSession, d: str) -> DataFrame:
    return A.type_census(table(spark, d, "events"), ["event_type"], F.col("event_type") == "error").select("event_type", "n", "novel")


def w6_greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "conversations").select("conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    return X.chunks(units, "conv_id", "turn", "size", 400)


def f1_point(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where(P.point_between(F.col("l_shipdate"), "1997-01-01", "1997-03-31")).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def f2_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).where(P.overlaps(F.col("o_orderdate"), F.col("ended"), "1997-01-05", "1997-02-05")).select("o_orderkey")


def f3_equalities(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).where(P.all_of([F.col("o_orderstatus") == "F", None, P.equal_or_like(F.col("o_orderpriority"), "*urgent"), F.col("o_custkey") < 300])).select("o_orderkey")


def f5_array_like(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("files"))
    return rows.where(P.any_like(F.col("files"), "*ING") | P.any_like(F.col("files"), "dge")).select("p_partkey")


def f7_tag_semi(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return P.matching(table(spark, d, "documents"), tags, "doc_id").select("doc_id", "source")


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return dealt(rows, ["a", "b"], rows.count()).distinct()


def f9_linked_undirected(spark: SparkSession, d: str) -> DataFrame:
    return P.linked_to(table(spark, d, "part"), edges(spark, d), "p_partkey", "a", "b", 7).select("p_partkey", "p_name")


def j15_links(spark: SparkSession, d: str) -> DataFrame:
    return B.links_of(edges(spark, d), "a", "b", 7)


def f10_untitled_anti(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "labels").where("toxic = 0").select("doc_id")
    return P.without(table(spark, d, "documents").where(F.coalesce("n_chars", F.lit(0)) < 500), cards, "doc_id").select("doc_id", "n_chars")


def f12_exclude_null_safe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").where("n_chars > 400").select("doc_id", "lang"), "doc_id", "left")
    return rows.where(P.not_in_or_null(F.col("lang"), ["en", "de"])).groupBy("lang").agg(F.count("*").alias("n"))


def family(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).select("o_orderkey", F.expr("CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 3 WHEN o_orderkey % 10 = 5 THEN -o_orderkey END").alias("parent"))


def f13_tri_state(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("parent").isNotNull()
    return family(spark, d).agg(*[F.count_if(P.tri_state(flag, m)).alias(f"n_{m}") for m in ("include", "only", "exclude")])


def f15_rollup_orphans(spark: SparkSession, d: str) -> DataFrame:
    return P.roll_up(family(spark, d), "o_orderkey", "parent", F.col("parent").isNotNull()).select("o_orderkey")


def f16_ignored(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").where(P.ignored(path, ["DE", "therha.example.com"])).select("page_id")


def f18_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus"))
    return P.resolve_prefix(rows, "id", "149", F.col("o_orderstatus") == "O").select("id")


def f19_project_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("?"), F.lit(1)).alias("path"))
    return P.resolve_name(rows, "path", "25").select("path", F.col("tier").cast("int").alias("tier"))


def f20_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.lit("ring"), F.lit("brand#2"))
    return table(spark, d, "part").where(F.exists(words, lambda t: F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand")), t))).select("p_partkey")


def f23_min_size(spark: SparkSession, d: str) -> DataFrame:
    counts = lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return P.at_least(sessions(spark, d), counts, "o_orderkey", "n", 6).select("o_orderkey")


def f24_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(P.holds_marker(F.col("text"), ["license", "token ="])).select("doc_id")


def j4_card_owner(spark: SparkSession, d: str) -> DataFrame:
    """Cards with their owner from sessions, else from ghosts."""
    cards = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    live = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("live"))
    gone = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("gone"))
    return cards.join(live, "id", "left").join(gone, "id", "left").select("id", F.coalesce("live", "gone").alias("owner"))


def ghosts(spark: SparkSession, d: str) -> DataFrame:
    return P.without(sessions(spark, d), lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def j6_ghost_anti(spark: SparkSession, d: str) -> DataFrame:
    return ghosts(spark, d).select("o_orderkey", "o_custkey")


def logged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat_ws(" ", F.lit("please handle the next"), "event_type")).alias("display"), F.when(F.col("value") > 5, F.concat(F.lit("/w/p"), F.pmod("user_id", F.lit(9)))).otherwise("").alias("project"))
    return G.prompt_log(rows, "user_id", "ts", "display", "project", "event_id")


def s14_prompt_log(spark: SparkSession, d: str) -> DataFrame:
    return logged(spark, d).select("user_id", "project", "prompts", "first_ts", "last_ts", "first_prompt", F.size("texts").alias("n_texts"))


def on_disk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("user_id"), F.concat(F.lit("/w/p"), F.pmod("s_suppkey", F.lit(11))).alias("project"))


def index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("summary"), F.col("c_nationkey").alias("message_count"), F.col("c_mktsegment").alias("branch"))


def g1_ghosts(spark: SparkSession, d: str) -> DataFrame:
    return G.rebuild(logged(spark, d), on_disk(spark, d), index(spark, d), "user_id").select("user_id", "title", "message_count", "prompts")


def g1_ghost_prompts(spark: SparkSession, d: str) -> DataFrame:
    found = G.rebuild(logged(spark, d), on_disk(spark, d), index(spark, d), "user_id")
    return G.ghost_prompts(found, "user_id").select("id", "ts", F.md5("text").alias("text_md5"))


def a13_ghost_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    found = G.rebuild(logged(spark, d), on_disk(spark, d), index(spark, d), "user_id")
    return G.ghost_fingerprint(G.ghost_prompts(found, "user_id"), 3)


def j7_ever_deleted(spark: SparkSession, d: str) -> DataFrame:
    return A.ever_and_deleted("user_id", on_disk(spark, d), logged(spark, d), index(spark, d))


def audited_files(spark: SparkSession, d: str) -> DataFrame:
    return on_disk(spark, d).selectExpr("user_id", "project", "user_id * 10 AS bytes", "timestamp_seconds(1700000000 + user_id * 7200) AS modified", "CASE WHEN user_id % 5 = 0 THEN 't' WHEN user_id % 5 = 1 THEN '' END AS title", "CASE WHEN user_id % 4 = 0 THEN 'sdk-ts' ELSE 'cli' END AS entrypoint", "user_id % 7 = 0 AS is_sidechain")


def a5_audit(spark: SparkSession, d: str) -> DataFrame:
    known = index(spark, d).select("user_id", (F.col("user_id") % 3 == 0).alias("is_sidechain"))
    return AU.audit(audited_files(spark, d), logged(spark, d), known, "user_id", F.expr("timestamp_seconds(1702000000)"), 30)


def passed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pass over a table that has every third customer as a ghost of an earlier pass, with one old prompt each."""
    held = table(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS user_id", "'old' AS title", "c_nationkey AS message_count", "'b' AS branch", "CAST(1 AS LONG) AS prompts")
    old = held.selectExpr("concat(user_id, ':0') AS id", "user_id", "0 AS seq", "CAST(0 AS LONG) AS ts", "'gone' AS text")
    return AU.ghost_pass(logged(spark, d), on_disk(spark, d), index(spark, d), held, old, "user_id")


def k3_ghost_pass(spark: SparkSession, d: str) -> DataFrame:
    return passed(spark, d)[0].select("user_id", "title", "message_count", "branch", "prompts")


def k3_ghost_prompts(spark: SparkSession, d: str) -> DataFrame:
    return passed(spark, d)[1].groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def h6_pass_totals(spark: SparkSession, d: str) -> DataFrame:
    return passed(spark, d)[2]


def a6_project_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.project_totals(logged(spark, d).select("user_id", "project", "prompts", "last_ts"), on_disk(spark, d), "user_id", "project")


def j10_path_rollup(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("?"), F.lit(1)), "#.*$", "")
    parts = F.split(path, "/")
    rows = table(spark, d, "pages").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("project"), F.when(F.col("page_id") % 9 == 0, 1).otherwise(0).alias("alive"))
    totals = rows.groupBy("project").agg(F.max("alive").cast("long").alias("alive"), F.count("*").alias("total")).select("project", "total", "alive", F.col("total").alias("prompts"), F.lit(1).cast("long").alias("last_ts"))
    return A.roll_up_wiped(totals).select("owner", "sessions", "prompts")


def j9_conversation_key(spark: SparkSession, d: str) -> DataFrame:
    return B.conversation_keys(family(spark, d), "o_orderkey", "parent")


def g9_link_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return B.shared_pairs(rows, "l_orderkey", "l_partkey", 2, 200, rows.where("false").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")))


def j17_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return B.with_neighbours(rows, rows.where("q >= 50"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


def stats(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.when(c, 1).otherwise(0)
    sums = {"live": one(F.col("o_orderstatus") == "O"), "archived": one(F.col("o_orderstatus") == "F"), "titled": one((F.col("o_orderkey") % 5 > 0) & F.col("ended").isNotNull())}
    return A.harness_stats(sessions(spark, d), lines(spark, d), "o_orderpriority", "o_orderkey", "l_orderkey", sums, F.col("o_orderdate"), F.coalesce("ended", "o_orderdate"))


def a1_harness_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).withColumns({"first_ts": day("first_ts"), "last_ts": day("last_ts")})


def ghost_stats(spark: SparkSession, d: str) -> DataFrame:
    return ghosts(spark, d).groupBy(F.concat("o_orderpriority", F.when(F.col("o_orderpriority").startswith("5"), "-OLD").otherwise("")).alias("o_orderpriority")).agg(F.count("*").alias("ghosts"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"))


def a3_merged(spark: SparkSession, d: str) -> DataFrame:
    return A.with_ghosts(stats(spark, d), ghost_stats(spark, d), "o_orderpriority").withColumns({"first_ts": day("first_ts"), "last_ts": day("last_ts")})


def a3_grand_total(spark: SparkSession, d: str) -> DataFrame:
    return A.with_total(A.with_ghosts(stats(spark, d), ghost_stats(spark, d), "o_orderpriority"), "o_orderpriority", ["sessions", "exchanges", "ghosts"])


def a4_freshness(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey"), F.expr("timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(c_custkey % 900)").alias("modified"))
    return A.freshness(sessions(spark, d), files, "o_custkey", "o_orderdate", "modified")


def swept(spark: SparkSession, d: str) -> DataFrame:
    return A.sweep(sessions(spark, d), F.col("o_orderdate").cast("timestamp"), F.lit("1998-10-10 12:00:00").cast("timestamp"), 30)


def a7_sweep_countdown(spark: SparkSession, d: str) -> DataFrame:
    return swept(spark, d).where("days_left BETWEEN 0 AND 7").select("o_orderkey", "days_left")


def a5_sweep_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.sweep_counts(swept(spark, d))


def a8_map_sum(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("types"))
    return A.map_sum(per, "types")


def a9_tag_hist(spark: SparkSession, d: str) -> DataFrame:
    return B.histogram(table(spark, d, "documents"), "source")


def a10_tags_per_session(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))


def a11_project_counts(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("project")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("project")))
    return both.groupBy("project").agg(F.count("*").alias("n"))


def a14_source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions(spark, d).select("o_orderpriority", "o_orderkey", "o_custkey", "o_orderstatus")
    return A.fingerprint(rows, ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderpriority")


def u2_distinct_projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("project")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def u5_tag_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return B.tag_arrays(rows, "tags", ["kept", "red"], ["small", "widget"]).select("p_partkey", F.array_join("tags", ",").alias("tags"))


def k6_tag_changes(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("tag"))
    add = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag"))
    remove = table(spark, d, "documents").where("n_chars < 300").select("doc_id", F.lit("q0").alias("tag"))
    return B.tag_changes(tags, "doc_id", "tag", add, remove)


def k6_link_changes(spark: SparkSession, d: str) -> DataFrame:
    e = kept(edges(spark, d))
    return B.link_changes(e, "a", "b", e.select(F.col("b").alias("a"), F.col("a").alias("b")), e.where("a % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


def p1_session_row(spark: SparkSession, d: str) -> DataFrame:
    return B.with_counts(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", n_orders=(table(spark, d, "orders"), "o_custkey"), n_lines=(table(spark, d, "lineitem"), "l_partkey"))


def p2_first_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    good = (F.col("role") == "user") & (F.char_length("text") > 30) & ~F.col("text").startswith("/")
    return B.first_by(rows, "conv_id", "turn", F.col("text"), good, "first_prompt").select("conv_id", F.md5("first_prompt").alias("prompt_md5"))


def p3_look_up(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("id")).distinct()
    live = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.lit("session").alias("kind"))
    return B.look_up(wanted, "id", live, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("ghost").alias("kind")))


def p4_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", T.display_title(F.when(F.col("p_size") > 40, F.col("p_name")), F.when(F.col("p_size") > 20, F.lit("  ")).otherwise(F.col("p_type")), F.col("p_brand"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("title"))
    return rows


def p5_last_segment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.last_segment(F.split_part("url", F.lit("?"), F.lit(1))).alias("segment"))


def p6_resume_command(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions(spark, d)
    command = F.when(F.col("o_orderstatus") == "F", F.lit(None)).when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("open "), "o_orderkey")).otherwise(F.concat(F.lit("resume "), "o_orderkey"))
    return rows.select("o_orderkey", command.alias("command"))


def w7_last_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.last_rows(lines(spark, d), "l_orderkey", "l_linenumber", 2).select("l_orderkey", "l_linenumber")


def w8_slice(spark: SparkSession, d: str) -> DataFrame:
    return B.slice_rows(lines(spark, d), "l_orderkey", "l_linenumber", 2, 3).select("l_orderkey", "l_linenumber", "place")


def o1_merged_branches(spark: SparkSession, d: str) -> DataFrame:
    live = sessions(spark, d).select(F.col("o_orderkey").alias("id"), F.coalesce("ended", "o_orderdate").alias("at"), F.lit("session").alias("kind"))
    gone = lines(spark, d).where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.lit("ghost").alias("kind"))
    return B.merged_page([live, gone], [F.desc("at"), F.col("id"), F.col("kind")], 20, 10).select("id", "kind", day("at").alias("day"))


def h4_hidden(spark: SparkSession, d: str) -> DataFrame:
    return B.hidden(sessions(spark, d), sessions(spark, d).where("o_custkey >= 100"))


def t2_incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Files to read: not in the manifest with the same size and time."""
    now = sessions(spark, d).select("o_orderkey", F.col("o_custkey").alias("bytes"), day("o_orderdate").alias("modified"))
    manifest = now.where("o_orderkey % 3 > 0").withColumn("bytes", F.when(F.col("o_orderkey") % 10 == 1, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return now.join(manifest, ["o_orderkey", "bytes", "modified"], "left_anti").select("o_orderkey")


def k1_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_custkey % 3 > 0").select("c_custkey", "c_name", "c_mktsegment")
    new = table(spark, d, "customer").where("c_custkey % 3 < 2").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")).alias("c_mktsegment"))
    return K.upsert(old, new, "c_custkey", ["c_mktsegment"])


def k2_replace_children(spark: SparkSession, d: str) -> DataFrame:
    old = lines(spark, d).select("l_orderkey", "l_linenumber")
    new = old.where("l_orderkey % 5 = 0 AND l_linenumber < 3")
    return K.replace_children(old, new, sessions(spark, d).where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def t6_session_windows(spark: SparkSession, d: str) -> DataFrame:
    found = S.session_counts(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def s20_sections(spark: SparkSession, d: str) -> DataFrame:
    value = F.regexp_replace("text", r"(^|\n)(\S+)", "$1# $2")
    return J.markdown_sections(table(spark, d, "benchmark").select(F.concat(F.lit("/notes/"), "item_id").alias("path"), F.concat(F.lit("x\n"), value, F.lit("\nbody")).alias("value"))).select("path", "line", "heading", "text")


FOLD = """WITH n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
f AS (SELECT conv_id, CAST(seq AS BIGINT) AS seq, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS u, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS a, count(*) AS n_turns FROM n WHERE seq > 0 GROUP BY conv_id, seq),
x AS (SELECT * FROM f WHERE trim(u, ' ') <> '' OR trim(a, ' ') <> '')"""
SESS = "(SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) END AS ended FROM orders)"
EDGE = "(SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)"
FAM = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 3 WHEN o_orderkey % 10 = 5 THEN -o_orderkey END AS parent FROM orders)"
GHOST = "(SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))"
BARE = "regexp_replace(url, '^https?://', '')"
LOG = """ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts, CASE WHEN event_type = 'error' THEN '' ELSE 'please handle the next ' || event_type END AS display, CASE WHEN value > 5 THEN '/w/p' || (user_id % 9) ELSE '' END AS project FROM events WHERE user_id IS NOT NULL),
log AS (SELECT user_id, arg_min(project, event_id) FILTER (WHERE project <> '') AS project, count(*) AS prompts, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(display, event_id) FILTER (WHERE display <> '') AS first_prompt, list(display ORDER BY ts, event_id) FILTER (WHERE display <> '') AS texts, list(ts ORDER BY ts, event_id) FILTER (WHERE display <> '') AS times FROM ev GROUP BY user_id),
disk AS (SELECT s_suppkey AS user_id, '/w/p' || (s_suppkey % 11) AS project FROM supplier WHERE s_suppkey % 3 > 0),
idx AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS summary, c_nationkey AS message_count FROM customer WHERE c_custkey % 2 = 0),
gh AS (SELECT log.*, summary, message_count FROM log LEFT JOIN idx USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM disk)),
gp AS (SELECT user_id, unnest(texts) AS text, unnest(times) AS ts, generate_subscripts(texts, 1) - 1 AS seq FROM gh)"""
STATS = f"""st AS (SELECT o_orderpriority, count(*) AS sessions, CAST(sum(CAST(o_orderstatus = 'O' AS INT)) AS BIGINT) AS live, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS archived, CAST(sum(CAST(o_orderkey % 5 > 0 AND ended IS NOT NULL AS INT)) AS BIGINT) AS titled, CAST(coalesce(sum(n), 0) AS BIGINT) AS exchanges, min(o_orderdate) AS f, max(coalesce(ended, o_orderdate)) AS l
  FROM {SESS} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1),
gs AS (SELECT o_orderpriority || CASE WHEN o_orderpriority LIKE '5%' THEN '-OLD' ELSE '' END AS h, count(*) AS ghosts, min(o_orderdate) AS gf, max(o_orderdate) AS gl FROM {GHOST} GROUP BY 1),
mg AS (SELECT coalesce(o_orderpriority, h) AS o_orderpriority, coalesce(sessions, 0) AS sessions, coalesce(live, 0) AS live, coalesce(archived, 0) AS archived, coalesce(titled, 0) AS titled, coalesce(exchanges, 0) AS exchanges, coalesce(ghosts, 0) AS ghosts, least(f, gf) AS f, greatest(l, gl) AS l FROM st FULL JOIN gs ON h = o_orderpriority)"""
SWEEP = "(SELECT o_orderkey, CAST(30 - floor((epoch_ms(TIMESTAMP '1998-10-10 12:00:00') - epoch_ms(o_orderdate)) / 86400000) AS BIGINT) AS days_left FROM orders)"
YMD = "strftime({0}, '%Y-%m-%d')"

QUERIES = {f.__name__: f for f in (
    x1_fold_exchanges, m0_top_conversations, x4_paired_results, x5_last_values, x7_type_census, w6_greedy_chunks, f1_point, f2_interval_overlap, f3_equalities, f5_array_like, f7_tag_semi, f9_linked_undirected, j15_links, f10_untitled_anti, f12_exclude_null_safe, f13_tri_state, f15_rollup_orphans, f16_ignored, f18_prefix, f19_project_tiers, f20_title_tokens, f23_min_size, f24_markers, j4_card_owner, j6_ghost_anti, s14_prompt_log, g1_ghosts, g1_ghost_prompts, a13_ghost_fingerprint, j7_ever_deleted, a5_audit, k3_ghost_pass, k3_ghost_prompts, h6_pass_totals, a6_project_totals, j10_path_rollup, j9_conversation_key, g9_link_pairs, j17_neighbours, a1_harness_stats, a3_merged, a3_grand_total, a4_freshness, a7_sweep_countdown, a5_sweep_counts, a8_map_sum, a9_tag_hist, a10_tags_per_session, a11_project_counts, a14_source_fingerprint, u2_distinct_projects, u5_tag_arrays, k6_tag_changes, k6_link_changes, p1_session_row, p2_first_prompt, p3_look_up, p4_titles, p5_last_segment, p6_resume_command, w7_last_rows, w8_slice, o1_merged_branches, h4_hidden, t2_incremental_skip, k1_upsert, k2_replace_children, t6_session_windows, s20_sections,
)}
ORACLE_SQL = {
    "x1_fold_exchanges": f"{FOLD} SELECT conv_id, seq, md5(u) AS user_md5, md5(a) AS assistant_md5, n_turns, substr(sha256(conv_id || ':' || seq), 1, 32) AS id FROM x",
    "m0_top_conversations": f"{FOLD} SELECT conv_id, count(*) AS n_exchanges, CAST(sum(length(u) + length(a)) AS BIGINT) AS chars FROM x GROUP BY 1 ORDER BY n_exchanges DESC, conv_id LIMIT 10",
    "x4_paired_results": "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), r AS (SELECT user_id, k, arg_max(value, event_id) AS result, bool_or(value > 20) AS is_error FROM e WHERE event_type = 'view' GROUP BY 1, 2) SELECT event_id AS call, result, is_error FROM e LEFT JOIN r USING (user_id, k) WHERE event_type = 'click'",
    "x5_last_values": "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS last_error, arg_max(event_type, event_id) FILTER (WHERE value > 10) AS last_type FROM events GROUP BY user_id",
    "x7_type_census": "SELECT event_type, count(*) AS n, event_type = 'error' AS novel FROM events GROUP BY event_type",
    "w6_greedy_chunks": """WITH RECURSIVE u AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g AS (SELECT conv_id, turn, i, n AS used, CAST(0 AS BIGINT) AS chunk FROM u WHERE i = 1 UNION ALL SELECT u.conv_id, u.turn, u.i, CASE WHEN g.used > 0 AND g.used + u.n > 400 THEN u.n ELSE g.used + u.n END, CASE WHEN g.used > 0 AND g.used + u.n > 400 THEN g.chunk + 1 ELSE g.chunk END FROM g JOIN u ON u.conv_id = g.conv_id AND u.i = g.i + 1)
SELECT conv_id, turn, chunk FROM g""",
    "f1_point": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate <= '1997-03-31' GROUP BY 1",
    "f2_interval_overlap": f"SELECT o_orderkey FROM {SESS} WHERE coalesce(ended, o_orderdate) >= '1997-01-05' AND coalesce(o_orderdate, ended) <= '1997-02-05'",
    "f3_equalities": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent' AND o_custkey < 300",
    "f5_array_like": "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x ILIKE '%ING' OR x ILIKE '%dge%')) > 0",
    "f7_tag_semi": "SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)",
    "f9_linked_undirected": f"SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM {EDGE} WHERE (a = 7 AND b = p_partkey) OR (b = 7 AND a = p_partkey))",
    "j15_links": f"SELECT b AS other, 'out' AS direction FROM {EDGE} WHERE a = 7 UNION ALL SELECT a, 'in' FROM {EDGE} WHERE b = 7",
    "f10_untitled_anti": "SELECT doc_id, n_chars FROM documents d WHERE coalesce(n_chars, 0) < 500 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0)",
    "f12_exclude_null_safe": "SELECT lang, count(*) AS n FROM labels LEFT JOIN (SELECT doc_id, lang FROM documents WHERE n_chars > 400) USING (doc_id) WHERE lang IS NULL OR lang NOT IN ('en', 'de') GROUP BY lang",
    "f13_tri_state": f"SELECT count(*) AS n_include, count(parent) AS n_only, count(*) - count(parent) AS n_exclude FROM {FAM}",
    "f15_rollup_orphans": f"SELECT o_orderkey FROM {FAM} c WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM {FAM} p WHERE p.o_orderkey = c.parent)",
    "f16_ignored": f"SELECT page_id FROM (SELECT page_id, lower({BARE}) AS p FROM pages) WHERE p = 'de' OR p LIKE 'de/%' OR list_contains(string_split(p, '/'), 'de') OR p = 'therha.example.com' OR p LIKE 'therha.example.com/%' OR list_contains(string_split(p, '/'), 'therha.example.com')",
    "f18_prefix": "WITH i AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS s FROM orders), p AS (SELECT *, CASE WHEN id LIKE '149%' THEN 0 WHEN id LIKE '%149%' THEN 1 END AS t FROM i) SELECT id FROM p WHERE t = (SELECT min(t) FROM p) ORDER BY s <> 'O', id LIMIT 25",
    "f19_project_tiers": f"WITH p AS (SELECT DISTINCT split_part({BARE}, '?', 1) AS path FROM pages), t AS (SELECT path, CASE WHEN lower(path) = '25' THEN 0 WHEN list_filter(regexp_split_to_array(lower(path), '[/\\\\]'), lambda x: x <> '')[-1] = '25' THEN 1 WHEN contains(lower(path), '25') THEN 2 END AS tier FROM p) SELECT path, tier FROM t WHERE tier = (SELECT min(tier) FROM t)",
    "f20_title_tokens": "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring') OR contains(lower(p_name || ' ' || p_brand), 'brand#2')",
    "f23_min_size": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 6)",
    "f24_markers": "SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'token =')",
    "j4_card_owner": "SELECT id, coalesce(c_mktsegment, p_type) AS owner FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) LEFT JOIN customer ON c_custkey = id LEFT JOIN part ON p_partkey = id",
    "j6_ghost_anti": f"SELECT o_orderkey, o_custkey FROM {GHOST}",
    "s14_prompt_log": f"WITH {LOG} SELECT user_id, project, prompts, first_ts, last_ts, first_prompt, CAST(coalesce(len(texts), 0) AS INTEGER) AS n_texts FROM log",
    "g1_ghosts": f"WITH {LOG} SELECT user_id, coalesce(nullif(trim(summary), ''), texts[1], 'session ' || substr(CAST(user_id AS VARCHAR), 1, 8)) AS title, message_count, prompts FROM gh",
    "g1_ghost_prompts": f"WITH {LOG} SELECT user_id || ':' || seq AS id, ts, md5(text) AS text_md5 FROM gp",
    "a13_ghost_fingerprint": f"WITH {LOG} SELECT count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, 3 AS version FROM gp",
    "a5_audit": f"""WITH {LOG}, fi AS (SELECT user_id, project, user_id % 7 = 0 AS side, to_timestamp(1700000000 + user_id * 7200) AS m FROM disk),
e AS (SELECT user_id, max(file) AS file, sum(p) AS p, max(l) AS l, max(said) AS said FROM (SELECT user_id, 1 AS file, 0 AS p, 0 AS l, 0 AS said FROM fi WHERE NOT side UNION ALL SELECT user_id, 0, prompts, 1, CASE WHEN len(texts) > 0 THEN 1 ELSE 0 END FROM log UNION ALL SELECT user_id, 0, 0, 0, 0 FROM idx WHERE user_id % 3 <> 0) GROUP BY user_id),
s AS (SELECT count(*) AS sessions_ever, count(*) FILTER (WHERE file = 1) AS on_disk, count(*) FILTER (WHERE file = 0) AS deleted, CAST(coalesce(sum(p) FILTER (WHERE file = 0), 0) AS BIGINT) AS prompts_lost, CAST(coalesce(sum(p) FILTER (WHERE file = 1), 0) AS BIGINT) AS prompts_surviving,
count(*) FILTER (WHERE file = 0 AND l = 1 AND said = 0) AS deleted_without_title, count(*) FILTER (WHERE l = 1) AS logged, count(*) FILTER (WHERE l = 1 AND file = 1) AS logged_on_disk FROM e),
t AS (SELECT min(first_ts) AS log_first_ts, max(last_ts) AS log_last_ts FROM log),
f AS (SELECT count(*) FILTER (WHERE NOT side) AS files, count(*) FILTER (WHERE side) AS sidechain_files, CAST(coalesce(sum(user_id * 10), 0) AS BIGINT) AS bytes, count(DISTINCT CASE WHEN NOT side THEN project END) AS projects, count(*) FILTER (WHERE NOT side AND user_id % 4 = 0) AS sdk_sessions, count(*) FILTER (WHERE NOT side AND user_id % 5 = 0) AS titled_sessions,
count(*) FILTER (WHERE NOT side AND 30 - floor((1702000000 - epoch(m)) / 86400) <= 7) AS within_7, count(*) FILTER (WHERE NOT side AND 30 - floor((1702000000 - epoch(m)) / 86400) <= 1) AS within_1 FROM fi) SELECT * FROM s, t, f""",
    "k3_ghost_pass": f"WITH {LOG}, held AS (SELECT c_custkey AS user_id, 'old' AS title, c_nationkey AS message_count, 'b' AS branch, 1 AS prompts FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT user_id, coalesce(nullif(trim(summary), ''), texts[1], 'session ' || substr(CAST(user_id AS VARCHAR), 1, 8)) AS title, message_count, c_mktsegment AS branch, prompts FROM gh LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0) SELECT user_id, CASE WHEN n.user_id IS NOT NULL THEN n.title ELSE held.title END AS title, coalesce(n.message_count, held.message_count) AS message_count, coalesce(n.branch, held.branch) AS branch, CASE WHEN n.user_id IS NOT NULL THEN n.prompts ELSE held.prompts END AS prompts FROM held FULL JOIN n USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM disk)",
    "k3_ghost_prompts": f"WITH {LOG}, p AS (SELECT user_id, unnest(texts) AS text FROM gh UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT user_id FROM gh)) SELECT user_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM p WHERE user_id NOT IN (SELECT user_id FROM disk) GROUP BY user_id",
    "h6_pass_totals": f"WITH {LOG}, held AS (SELECT c_custkey AS user_id, 'old' AS title, c_nationkey AS message_count, 1 AS prompts FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT user_id, coalesce(nullif(trim(summary), ''), texts[1], 'session ' || user_id) AS title, message_count, prompts FROM gh), g AS (SELECT user_id, CASE WHEN n.user_id IS NOT NULL THEN n.title ELSE held.title END AS title, coalesce(n.message_count, held.message_count) AS m, CASE WHEN n.user_id IS NOT NULL THEN n.prompts ELSE held.prompts END AS prompts FROM held FULL JOIN n USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM disk)) SELECT count(*) AS ghosts, count(*) FILTER (WHERE title NOT LIKE 'session %') AS titled, CAST(coalesce(sum(prompts), 0) AS BIGINT) AS prompts, CAST(coalesce(sum(m), 0) AS BIGINT) AS messages, (SELECT count(*) FROM held WHERE user_id IN (SELECT user_id FROM disk)) AS came_back FROM g",
    "j7_ever_deleted": f"WITH {LOG}, ev2 AS (SELECT user_id FROM log UNION SELECT user_id FROM disk UNION SELECT user_id FROM idx) SELECT user_id, user_id NOT IN (SELECT user_id FROM disk) AS deleted FROM ev2",
    "a6_project_totals": f"""WITH {LOG}, r AS (SELECT coalesce(project, 'unknown') AS project, 1 AS total, CAST(user_id IN (SELECT user_id FROM disk) AS INT) AS alive, CASE WHEN user_id IN (SELECT user_id FROM disk) THEN 0 ELSE prompts END AS prompts, last_ts FROM log
UNION ALL SELECT project, CAST(user_id NOT IN (SELECT user_id FROM log) AS INT), 1, 0, NULL FROM disk) SELECT project, CAST(sum(total) AS BIGINT) AS total, CAST(sum(alive) AS BIGINT) AS alive, CAST(sum(prompts) AS BIGINT) AS prompts, max(last_ts) AS last_ts FROM r GROUP BY project""",
    "j9_conversation_key": f"SELECT c.o_orderkey, coalesce(p.o_orderkey, c.o_orderkey) AS conversation FROM {FAM} c LEFT JOIN {FAM} p ON p.o_orderkey = c.parent",
    "g9_link_pairs": "WITH i AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem), r AS (SELECT f FROM i GROUP BY f HAVING count(*) BETWEEN 2 AND 200) SELECT x.k AS a, y.k AS b, count(*) AS shared FROM i x JOIN i y ON x.f = y.f AND x.k < y.k WHERE x.f IN (SELECT f FROM r) GROUP BY 1, 2 HAVING count(*) >= 2",
    "j17_neighbours": "SELECT l_orderkey, l_linenumber FROM (SELECT *, max(CAST(q >= 50 AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE near = 1",
    "a1_harness_stats": f"WITH {STATS} SELECT o_orderpriority, sessions, live, archived, titled, exchanges, {YMD.format('f')} AS first_ts, {YMD.format('l')} AS last_ts FROM st",
    "a3_merged": f"WITH {STATS} SELECT o_orderpriority, sessions, live, archived, titled, exchanges, ghosts, {YMD.format('f')} AS first_ts, {YMD.format('l')} AS last_ts FROM mg",
    "a3_grand_total": f"WITH {STATS} SELECT o_orderpriority, sessions, exchanges, ghosts FROM mg UNION ALL SELECT 'total', CAST(sum(sessions) AS BIGINT), CAST(sum(exchanges) AS BIGINT), CAST(sum(ghosts) AS BIGINT) FROM mg",
    "a4_freshness": "WITH f AS (SELECT c_custkey, TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS m FROM customer WHERE c_custkey % 5 > 0) SELECT CASE WHEN c_custkey IS NULL THEN 'missing' WHEN m > o_orderdate THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM orders LEFT JOIN f ON c_custkey = o_custkey GROUP BY 1",
    "a7_sweep_countdown": f"SELECT * FROM {SWEEP} WHERE days_left BETWEEN 0 AND 7",
    "a5_sweep_counts": f"SELECT count(*) AS n, count(*) FILTER (WHERE days_left <= 7) AS within_7, count(*) FILTER (WHERE days_left <= 1) AS within_1 FROM {SWEEP}",
    "a8_map_sum": "SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1",
    "a9_tag_hist": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "a10_tags_per_session": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1",
    "a11_project_counts": "SELECT project, count(*) AS n FROM (SELECT c_nationkey AS project FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "a14_source_fingerprint": "SELECT o_orderpriority, sha256(concat_ws(':', sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT), sum(('0x' || substr(h, 31, 15))::BIGINT), sum(('0x' || substr(h, 46, 15))::BIGINT))) AS fingerprint, count(*) AS n FROM (SELECT o_orderpriority, sha256(o_orderkey || ':' || o_custkey || ':' || o_orderstatus) AS h FROM orders) GROUP BY 1",
    "u2_distinct_projects": "SELECT c_nationkey AS project FROM customer UNION SELECT s_nationkey FROM supplier",
    "u5_tag_arrays": "SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_concat(string_split(p_name, ' '), ['kept', 'red'])), lambda x: x NOT IN ('small', 'widget'))), ',') AS tags FROM part",
    "k6_tag_changes": "(SELECT doc_id, 'q' || quality AS tag FROM labels UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) EXCEPT SELECT doc_id, 'q0' FROM documents WHERE n_chars < 300",
    "k6_link_changes": f"SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {EDGE} WHERE a <> b EXCEPT SELECT least(a, b), greatest(a, b) FROM {EDGE} WHERE a % 2 = 0",
    "p1_session_row": "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM lineitem WHERE l_partkey = c_custkey) AS n_lines FROM customer",
    "p2_first_prompt": "SELECT conv_id, md5(arg_min(text, turn)) AS prompt_md5 FROM conversations WHERE role = 'user' AND length(text) > 30 AND text NOT LIKE '/%' GROUP BY 1",
    "p3_look_up": "WITH w AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity >= 49) SELECT id, 'session' AS kind FROM w JOIN supplier ON s_suppkey = id AND s_suppkey % 2 = 0 UNION ALL SELECT id, 'ghost' FROM w JOIN part ON p_partkey = id WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)",
    "p4_titles": "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name WHEN p_size > 20 THEN p_brand || '-' || substr(lpad(CAST(p_partkey AS VARCHAR), 10, '0'), 1, 8) ELSE p_type END AS title FROM part",
    "p5_last_segment": "SELECT page_id, list_filter(string_split(split_part(url, '?', 1), '/'), lambda x: x <> '')[-1] AS segment FROM pages",
    "p6_resume_command": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'open ' || o_orderkey ELSE 'resume ' || o_orderkey END AS command FROM orders",
    "w7_last_rows": "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem) WHERE n <= 2",
    "w8_slice": "SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n BETWEEN 2 AND 3",
    "o1_merged_branches": f"SELECT id, kind, {YMD.format('t')} AS day FROM (SELECT o_orderkey AS id, coalesce(ended, o_orderdate) AS t, 'session' AS kind FROM {SESS} UNION ALL SELECT l_orderkey, l_shipdate, 'ghost' FROM lineitem WHERE l_linenumber = 1) ORDER BY t DESC, id, kind LIMIT 20 OFFSET 10",
    "h4_hidden": "SELECT greatest(0, count(*) - count(*) FILTER (WHERE o_custkey >= 100)) AS hidden FROM orders",
    "t2_incremental_skip": "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 > 0 AND o_orderkey % 10 <> 1)",
    "k1_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 < 2 THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END) ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "k2_replace_children": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber < 3 GROUP BY 1",
    "t6_session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
}
