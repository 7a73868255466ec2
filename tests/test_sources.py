from __future__ import annotations

import json
import sqlite3

from pyspark.sql import functions as F
from quernstone.operators import sinks, stats
from quernstone.operators.ghosts import orphans
from quernstone.sources import jsonl, transcripts
from quernstone.sources.sqlite import sqlite_table
from quernstone.streaming.sessions import open_exchanges, replacing_sink, session_counts
from quernstone.streaming.tail import TailReader, TailSource


def put(path, *records, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records) + tail)


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z"} | more


def said(*blocks):
    return {"type": "assistant", "timestamp": "2026-01-01T00:01:00Z", "message": {"role": "assistant", "model": "m", "content": list(blocks)}}


def read(spark, path):
    return jsonl.records(jsonl.lines_of(jsonl.text_files(spark, str(path))))


def test_lines_and_torn_tail(spark, tmp_path):
    put(tmp_path / "a.jsonl", "one\r", "é", "", tail="half")
    rows = jsonl.lines_of(jsonl.text_files(spark, str(tmp_path))).orderBy("line").collect()
    assert [(r.line, r.text, r.begin, r.end) for r in rows] == [(1, "one", 0, 5), (2, "é", 5, 8), (3, "", 8, 9)]


def test_claude(spark, tmp_path):
    put(
        tmp_path / "a.jsonl",
        said({"type": "text", "text": "before any prompt"}),
        user("first", promptId="p1", cwd="/w"),
        user("more of it"),
        said({"type": "text", "text": "answer"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/a.py", "edits": [{"file_path": "/w/b.py"}]}}),
        user([{"type": "tool_result", "tool_use_id": "t1", "content": "done", "is_error": True}]),
        user([{"type": "tool_result", "tool_use_id": "nobody", "content": "lost"}]),
        "{broken",
        "[1]",
        said({"type": "text", "text": "again"}),
        {"type": "ai-title", "aiTitle": "A title"},
        {"type": "strange"},
        user("second", promptId="p2"),
        tail='{"type": "us',
    )
    recs = read(spark, tmp_path)
    exchanges, calls = transcripts.fold(transcripts.claude_turns(recs))
    rows = exchanges.orderBy("seq").collect()
    assert [(r.seq, r.user_text, r.assistant_text, r.files) for r in rows] == [(1, "first\nmore of it", "answer\n\nagain", ["/w/a.py", "/w/b.py"]), (2, "second", "", [])]
    call = calls.collect()
    assert [(c.name, c.result, c.is_error, c.nth) for c in call] == [("Edit", "done", True, 0)] and call[0].exchange_id == rows[0].id
    assert jsonl.malformed(recs).first().n_malformed == 2
    facts = transcripts.session_facts(recs).first()
    assert (facts.session_id, facts.title, facts.project, facts.model) == ("s1", "A title", "/w", "m")
    assert jsonl.detect_formats(recs).first().format == "claude"


def test_codex(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "timestamp": p.pop("ts", "t"), "payload": p}
    put(
        tmp_path / "a.jsonl",
        {"type": "session_meta", "payload": {"id": "c1", "cwd": "/w"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "do  it"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "injected"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "do it"}], ts="t1"),
        item(type="message", role="assistant", content=[{"type": "output_text", "text": "ok"}], ts="t2"),
        item(type="function_call", name="shell", call_id="k", arguments='{"path": "/w/x"}'),
        item(type="function_call_output", call_id="k", output="fine"),
    )
    recs = read(spark, tmp_path)
    assert jsonl.detect_formats(recs).first().format == "codex"
    exchanges, calls = transcripts.fold(transcripts.codex_turns(recs), restamp=True)
    assert [(r.user_text, r.assistant_text, r.ts, r.files) for r in exchanges.collect()] == [("do it", "ok", "t2", ["/w/x"])]
    assert [(c.name, c.result) for c in calls.collect()] == [("shell", "fine")]


def test_cursor(spark, tmp_path):
    say = lambda role, text: {"role": role, "message": {"content": [{"type": "text", "text": text}]}}
    put(tmp_path / "a.jsonl", say("user", "<timestamp>Monday, Jan 5, 2026, 3:04 PM (UTC+2)</timestamp>\n<user_query>\nhello\n</user_query>"), say("assistant", "hi"), say("user", "<user_query>go on</user_query>"), say("assistant", "still"))
    recs = read(spark, tmp_path)
    assert jsonl.detect_formats(recs).first().format == "cursor"
    rows = transcripts.fold(transcripts.cursor_turns(recs))[0].collect()
    assert [(r.user_text, r.assistant_text, r.ts) for r in rows] == [("hello", "hi\n\nstill", "2026-01-05T13:04:00Z")]


def test_pi_tree(spark, tmp_path):
    node = lambda i, up, role, text: {"type": "message", "id": i, "parentId": up, "timestamp": "t", "message": {"role": role, "content": [{"type": "text", "text": text}]}}
    put(tmp_path / "a.jsonl", {"type": "session", "id": "s", "cwd": "/w"}, node("a", None, "user", "q"), node("b", "a", "assistant", "dropped"), node("c", "a", "assistant", "kept"), node("d", "b", "user", "side"), node("e", "c", "user", "q2"))
    recs = read(spark, tmp_path)
    assert jsonl.detect_formats(recs).first().format == "pi"
    chains = {r.line: r.chain for r in transcripts.tree_chains(recs).collect()}
    assert chains == {2: 0, 3: 1, 4: 0, 5: 1, 6: 0}
    rows = transcripts.fold(transcripts.pi_turns(recs))[0].orderBy("path", "seq").collect()
    assert [(r.user_text, r.assistant_text) for r in rows] == [("q", "kept"), ("q2", ""), ("side", "")]


def test_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"role": "user", "parts": [{"text": "q"}]}, {"role": "model", "parts": [{"text": "a"}, {"functionCall": {"name": "f", "args": {"path": "/x"}}}]}, {"role": "user", "parts": [{"functionResponse": {"name": "f", "response": {"ok": 1}}}]}]))
    (tmp_path / "h.json").write_text(json.dumps({"messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": "n"}]}))
    (tmp_path / "bad.json").write_text("{")
    exchanges, calls = transcripts.fold(transcripts.document_turns(jsonl.text_files(spark, str(tmp_path))))
    assert sorted((r.user_text, r.assistant_text, r.files) for r in exchanges.collect()) == [("m", "n", []), ("q", "a", ["/x"])]
    assert [c.result for c in calls.collect()] == ['{"ok":1}']


def test_all_formats_at_once(spark, tmp_path):
    put(tmp_path / "a.jsonl", user("x", promptId="p"))
    put(tmp_path / "b.jsonl", {"role": "user", "message": {"content": "y"}})
    recs = read(spark, tmp_path)
    rows = transcripts.fold(transcripts.all_turns(recs, jsonl.detect_formats(recs)))[0].collect()
    assert sorted(r.user_text for r in rows) == ["x", "y"]


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "o.db")
    con.execute("CREATE TABLE Message(sessionID TEXT, role TEXT, Body TEXT)")
    con.executemany("INSERT INTO Message VALUES (?, ?, ?)", [("s", "user", "q"), ("s", "assistant", None)])
    con.commit()
    con.close()
    (tmp_path / "no.db").write_bytes(b"nothing")
    rows = sqlite_table(spark, str(tmp_path), ["messages", "message"], {"session": ["session_id", "sessionid"], "text": ["content", "body"], "ts": ["created"]}, "*.db").collect()
    assert [(r.session, r.text, r.ts) for r in rows] == [("s", "q", None), ("s", None, None)]


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "n.md").write_text("intro\n# One \nbody\n\n##Two\n## Three\n")
    rows = jsonl.markdown_sections(jsonl.text_files(spark, str(tmp_path))).orderBy("line").collect()
    assert [(r.line, r.heading, r.text) for r in rows] == [(1, "n.md", "intro"), (2, "One", "body\n\n##Two")]


def test_manifest_and_copies(spark, tmp_path):
    put(tmp_path / "in" / "a.jsonl", "x")
    put(tmp_path / "in" / "b.jsonl", "y")
    now = jsonl.listing(spark, str(tmp_path / "in"))
    assert jsonl.changed(now, now.where("path LIKE '%a.jsonl'")).count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    known = files.withColumns({"sha256": F.sha2("content", 256), "bytes": F.lit(0).cast("long")})
    assert sinks.to_copy(files, known).count() == 0 and sinks.to_copy(files, known.limit(0)).count() == 2
    ends = jsonl.head_and_tail(spark, str(tmp_path / "in"), size=1).orderBy("path").first()
    assert (ends.head, ends.tail) == ("x", "\n")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "r", "b"), (2, 1, "s", "c")], "s long, seq long, user_text string, assistant_text string")
    pages = {r.name: r.value for r in sinks.export_markdown(rows, "s", "seq", F.lit("T"), most=1).collect()}
    assert pages["1"] == "# T\n\n## 1\n\n**You:** q\n\na\n" and set(pages) == {"1", "2"}
    sinks.write_replacing(rows, str(tmp_path / "t"), "s")
    sinks.write_replacing(rows.where("s = 1 AND seq = 1"), str(tmp_path / "t"), "s")
    assert sorted((r.s, r.seq) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 1), (2, 1)]
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_audit_rollup(spark):
    rows = [("/a", 1, 1), ("/a/x", 1, 0), ("/b", 2, 0), ("/b/y", 3, 0), ("/c", 1, 0), ("/c/1", 1, 0), ("/c/2", 1, 0), ("unknown", 4, 0)]
    totals = spark.createDataFrame([(p, t, a, t, 1) for p, t, a in rows], "project string, total long, alive long, prompts long, last_ts long")
    found = {r.owner: r.sessions for r in stats.roll_up_wiped(totals).collect()}
    assert found == {"/b": 5, "/c": 1, "/c/1": 1, "/c/2": 1, "unknown": 4}


def test_orphans(spark):
    assert orphans(spark.createDataFrame([("s",), ("",), (None,)], "s string"), "s").first().n == 2


def test_tail_stream(spark, tmp_path):
    spark.dataSource.register(TailSource)
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    put(src / "a.log", "one", "two", tail="thr")

    def run():
        stream = spark.readStream.format("tail_lines").load(f"{src}/*.log")
        replacing_sink(stream, str(cp), lambda df, i: df.write.mode("append").parquet(str(out))).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(out)).collect())

    assert run() == ["one", "two"]
    with open(src / "a.log", "a") as f:
        f.write("ee\nfour\n")
    put(src / "b.log", "five")
    assert run() == ["five", "four", "one", "three", "two"]
    assert TailReader.whole(str(src / "a.log"), step=3) == 19


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    session_counts(stream, "user_id", "ts").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = {(r.user_id, r.start): r.n for r in session_counts(events, "user_id", "ts").collect()}
    got = {(r.user_id, r.start): r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got.items() <= batch.items() and len(got) > 0.9 * len(batch)  # the last windows are still open


def test_open_exchanges(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns.where("turn < 3").coalesce(1).write.parquet(str(tmp_path / "t"))
    turns.where("turn >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    open_exchanges(stream, "conv_id", "turn", "role", "text").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    from quernstone.operators.fold import fold_exchanges

    every = fold_exchanges(turns, "conv_id", "turn", "role", "text")
    last = every.groupBy("conv_id").agg(F.max("seq").alias("m"))
    want = {(r.conv_id, r.seq, r.user_text, r.assistant_text) for r in every.join(last, "conv_id").where("seq < m").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == want


def nodes_of(spark, files):
    rows = [(f"f{p}", line, i, up) for p, held in enumerate(files) for line, (i, up) in enumerate(held)]
    return spark.createDataFrame(rows, "path string, line long, id string, parent string")


def test_chains_by_doubling_are_those_of_a_task(spark):
    import random

    r = random.Random(7)
    files = [[("a", None)], [("a", "a")], [("a", "b"), ("b", "a"), ("c", "x")], [("a", None), ("a", "a"), ("b", "a")]]
    for _ in range(12):
        n = r.randrange(2, 40)
        files.append([(f"n{r.randrange(n) if r.random() < 0.1 else i}", r.choice([None, "gone", *[f"n{r.randrange(n if r.random() < 0.1 else max(1, i))}" for _ in range(8)]])) for i in range(n)])
    files.append([(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)])
    nodes = nodes_of(spark, files)
    pick = lambda df: sorted(tuple(x) for x in df.select("path", "line", "chain").collect())
    assert pick(transcripts.chains_by_doubling(nodes)) == pick(transcripts.chains_by_task(nodes))


def test_files_at_any_depth(spark):
    deep = {"path": "/1", "edits": [{"file_path": "/2", "more": [{"path": "/3", "x": [{"notebookPath": "/4", "y": [{"filePath": "/5"}]}]}]}, {"path": "/6"}], "z": ["no", 3, [{"path": "/not-an-object"}], {"path": "/1"}], "o": {"path": "/no"}}
    rows = spark.createDataFrame([(json.dumps(deep),), ("[]",), ("{",), (None,), ('{"path": " "}',)], "i string")
    assert [r.f for r in rows.select(transcripts.files_in(F.col("i")).alias("f")).collect()] == [["/1", "/2", "/3", "/4", "/5", "/6"], [], [], [], []]
