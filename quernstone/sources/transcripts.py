"""Conversation transcripts of several tools as one table of turns, and their fold into exchanges.

Each format is a projection to turns (path, line, part, kind, ts, text, call, name, input, is_error); kind is prompt,
user, assistant, call or result. One fold serves them all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import exchange_id
from quernstone.operators.stored import kept
from quernstone.sources.jsonl import at

#: Keys of a tool's input that name a file; of a JSON document, that hold its turns.
#: Keys of a tool's input that name a file.
FILE_KEYS = ["file_path", "filePath", "notebook_path", "notebookPath", "path"]
#: Arrays within arrays' elements that are looked into.
DEPTH = 8
TURN_KEYS = ["history", "messages", "contents", "turns", "conversation"]
TURNS = ("path", "line", "part", "kind", "ts", "text", "call", "name", "input", "is_error")


def blocks(v: str | Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "array<variant>")


def block_text(v: str | Column, path: str) -> Column:
    """Content that is a string, or the text blocks of an array, one a line."""
    list_ = blocks(v, path)
    own = F.filter(F.transform(list_, lambda b: F.when(F.coalesce(at(b, "type"), F.lit("text")).isin("text", "input_text", "output_text"), at(b, "text"))), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(own, "\n"), at(v, path), F.lit(""))


def turn(kind: Column | str, text=None, call=None, name=None, input=None, is_error=None) -> Column:  # noqa: A002
    null = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *[(null if c is None else c).alias(n) for n, c in (("text", text), ("call", call), ("name", name), ("input", input))], (F.lit(False) if is_error is None else is_error).alias("is_error"))


def _turns(recs: DataFrame, ts: Column, listed: Column) -> DataFrame:
    rows = recs.select("path", "line", ts.alias("ts"), F.posexplode(F.filter(listed, lambda t: t.kind.isNotNull())).alias("part", "t"))
    return rows.select("path", "line", "part", "t.kind", "ts", "t.text", "t.call", "t.name", "t.input", "t.is_error")


def _calls(list_: Column) -> Column:
    of = F.filter(list_, lambda b: at(b, "type") == "tool_use")
    return F.transform(of, lambda b: turn("call", call=at(b, "id"), name=F.coalesce(at(b, "name"), F.lit("unknown")), input=F.to_json(F.try_variant_get(b, "$.input", "variant"))))


def claude_turns(recs: DataFrame) -> DataFrame:
    """A prompt has a prompt id, a text and no tool result; other user text belongs to the prompt before it."""
    role, listed, text = at("v", "message.role"), blocks("v", "message.content"), block_text("v", "message.content")
    none = F.array().cast("array<variant>")
    results = F.filter(F.coalesce(listed, none), lambda b: at(b, "type") == "tool_result")
    has_text = at("v", "message.content").isNotNull() & listed.isNull() | F.exists(F.coalesce(listed, none), lambda b: (at(b, "type") == "text") & at(b, "text").isNotNull())
    human = F.coalesce(at("v", "promptId"), F.lit("")) != ""
    is_prompt = (role == "user") & human & (F.size(results) == 0) & has_text
    answer = F.transform(results, lambda b: turn("result", text=block_text(b, "content"), call=at(b, "tool_use_id"), is_error=F.coalesce(at(b, "is_error", "boolean"), F.lit(False))))
    plain = F.when((F.size(results) == 0) & (F.trim(text) != ""), F.array(turn("user", text))).otherwise(answer)
    said = F.concat(F.array(turn(F.when(F.trim(text) != "", "assistant"), text)), F.coalesce(_calls(listed), F.array(turn(F.lit(None).cast("string")))))
    own = recs.where(at("v", "type").isin("user", "assistant"))
    return _turns(own, at("v", "timestamp"), F.when(is_prompt, F.array(turn("prompt", text))).when(role == "user", plain).when(role == "assistant", said))


def codex_turns(recs: DataFrame) -> DataFrame:
    """If a file logs what its user typed, only those user messages are prompts (a semi-join per file); an exchange
    carries the time of its last answer, see fold(restamp=True)."""
    squash = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    typed = recs.where((at("v", "type") == "event_msg") & (at("v", "payload.type") == "user_message")).select("path", squash(at("v", "payload.message")).alias("__typed")).distinct()
    logs = typed.select("path").distinct().withColumn("__logs", F.lit(True))
    kind, role, text = at("v", "payload.type"), at("v", "payload.role"), block_text("v", "payload.content")
    given = F.coalesce(at("v", "payload.arguments"), F.to_json(F.try_variant_get("v", "$.payload.input", "variant")), F.to_json(F.try_variant_get("v", "$.payload.action", "variant")))
    name = F.coalesce(at("v", "payload.name"), at("v", "payload.namespace"), kind)
    one = (
        F.when((kind == "message") & (role == "user") & (F.trim(text) != ""), turn("prompt", text))
        .when((kind == "message") & (role == "assistant") & (F.trim(text) != ""), turn("assistant", text))
        .when(kind.rlike("_call$"), turn("call", call=at("v", "payload.call_id"), name=name, input=given))
        .when(kind.rlike("_call_output$"), turn("result", text=F.coalesce(at("v", "payload.output"), F.to_json(F.try_variant_get("v", "$.payload.output", "variant"))), call=at("v", "payload.call_id")))
        .otherwise(turn(F.lit(None).cast("string")))
    )
    rows = _turns(recs.where(at("v", "type") == "response_item"), at("v", "timestamp"), F.array(one))
    known = rows.join(logs, "path", "left").withColumn("__typed", squash(F.col("text")))
    checked = known.join(typed.withColumn("__is", F.lit(True)), ["path", "__typed"], "left")
    return checked.where((F.col("kind") != "prompt") | F.col("__logs").isNull() | F.col("__is")).select(*TURNS)


def cursor_turns(recs: DataFrame) -> DataFrame:
    """Prompts stand in <user_query>; one that goes on in the tag's own line was put in by the tool and goes."""
    role, text = at("v", "role"), block_text("v", "message.content")
    inner = F.regexp_extract(text, r"(?s)<user_query>\n(.*)</user_query>", 1)
    wrapped, open_ = F.contains(text, F.lit("<user_query>")), F.regexp_extract(text, r"(?s)<user_query>\n(.*)$", 1)
    prompt = F.trim(F.when(~wrapped, F.regexp_replace(text, r"(?s)^\s*<timestamp>.*?</timestamp>", "")).otherwise(F.when(inner != "", inner).otherwise(open_)), F.lit(" \n\t"))
    own = F.when((role == "user") & (prompt != ""), F.array(turn("prompt", prompt)))
    said = F.concat(F.array(turn(F.when(F.trim(text) != "", "assistant"), text)), F.coalesce(_calls(blocks("v", "message.content")), F.array(turn(F.lit(None).cast("string")))))
    return _turns(recs.where(role.isNotNull()), english_time(F.regexp_extract(text, r"<timestamp>([^<]*)</timestamp>", 1)), own if own is None else F.when(role == "user", own).when(role == "assistant", said))


def english_time(text: Column) -> Column:
    """`Monday, Jan 5, 2026, 3:04 PM (UTC+2)` as ISO text in UTC; without a zone UTC."""
    part = lambda n: F.regexp_extract(text, r"(?i)([a-z]{3})[a-z]* (\d{1,2}), (\d{4}),? (?:at )?(\d{1,2}):(\d{2})(?::(\d{2}))? ?([ap])m(?:.*?utc([+-]\d{1,2})(?::(\d{2}))?)?", n)
    number = lambda n: F.coalesce(F.try_to_number(F.nullif(part(n), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))
    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(part(1))) + 2) / 3
    hour = F.pmod(number(4), F.lit(12)) + F.when(F.lower(part(7)) == "p", 12).otherwise(0)
    offset = F.coalesce(F.nullif(part(8), F.lit("")).cast("int"), F.lit(0))
    minutes = offset * 60 + F.when(F.startswith(part(8), F.lit("-")), -number(9)).otherwise(number(9))
    local = F.try_make_timestamp_ntz(number(3), month.cast("int"), number(2), hour, number(5), number(6))
    return F.when(part(1) != "", F.date_format(F.timestamp_add("MINUTE", -minutes, local), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


#: Nodes of a file up to which one task follows its pointers; those of larger files are followed by doubling.
TASK_NODES = 200_000


def tree_chains(recs: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """path, line, chain: nodes that point at their parents, as the main line (0: from the last node to its root) and
    the side chains (1, 2, ...). A pointer to an id that stands twice means the later node; cycles end where they meet
    themselves."""
    nodes = recs.where(at("v", "id").isNotNull() & (at("v", "type") != "session")).select("path", "line", at("v", "id").alias("id"), at("v", "parentId").alias("parent"))
    large = [r.path for r in nodes.groupBy("path").count().where(F.col("count") > task_nodes).collect()]
    if not large:
        return chains_by_task(nodes)
    return chains_by_task(nodes.where(~F.col("path").isin(large))).unionByName(chains_by_doubling(nodes.where(F.col("path").isin(large))))


def chains_by_task(nodes: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("line").reset_index(drop=True)
        of = {i: n for n, i in enumerate(g["id"])}
        up = [of.get(p, -1) if isinstance(p, str) else -1 for p in g["parent"]]
        chain, n = [-1] * len(g), len(g) - 1
        while n >= 0 and chain[n] < 0:
            chain[n], n = 0, up[n]
        last = 0
        for n in range(len(g)):
            if chain[n] < 0:
                side = chain[up[n]] if up[n] >= 0 else 0
                last, chain[n] = (last, side) if side > 0 else (last + 1, last + 1)
        return pd.DataFrame({"path": g["path"], "line": g["line"], "chain": chain})

    return nodes.groupBy("path").applyInPandas(run, "path string, line long, chain int")


def chains_by_doubling(nodes: DataFrame) -> DataFrame:
    """The same by pointer doubling: after k rounds a node knows its ancestor 2^k generations up, so that a tree of n
    nodes takes log2(n) joins however deep it is, and no file's nodes meet in one task."""
    nodes = nodes.withColumn("line", F.col("line").cast("long"))
    last = nodes.groupBy("path", F.col("id").alias("parent")).agg(F.max("line").alias("up"))
    up = kept(nodes.join(last, ["path", "parent"], "left").select("path", "line", "up"))
    most = nodes.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, int(most).bit_length())
    jump, main = up, up.groupBy("path").agg(F.max("line").alias("line"))

    def hop(rows: DataFrame, over: DataFrame) -> DataFrame:
        """rows (path, line, up) with the pointer of the node that up points at."""
        step = over.select("path", F.col("line").alias("up"), F.col("up").alias("further"))
        return rows.where("up IS NOT NULL").join(step, ["path", "up"]).select("path", "line", F.col("further").alias("up"))

    for _ in range(rounds):
        above = jump.where("up IS NOT NULL").join(main, ["path", "line"], "left_semi").select("path", F.col("up").alias("line"))
        main = kept(main.union(above).distinct())
        jump = kept(hop(jump, jump))
    # off the main line: up to the node whose parent is on it, is none, or stands later in the file
    off = up.join(main, ["path", "line"], "left_anti")
    held = off.join(main.select("path", F.col("line").alias("up"), F.lit(True).alias("on")), ["path", "up"], "left")
    first = F.col("up").isNull() | F.col("on").isNotNull() | (F.col("up") > F.col("line"))
    root = kept(held.select("path", "line", F.when(first, F.col("line")).otherwise(F.col("up")).alias("up")))
    for _ in range(rounds):
        root = kept(hop(root, root))
    number = F.dense_rank().over(W.partitionBy("path").orderBy("up"))
    heads = root.select("path", "up").distinct().withColumn("chain", number)
    sides = root.join(heads, ["path", "up"]).select("path", "line", "chain")
    return main.select("path", "line", F.lit(0).alias("chain")).unionByName(sides)


def pi_turns(recs: DataFrame) -> DataFrame:
    """Turns of the main line; chains off it have their own path, `path#chain`."""
    role, listed, text = at("v", "message.role"), blocks("v", "message.content"), block_text("v", "message.content")
    calls = F.transform(F.filter(listed, lambda b: at(b, "type") == "toolCall"), lambda b: turn("call", call=at(b, "id"), name=at(b, "name"), input=F.to_json(F.try_variant_get(b, "$.arguments", "variant"))))
    said = F.concat(F.array(turn(F.when(F.trim(text) != "", "assistant"), text)), F.coalesce(calls, F.array(turn(F.lit(None).cast("string")))))
    one = F.when(role == "user", F.array(turn("prompt", text))).when(role == "assistant", said).when(role == "toolResult", F.array(turn("result", text=text, call=at("v", "message.toolCallId"), is_error=F.coalesce(at("v", "message.isError", "boolean"), F.lit(False)))))
    rows = _turns(recs.where(at("v", "type") == "message"), at("v", "timestamp"), one).join(tree_chains(recs), ["path", "line"])
    return rows.withColumn("path", F.when(F.col("chain") == 0, F.col("path")).otherwise(F.concat_ws("#", "path", "chain"))).select(*TURNS)


def document_turns(files: DataFrame) -> DataFrame:
    """JSON documents that are an array of turns, or hold one under a known key; a turn has a role and parts, content
    or text. Model turns before the first prompt open an exchange without one."""
    v = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *[blocks(v, k) for k in TURN_KEYS])
    recs = files.select("path", F.posexplode(listed).alias("line", "v"))
    role = F.lower(F.coalesce(at("v", "role"), at("v", "type"), at("v", "author")))
    parts = blocks("v", "parts")
    text = F.coalesce(F.array_join(F.filter(F.transform(parts, lambda b: at(b, "text")), lambda t: t.isNotNull()), "\n"), F.when(block_text("v", "content") != "", block_text("v", "content")), at("v", "text"), F.lit(""))
    none = F.array().cast("array<variant>")
    calls = F.transform(F.filter(F.coalesce(parts, none), lambda b: at(b, "functionCall.name").isNotNull()), lambda b: turn("call", call=at(b, "functionCall.name"), name=at(b, "functionCall.name"), input=F.to_json(F.try_variant_get(b, "$.functionCall.args", "variant"))))
    results = F.transform(F.filter(F.coalesce(parts, none), lambda b: at(b, "functionResponse.name").isNotNull()), lambda b: turn("result", text=F.to_json(F.try_variant_get(b, "$.functionResponse.response", "variant")), call=at(b, "functionResponse.name")))
    human = role.isin("user", "human") & (F.size(results) == 0)
    one = F.when(human & (F.trim(text) != ""), F.array(turn("prompt", text))).when(role.isin("user", "human"), results).otherwise(F.concat(F.array(turn(F.when(F.trim(text) != "", "assistant"), text)), calls))
    return _turns(recs, F.coalesce(at("v", "timestamp"), at("v", "ts")), one)


READERS = {"claude": claude_turns, "codex": codex_turns, "cursor": cursor_turns, "pi": pi_turns}


def all_turns(recs: DataFrame, formats: DataFrame) -> DataFrame:
    """The turns of every file, each read as its format says."""
    kinds = recs.join(formats, "path")
    out = None
    for name, reader in READERS.items():
        found = reader(kinds.where(F.col("format") == name).drop("format"))
        out = found if out is None else out.unionByName(found)
    return out


def files_in(input: Column, depth: int = DEPTH) -> Column:  # noqa: A002
    """Files that a tool's input names: by its own keys, then in the objects that its arrays hold, and so on; once
    each, in that order. No object, no files."""
    found = F.array(F.struct(F.array().cast("array<int>").alias("at"), F.try_parse_json(input).alias("v")))
    named = []
    for level in range(depth):
        own = lambda x: F.array(*[F.struct(F.concat(x.at, F.array(F.lit(-1), F.lit(i))).alias("at"), at(x.v, k).alias("file")) for i, k in enumerate(FILE_KEYS)])
        named.append(F.flatten(F.transform(found, own)))
        if level < depth - 1:
            arrays = lambda x: F.transform(F.map_values(F.coalesce(F.try_variant_get(x.v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), lambda a: F.coalesce(F.try_variant_get(a, "$", "array<variant>"), F.array().cast("array<variant>")))
            inner = lambda x: F.flatten(F.transform(arrays(x), lambda a, i: F.transform(a, lambda e, j: F.struct(F.concat(x.at, F.array(i, j)).alias("at"), e.alias("v")))))
            found = F.flatten(F.transform(found, inner))
    good = F.filter(F.concat(*named), lambda x: F.trim(x.file) != "")
    return F.array_distinct(F.transform(F.array_sort(good), lambda x: x.file))


def fold(turns: DataFrame, restamp: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exchanges (id, path, seq, ts, user_text, assistant_text, files) and tool calls (id, exchange_id, nth, name,
    input, result, is_error). Turns before the first prompt go; exchanges without text and calls go, their numbers
    stay used; a result goes to the call of its id in the same exchange, the last one wins."""
    order = W.partitionBy("path").orderBy("line", "part")
    seq = F.sum(F.when(F.col("kind") == "prompt", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    rows = turns.withColumn("seq", seq).where("seq > 0").withColumn("o", F.struct("line", "part"))
    listed = lambda own: F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("o", "text")))), lambda x: x.text)
    kind = F.col("kind")
    files = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(kind == "call", F.struct("o", files_in(F.col("input")).alias("f"))))), lambda x: x.f)))
    ts = F.coalesce(F.max_by("ts", F.when(kind == "assistant", F.col("o"))), F.min_by("ts", "o")) if restamp else F.min_by("ts", "o")
    folded = rows.groupBy("path", "seq").agg(ts.alias("ts"), F.array_join(listed(kind.isin("prompt", "user")), "\n").alias("user_text"), F.array_join(listed(kind == "assistant"), "\n\n").alias("assistant_text"), files.alias("files"), F.count_if(kind == "call").alias("n_calls"))
    exchanges = folded.where("trim(user_text) <> '' OR n_calls > 0").select(exchange_id(F.col("path"), F.col("seq")).alias("id"), "path", "seq", "ts", "user_text", "assistant_text", "files", "n_calls")
    last = rows.where(kind == "result").groupBy("path", "seq", "call").agg(F.max_by("text", "o").alias("result"), F.max("is_error").alias("is_error"))
    nth = F.row_number().over(W.partitionBy("path", "seq").orderBy("o")) - 1
    calls = rows.where(kind == "call").withColumn("nth", nth).select("path", "seq", "call", "nth", "name", "input").join(last, ["path", "seq", "call"], "left")
    owner = exchange_id(F.col("path"), F.col("seq"))
    return exchanges, calls.select(F.concat_ws(":", owner, "nth").alias("id"), owner.alias("exchange_id"), "nth", "name", "input", "result", F.coalesce("is_error", F.lit(False)).alias("is_error"))


def session_facts(recs: DataFrame) -> DataFrame:
    """path, session_id, title, project, branch, model, first_ts, last_ts: last values in file order."""
    last = lambda p: F.max_by(at("v", p), F.when(at("v", p).isNotNull(), F.col("line")))
    stamped = F.when(at("v", "timestamp").isNotNull(), F.col("line"))
    return recs.groupBy("path").agg(last("sessionId").alias("session_id"), last("aiTitle").alias("title"), last("cwd").alias("project"), last("gitBranch").alias("branch"), last("message.model").alias("model"), F.min_by(at("v", "timestamp"), stamped).alias("first_ts"), F.max_by(at("v", "timestamp"), stamped).alias("last_ts"))
