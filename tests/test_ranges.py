"""Byte ranges and file ends, and the stream of exchanges against the batch fold."""

from __future__ import annotations

import io
import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quernstone.operators.fold import fold_exchanges
from quernstone.sources import jsonl
from quernstone.sources.ranges import HEAD, TAIL, consumed, file_ends, line_ranges, lines_between
from quernstone.streaming.sessions import exchange_updates, replacing_sink, upsert_exchanges, use_rocksdb


@given(st.binary(max_size=80).map(lambda b: b.replace(b"a", b"\n").replace(b"b", b"\n")), st.lists(st.integers(0, 80), max_size=6), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_every_line_is_in_one_range(data, cuts, step):
    import quernstone.sources.ranges as ranges

    was, ranges.STEP = ranges.STEP, step
    try:
        bounds = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
        f = pa.PythonFile(io.BytesIO(data), mode="r")
        got = [x for a, b in zip(bounds, bounds[1:]) for x in lines_between(f, a, b)]
    finally:
        ranges.STEP = was
    want, at = [], 0
    *whole, rest = data.split(b"\n")
    for x in whole:
        want.append((at, x, True))
        at += len(x) + 1
    assert got == want + ([(at, rest, False)] if rest else [])


def test_ranges_of_files(spark, tmp_path):
    r = random.Random(3)
    texts = {f"{i}.jsonl": "".join(json.dumps({"i": j, "t": "é漢" * r.randrange(30)}, ensure_ascii=False) + r.choice(["\n", "\r\n"]) for j in range(50)) for i in range(3)}
    texts["torn.jsonl"] = '{"i": 0}\n{"i": 1'
    texts["empty.jsonl"] = ""
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "_hidden.jsonl").write_text("x\n")
    rows = line_ranges(spark, str(tmp_path), "*.jsonl", chunk=97)
    assert rows.rdd.getNumPartitions() > 20
    want = jsonl.lines_of(jsonl.text_files(spark, str(tmp_path), "*.jsonl")).where("path NOT LIKE '%hidden%'")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    pick = lambda df: sorted(tuple(x) for x in df.select(name, "text", "begin", "end").collect())
    assert pick(rows.where("closed")) == pick(want)
    assert [x.text for x in rows.where("NOT closed").collect()] == ['{"i": 1']
    # go on where the last run ended
    at = {x.path: x.at for x in consumed(rows).collect()}
    with open(tmp_path / "torn.jsonl", "a") as f:
        f.write("}\n{}\n")
    (tmp_path / "0.jsonl").write_text("new\n")  # written anew: shorter than it was
    later = line_ranges(spark, str(tmp_path), "*.jsonl", 97, at).select(name, "text").collect()
    assert sorted(tuple(x) for x in later) == [("0.jsonl", "new"), ("torn.jsonl", '{"i": 1}'), ("torn.jsonl", "{}")]
    assert line_ranges(spark, str(tmp_path / "none")).collect() == []


def test_ends_read_little_of_large_files(spark, tmp_path):
    line = '{"x": "' + "y" * 990 + '"}\n'
    (tmp_path / "titled.jsonl").write_text('{"first": 1}\n' + line * 4000 + '{"aiTitle": "T"}\n')
    (tmp_path / "early.jsonl").write_text('{"first": 1}\n' + line * 3000 + '{"aiTitle": "T"}\n' + line * 500 + '{"last": 1}')
    (tmp_path / "bare.jsonl").write_text(line * 200 + '{"last": 1}\n')
    (tmp_path / "short.jsonl").write_text("a\n\nb")
    rows = {r.path.rpartition("/")[2]: r for r in file_ends(spark, str(tmp_path), titles=("aiTitle", "customTitle")).collect()}
    assert (rows["short.jsonl"].head, rows["short.jsonl"].tail, rows["short.jsonl"].read) == (["a", "b"], [], 4)
    assert rows["titled.jsonl"].read == HEAD + TAIL and rows["titled.jsonl"].tail[-1] == '{"aiTitle": "T"}' and rows["titled.jsonl"].head[0] == '{"first": 1}'
    assert rows["early.jsonl"].read == HEAD + TAIL + (1 << 20) and '{"aiTitle": "T"}' in rows["early.jsonl"].tail
    assert rows["bare.jsonl"].read == HEAD + TAIL + rows["bare.jsonl"].bytes and all(x.startswith("{") and x.endswith("}") for r in rows.values() for x in r.tail)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_exchanges_equals_the_batch_fold(spark, tmp_path, seed):
    """Turns arrive late, twice and in any order; after each batch the table is the fold of what has come."""
    use_rocksdb(spark)
    r = random.Random(seed)
    turns = [(c, t, r.choice(["user", "assistant", "assistant", "tool"]), r.choice([None, "", f"say {c} {t}", "x"])) for c in range(6) for t in range(12)]
    schema = "conv_id long, turn long, role string, text string"
    first, rest = turns[:20], turns[20:] + r.sample(turns, 15)
    r.shuffle(rest)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rest[:1], schema).coalesce(1).write.mode("append").parquet(source)
    initial = spark.createDataFrame(first, schema)
    upsert_exchanges(fold_exchanges(initial, "conv_id", "turn", "role", "text").selectExpr("conv_id", "seq", "user_text", "assistant_text", "true AS open", "0L AS nth"), out, "conv_id")
    came = first + rest[:1]
    for part in ([], rest[1:30], rest[30:]):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            came = came + part
        stream = spark.readStream.schema(schema).parquet(source)
        told = exchange_updates(stream, "conv_id", "turn", "role", "text", initial=initial)
        query = told.writeStream.outputMode("update").foreachBatch(lambda b, i: upsert_exchanges(b, out, "conv_id")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        want = fold_exchanges(spark.createDataFrame(sorted(set(came), key=str), schema), "conv_id", "turn", "role", "text")
        pick = lambda df: sorted(tuple(x) for x in df.select("conv_id", "seq", "user_text", "assistant_text").collect())
        assert pick(spark.read.parquet(out)) == pick(want)


def test_quiet_conversations_are_closed(spark, tmp_path):
    import time

    use_rocksdb(spark)
    schema, source, out = "conv_id long, turn long, role string, text string", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "p")], schema).write.parquet(source)
    told = exchange_updates(spark.readStream.schema(schema).parquet(source), "conv_id", "turn", "role", "text", quiet=200, keep=600_000)
    query = told.writeStream.outputMode("update").foreachBatch(lambda b, i: upsert_exchanges(b, out, "conv_id")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    rows = []
    for _ in range(60):
        time.sleep(1)
        if query.exception():
            raise query.exception()
        try:
            rows = spark.read.parquet(out).collect()
        except Exception:  # noqa: BLE001  # between two versions of the table
            continue
        if rows and not any(x.open for x in rows):
            break
    query.stop()
    assert sorted(tuple(x)[:5] for x in rows) == [(1, 1, "q", "a", False), (2, 1, "p", "", False)]
