"""Upkeep operators: spans against brute force, recovered folders, incremental vectors, failing functions, copies."""

from __future__ import annotations

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F
from quernstone.operators import upkeep as K


def span_by_hand(text, quote):
    """Folds character by character and keeps where each came from."""
    fold = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}

    def folded(s):
        out, at, blank = [], [], False
        for i, c in enumerate(s):
            if c in " \t\n\x0b\f\r":
                blank = bool(out)
                continue
            if blank:
                out.append(" ")
                at.append(i)
            blank = False
            out.append(fold.get(c, c.lower()))
            at.append(i)
        return "".join(out), at

    (q, _), (t, at) = folded(quote), folded(text)
    i = t.find(q)
    return None if len(q) < 16 or i < 0 else (at[i], at[i + len(q) - 1] + 1, text[at[i] : at[i + len(q) - 1] + 1])


def test_spans_by_hand(spark):
    r = random.Random(2)
    words = ["alpha", "Beta", "it’s", "it's", "“so”", '"so"', "a–b", "a-b", "x.y*", "[z]", "(q)?", "é", "\\d", "$1", "漢字"]
    gaps = [" ", "  ", "\n", "\t\n "]
    rows = []
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(3, 25)))
        i = r.randrange(len(text))
        quote = text[i : i + r.randrange(5, 60)]
        swap = {"’": "'", "'": "’", "“": '"', '"': "”", "–": "-", "-": "—", " ": "\n ", "\n": " "}
        quote = "".join(swap.get(c, c) if r.random() < 0.5 else c for c in quote)
        rows.append((text, quote.upper() if r.random() < 0.3 else quote))
    rows += [("nothing of it", "quite another sentence here"), ("short", "short"), (None, "a quote of some length"), ("a text of some length", None)]
    df = spark.createDataFrame(rows, "t string, q string")
    for (t, q), x in zip(rows, df.select(K.quote_span(F.col("t"), F.col("q")).alias("s")).collect()):
        want = span_by_hand(t, q) if t is not None and q is not None else None
        assert (tuple(x.s) if x.s else None) == want, (t, q)


def test_ancestors_and_slugs(spark):
    row = spark.createDataFrame([("/a/b c/d.txt", "/", "", None)], "p string, q string, e string, n string").select(*[K.ancestors(F.col(c)).alias(c) for c in "pqen"], K.path_slug(F.lit("/Users/me/my.app")).alias("s")).first()
    assert row.p == ["/a/b c/d.txt", "/a/b c", "/a"] and row.q == row.e == [] and not row.n and row.s == "Users-me-my-app"


def test_recovered_folders(spark):
    slugs = spark.createDataFrame([(1, "w-my-app"), (2, "w-none"), (3, "w-a-b")], "s long, slug string")
    paths = [(1, "/w/my-app/src/x.py"), (1, "/w/my-app/y.py"), (1, "/w/my.app/z.py"), (2, "/else/x"), (3, "/w/a-b/1"), (3, "/w/a_b/2"), (3, "/w/a-b/1")]
    found = K.recover_by_slug(slugs, spark.createDataFrame(paths, "s long, path string"), "s", "slug", "path")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "/w/my-app", 2), (3, "/w/a-b", 2)]
    hashes = spark.createDataFrame([(1, hashlib.sha256(b"/w/my-app").hexdigest()), (2, "00")], "s long, h string")
    assert [tuple(r) for r in K.recover_by_hash(hashes, spark.createDataFrame(paths, "s long, path string"), "s", "h", "path").collect()] == [(1, "/w/my-app")]


def test_ignore_list_is_turned_off(spark):
    rows = spark.createDataFrame([(1, "/w/a/x"), (2, "/w/b"), (3, None)], "i long, project string")
    ids = lambda **x: sorted(r.i for r in K.without_ignored(rows, "project", ["/w/a"], **x).collect())
    assert ids() == [2, 3] and ids(everything=True) == ids(wanted="a") == [1, 2, 3]
    assert [r.project for r in K.ignored_projects(rows, "project", ["/w/a"]).collect()] == ["/w/a/x"]


def test_second_run_embeds_nothing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        assert len(texts) <= 5
        return [[float(len(x))] for x in texts]

    rows = spark.createDataFrame([(i, f"text {i}" if i % 4 else None) for i in range(23)], "k long, t string").repartition(2)
    held = spark.createDataFrame([], "k long, digest string, version string, vector array<float>")
    runs = []
    for step in range(4):
        if step == 2:  # one text changes, one row goes
            rows = rows.where("k <> 3").withColumn("t", F.when(F.col("k") == 5, "changed").otherwise(F.col("t")))
        version = "b" if step == 3 else "a"
        before = calls.value
        new = K.embedded(K.to_embed(rows, held, "k", "t", version), "k", "t", embedder, version, batch=5)
        path = str(tmp_path / str(step))
        K.refreshed(rows, held, "k", "t", lambda texts: [[float(len(x))] for x in texts], version).write.parquet(path)
        new.write.format("noop").mode("overwrite").save()
        runs.append(calls.value - before)
        held = spark.read.parquet(path)
        assert {r.k: (r.version, list(r.vector)) for r in held.collect()} == {r.k: (version, [float(len(r.t or ""))]) for r in rows.collect()}
    assert runs == [23, 0, 1, 22]


def test_failing_calls_lose_one_target(spark):
    def ask(text):
        if "bad" in text:
            raise KeyError("x")
        return f"<{len(text)}>"

    rows = spark.createDataFrame([(1, "x" * 10), (2, "y" * 25), (3, "bad"), (4, "z" * 11 + "bad" + "z" * 11), (5, None), (6, "")], "k long, t string")
    found = {r.k: (r.answer, r.error, r.n_chunks) for r in K.asked(rows, "k", "t", ask, 10, 10).collect()}
    assert found == {1: ("<10>", None, 1), 2: ("<15>", None, 3), 3: (None, "KeyError", 1), 4: (None, "KeyError", 3), 6: ("<0>", None, 1)}


def test_confirmation_is_joined_back(spark):
    def judge(texts):
        assert len(texts) <= 3
        if "fail" in texts:
            raise ValueError
        return {i: x == "yes" for i, x in enumerate(texts) if x != "skip"} | {99: True}

    rows = spark.createDataFrame([(1, 0, "yes"), (1, 1, "no"), (1, 2, "skip"), (1, 3, "fail"), (1, 4, "yes"), (2, 0, None), (None, 0, "yes")], "g long, c long, t string")
    found = {(r.g, r.c): r.verdict for r in K.confirmed(rows, "g", "c", "t", judge, 3).collect()}
    assert found == {(1, 0): "confirmed", (1, 1): "overruled", (1, 2): "unjudged", (1, 3): "failed", (1, 4): "failed", (2, 0): "overruled", (None, 0): "confirmed"}


def test_copies_by_digest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, x in enumerate([b"a" * 3_000_000, b"b", b"b", b""]):
        (tmp_path / "in" / str(i)).write_bytes(x)
    target = str(tmp_path / "out")
    files = spark.createDataFrame([(str(tmp_path / "in" / str(i)),) for i in range(4)] + [(str(tmp_path / "none"),)], "path string").repartition(1)
    first = {os.path.basename(r.path): r for r in K.copied(files, target).collect()}
    assert first["none"].error.startswith("FileNotFoundError") and first["none"].sha256 is None
    assert sum(bool(r.copied) for r in first.values()) == 3  # equal contents once
    assert sorted(os.listdir(target)) == sorted({r.sha256 for r in first.values() if r.sha256})
    assert all(hashlib.sha256((tmp_path / "out" / n).read_bytes()).hexdigest() == n for n in os.listdir(target))
    assert not any(r.copied for r in K.copied(files, target).collect())
    assert not [n for n in os.listdir(target) if not re.fullmatch("[0-9a-f]{64}", n)]


@pytest.mark.parametrize("n", [0, 1])
def test_owners(spark, n):
    cards = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    live, gone = spark.createDataFrame([(1, "a")], "id long, t string"), spark.createDataFrame([(2, "b", 5)], "id long, t string, p long").limit(n)
    found = sorted((r.id, r.t, r.is_ghost) for r in K.owners(cards, live, gone, "id").collect())
    assert found == [(1, "a", False), (2, "b", True)][: 1 + n]
