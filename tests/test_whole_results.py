"""Cases in which a query's rows differed from its SQL, or a bound dropped some."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from quernstone.functions import redact as R
from quernstone.functions import snippets as N
from quernstone.functions import text as T
from quernstone.operators import cards as C
from quernstone.operators import upkeep as K
from quernstone.plans import analysis


def test_lead_ends_in_a_line_end(spark):
    text = "a" * 20 + " " + "b" * 28 + "\n" + "c" * 9
    assert spark.range(1).select(N.lead(F.lit(text), 50).alias("x")).first().x == text[:49]


def test_folder_with_a_slash_at_its_end_and_deep_ones(spark):
    deep = "/w" + "".join(f"/{i}" for i in range(60))
    paths = spark.createDataFrame([("/h/en/7/",), (deep,)], "path string")
    digests = [(1, "/h/en/7"), (2, "/w"), (3, "/h/en/7/"), (4, deep)]
    hashes = spark.createDataFrame([(k, hashlib.sha256(p.encode()).hexdigest()) for k, p in digests], "k long, h string")
    assert sorted(tuple(r) for r in K.recover_by_hash(hashes, paths, "k", "h", "path").collect()) == [(1, "/h/en/7"), (2, "/w")]


def test_percentiles_compute_their_approximate_pieces_once(spark):
    rows = spark.range(3000).select(F.lit("a").alias("g"), ((F.col("id") * 7919) % 3001).alias("v"))
    found = C.nearest_rank(rows, "g", "v", (0.5, 0.95), 16)
    values = sorted(i * 7919 % 3001 for i in range(3000))
    assert tuple(found.first()) == ("a", values[1500], values[2850])
    # computed again, with other rows first, they would be others
    assert "percentile_approx" not in found._jdf.queryExecution().toString()


def test_dense_tokens_that_begin_like_an_id_by_chance(spark):
    """p_partkey 193360 of a larger table: its token begins with reQ_."""
    tokens = ["reQ_psAZaDcmRxOicNnyO5OKCLHb0_AjSwSDfGIELiU", "Fc_zX6pLMQmXuCoyUV0ADamG4boLAmkRi7KTfU3WNBY", "abcdefghijklmnopqrstuvwxyz0123"]
    rows = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "i int, text string")
    hits = lambda **how: [[h.rule for h in r.hits] for r in R.redacted(rows, "text", **how).orderBy("i").collect()]
    assert hits(spared=False) == [["high-entropy-token"], ["high-entropy-token"], []] and hits() == [[], [], []]


@pytest.mark.parametrize("name", ["c9_entropy", "d2_secret_counts", "d5_entropy_tokens"])
def test_long_work_on_a_small_file_is_dealt(spark, tmp_path, name):
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert analysis.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_entropy(spark):
    given = ["aabbccdd", "", "aaaa", "ab", None, "é漢é漢x"]
    found = [r.e for r in spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", T.entropy(F.col("t")).alias("e")).orderBy("i").collect()]
    assert found[:4] == [2.0, 0.0, 0.0, 1.0] and found[4] is None and round(found[5], 6) == 1.521928


def test_tasks_grow_with_the_rows(spark):
    from quernstone.operators import browse as B
    from quernstone.operators import filters as P
    from quernstone.operators.deal import dealt

    assert dealt(spark.range(10), ["id"], 10_000_000).rdd.getNumPartitions() == 20 and dealt(spark.range(10), ["id"], 10).rdd.getNumPartitions() == 8
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, None), (None, 1), (1, 2)], "k long, p long")
    keys = B.conversation_keys(rows, "k", "p")
    shown = P.roll_up(rows, "k", "p", F.col("p").isNotNull())
    pairs = B.shared_pairs(spark.createDataFrame([(k, f) for k in range(4) for f in range(3)] * 2, "k long, f long"), "k", "f", 2, 4)
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 5)], "a long, b long")
    changed = B.link_changes(links, "a", "b", links.where("a > 9"), links.where("a = 4"))
    assert sorted(map(tuple, keys.collect()), key=repr) == [(1, 1), (1, 2), (2, 1), (3, 3), (4, 4), (None, 1)]
    assert sorted(map(tuple, shown.collect())) == [(1, None), (3, 9), (4, None)]
    assert sorted(map(tuple, pairs.collect())) == [(a, b, 3) for a in range(4) for b in range(a + 1, 4)]
    assert [tuple(r) for r in changed.collect()] == [(1, 2)]
    for df in (keys, shown, pairs, changed):  # by the number of rows, not by their compressed bytes
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()


def test_open_threads_by_hand(spark, monkeypatch):
    """Blocks of any size give the same; all tokens are read only for projects that share too few of the decisions' own."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    some = lambda n: r.sample(words, n)
    cards = [(f"p{r.randrange(6)}", some(r.randrange(0, 9))) for _ in range(90)] + [(None, some(4)), ("p1", None)]
    decided = [(i, f"p{i % 6}", f"what {i}", some(6)) for i in range(25)]
    held = {(p, t) for p, ts in cards if p for t in ts or ()}
    want = {}
    for i, a, _, dt in decided:
        for b in {p for p, _ in held} - {a}:
            anchor = sum((a, t) in held and (b, t) in held for t in dt)
            best = max(len({*dt} & {*ts}) / (len(dt) * len(ts)) ** 0.5 for p, ts in cards if p == b and ts)
            if anchor >= 2 and best < 0.5 and sum((a, t) in held and (b, t) in held for t in words) >= 3:
                want[i] = max(want.get(i, 0), round(anchor * (1 - best / 0.5), 9))
    decisions = spark.createDataFrame(decided, "decision long, project string, what string, tokens array<string>")
    mentions = spark.createDataFrame(cards, "project string, tokens array<string>")
    tokens = spark.createDataFrame(sorted(held), "project string, token string")
    for asked, said, cells in ((1000, 10_000, 1 << 20), (4, 7, 30)):
        for name, value in (("ASKED", asked), ("SAID", said), ("CELLS", cells)):
            monkeypatch.setattr(C, name, value)
        found = C.open_threads(decisions, tokens, mentions, 100, mention=0.5).collect()
        assert {x.decision: round(x.score, 9) for x in found} == want and want
    rest = C.open_threads(decisions.where("decision < 2"), tokens, mentions, 100, overlap=7, mention=0.5).collect()
    assert {x.decision for x in rest} == {i for i in want if i < 2}  # no two decisions have seven tokens: the others count


def test_open_threads_leave_other_tokens_alone(spark):
    """Where the decisions' own tokens show which projects overlap, no other token is counted."""
    read = F.udf(lambda t: 1 / 0, "string")
    rows = spark.createDataFrame([(p, t) for p in "ab" for t in ("one", "two", "six")], "project string, token string")
    decisions = spark.createDataFrame([(1, "a", "x", ["one", "two", "six"])], "decision long, project string, what string, tokens array<string>")
    said = spark.createDataFrame([("b", ["seven"])], "project string, tokens array<string>")
    (row,) = C.open_threads(decisions, rows.withColumn("token", read("token")), said, 5, telling=rows).collect()
    assert (row.project, row.other, row.score) == ("a", "b", 3.0)


def test_telling_tokens(spark):
    cards = spark.createDataFrame([("a", ["x", "y", "x"])] * 15 + [("b", ["z", f"u{i}"]) for i in range(7)], "project string, tokens array<string>")
    among = spark.createDataFrame([("x",), ("z",), ("u3",)], "token string")
    every = {("b", "z")} | {("b", f"u{i}") for i in range(7)}  # 7 of 22 cards are over 0.3 of them, so z is generic
    assert {tuple(r) for r in C.telling_tokens(cards, "project", "tokens").collect()} == every - {("b", "z")}
    assert {tuple(r) for r in C.telling_tokens(cards, "project", "tokens", among).collect()} == {("b", "u3")}
