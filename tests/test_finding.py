"""The stored index against BM25 from the texts, the full search's parts, and the weights that scores tell."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from quernstone.operators import find as Q
from quernstone.operators import search as S
from quernstone.operators.index import TextIndex
from quernstone.operators.stored import new_path

WORDS = ["deploy", "deployed", "deployment", "the", "of", "billing", "bill", "cache", "漢字", "a_b", "x1"]


def rows(spark, n, first=0, seed=1):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    data = [(i, say(r.randrange(12)) if r.random() > 0.1 else None, say(r.randrange(60))) for i in range(first, first + n)]
    return spark.createDataFrame(data, "id long, title string, body string")


COLUMNS = {"title": 2.0, "body": 1.0}


def scores(df, key):
    return {r[key]: (round(r.score, 9), r.n_terms) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark):
    found = TextIndex.build(rows(spark, 150), "id", COLUMNS, new_path(spark, "index"))
    found.append(rows(spark, 60, 150, 2), "id", COLUMNS)
    return found


@pytest.fixture(scope="module")
def texts(spark):
    return rows(spark, 150).union(rows(spark, 60, 150, 2)).cache()


@pytest.mark.parametrize("query", ["the deployment of billing", "cache", "漢字 a_b", "nowhere", "deploy nowhere"])
def test_index_is_bm25_of_the_texts(index, texts, query):
    q = S.term_query(query)
    for terms, prefixes in ((q.all, frozenset()), (q.any, q.prefixes), (("deploy", "bill"), frozenset({"deploy", "bill"}))):
        want = scores(S.bm25(texts, "id", COLUMNS, terms, prefixes), "id")
        assert scores(index.bm25(terms, prefixes), "key") == want
    assert index.bm25(()).collect() == []


def test_merged_segments_answer_the_same(spark, index):
    one = index.merged(new_path(spark, "index"))
    terms, prefixes = ("deploy", "the"), frozenset({"deploy"})
    assert scores(one.bm25(terms, prefixes), "key") == scores(index.bm25(terms, prefixes), "key")
    assert one.postings().select("segment").distinct().count() == 1


def test_many_expansions_are_joined(index, monkeypatch):
    from quernstone.operators import index as module

    want = scores(index.bm25(("deploy",), frozenset({"deploy"})), "key")
    monkeypatch.setattr(module, "MOST_WORDS", 1)
    assert scores(index.bm25(("deploy",), frozenset({"deploy"})), "key") == want


def test_index_reads_only_the_folders_of_its_terms(index):
    plan = index.matching(("cache",), frozenset())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(term" in plan or "In(term" in plan


def test_half_written_segment_is_not_read(spark, tmp_path):
    found = TextIndex.build(rows(spark, 20), "id", COLUMNS, str(tmp_path / "i"))
    want = scores(found.bm25(("the",)), "key")
    found._postings(spark.createDataFrame([("the", 900, 1.0, 5.0)], "term string, key long, tf double, length double"), 1)
    assert scores(found.bm25(("the",)), "key") == want


def test_strict_then_relaxed(index):
    assert index.search(S.term_query("deploy cache"))[1] is False
    found, loose = index.search(S.term_query("deploy nowhere"))
    assert loose and found.count() > 0
    assert index.search(S.term_query("nowhere"))[0].isEmpty()


@pytest.fixture(scope="module")
def archive(spark, index, texts):
    known = texts.select(F.col("id").alias("key"), "id", F.col("id").alias("session"), (F.col("id") / 5).cast("long").alias("conversation"), F.col("id").alias("seq"), F.coalesce("title", F.lit("")).alias("text"))
    vectors = texts.selectExpr("id AS key", "array(CAST(cos(id) AS FLOAT), CAST(sin(id) AS FLOAT)) AS vector")
    return Q.Archive(known, texts.selectExpr("id AS key", "title"), {"body": index}, {"near": vectors}, {"body": 1.0, "near": 1.5}, "body")


def test_filters_come_before_the_cut(archive):
    f = Q.find(archive, "the", F.col("id") > 190, vectors=False)
    keys = {r.key for r in f.fused.collect()}
    assert keys and min(keys) > 190 and f.weights.keys() == {"titles", "body"}


def test_vectors_only_where_words_do_not_settle(archive):
    probe = [1.0, 0.0]
    assert "near" not in Q.find(archive, "deploy cache", query_vector=probe).weights
    assert "near" in Q.find(archive, "deploy cache", query_vector=probe, vectors=True).weights
    f = Q.find(archive, "deploy nowhere", query_vector=probe)
    assert f.relaxed == ("body",) and f.weights["body"] == 0.6 and f.weights["near"] == 1.5


def test_pages(archive):
    f = Q.find(archive, "deploy cache", limit=3)
    page, hits = f.sessions.collect(), f.hits.collect()
    assert len(page) == 3 and [r.score for r in page] == sorted((r.score for r in page), reverse=True)
    assert {r.conversation for r in hits} == {r.conversation for r in page} and len(hits) == sum(r.n_hits for r in page)
    assert all(sum(h.conversation == c for h in hits) <= S.PER_CONVERSATION for c in {h.conversation for h in hits})
    assert Q.find(archive, " ?! ").sessions.collect() == [] and Q.find(archive, "deploy", lists=[]).sessions.collect() == []


def test_lists_of_tri_state_filters():
    names, ghosts, live = ["titles", "exchanges", "ghosts", "prompts", "cards"], ("ghosts", "prompts"), ("titles", "exchanges")
    lists = lambda **x: Q.allowed_lists(names, ghost_lists=ghosts, live_lists=live, **x)
    assert lists() == names and lists(ghosts="only") == lists(status="ghost") == ["ghosts", "prompts", "cards"]
    assert lists(ghosts="exclude") == lists(sidechains="only") == lists(status="archived") == lists(by_file=True) == ["titles", "exchanges", "cards"]


def test_planted_weights_are_found(spark):
    r = random.Random(4)
    for trial in range(3):
        planted = {name: round(r.uniform(0.2, 2.0), 3) for name in ("a", "b", "c", "d")}
        hits = []
        for i in range(60):
            chosen = [["a"], ["b"], ["a", "c"], ["c", "d"], ["a", "b", "d"]][r.randrange(5) if i > 5 else min(i, 4)]
            prov = [(name, r.randrange(1, 80)) for name in chosen]
            hits.append((i, sum(planted[n] / (60 + rank) for n, rank in prov), prov))
        page = spark.createDataFrame(hits, "key long, score double, provenance array<struct<list:string,rank:long>>")
        assert {k: round(v, 6) for k, v in Q.solve_weights(page).items()} == planted
        assert all(abs(x.residual) < 1e-9 for x in Q.ledger(page, planted).collect())
    alone = spark.createDataFrame([(1, 0.5, [("a", 1), ("b", 2)])], "key long, score double, provenance array<struct<list:string,rank:long>>")
    assert Q.solve_weights(alone) == {}


def test_best_side(spark):
    rows = spark.createDataFrame([("the cache broke", "nothing", False), ("nothing", "cache", False), ("cache", "cache bill", False), ("cache", "cache", True), (None, None, False), ("x", "the CACHE is big", False)], "u string, a string, dull boolean")
    side = Q.best_side([("user", F.col("u")), ("assistant", F.col("a"))], "the cache", ("cache", "bill"))
    assert [r.s for r in rows.select(side.alias("s")).collect()] == ["user", "assistant", "assistant", "user", None, "assistant"]


def test_index_of_few_terms(spark):
    """Made for stated terms it answers as the whole index does, writes nothing else, and refuses other terms."""
    from quernstone.operators.index import Terms

    texts = [("the licensed part of it", "x the"), ("licensing, other words", None), ("nothing of that", "license the the"), (None, None)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, a string, b string")
    terms, open_ends = ("the", "of", "licens"), frozenset(["licens"])
    whole = TextIndex.build(docs, "id", {"a": 1.0, "b": 2.0}, new_path(spark, "index"))
    few = TextIndex.build(docs, "id", {"a": 1.0, "b": 2.0}, new_path(spark, "index"), Terms(frozenset(terms), open_ends))
    assert sorted(few.bm25(terms, open_ends).collect()) == sorted(whole.bm25(terms, open_ends).collect()) != []
    assert {r.term for r in few.postings().select("term").collect()} == {"the", "of", "licensed", "licensing", "license"}
    assert few.totals().first()[:2] == whole.totals().first()[:2]
    with pytest.raises(ValueError):
        few.bm25(("words",))
    none = TextIndex.build(docs, "id", {"a": 1.0}, new_path(spark, "index"), Terms(frozenset(["absent"])))
    assert none.bm25(("absent",)).collect() == [] and none.totals().first().n == 4
