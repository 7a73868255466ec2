from __future__ import annotations

import random
from itertools import combinations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert len(corpus_pipeline.STAGES) in (4, 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = docs.count()
        assert 0.5 * n < after <= n, name
        n = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == n


def test_decisions(spark):
    rows = [(1, "plain words of an ordinary text that stays here", "en"), (2, "12345 !!!", None), (3, None, None), (4, "plain words of an ordinary text that stays here", "en"), (None, "plain words without an id", None), (5, "shared line one\nshared line two\nshared line three\nown", "en"), (6, "shared line one\nshared line two\nshared line three", "en")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["language"](spark, docs, SF).collect()} == {1, 4, None, 5, 6}
    lines = {r.doc_id: r.text for r in stages["lines"](spark, docs, SF).collect()}
    assert 6 not in lines and lines[5] == rows[5][1]
    assert {r.doc_id for r in stages["near_copies"](spark, docs, SF).collect()} == {1, 2, 3, None, 5}  # 6 shares 5 of 6 shingles with 5
    assert stages["decontaminated"](spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_empty(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(texts, similarity=0.8):
    """Brute force: the least member of each text's group, over all pairs."""
    least = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((least[a], least[b]))
            least = [low if x == high else x for x in least]
    return least


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    common = rng.choices(words, k=40)
    texts = []
    for size, changes in [(60, 1), (100, 2), (200, 4), (400, 8)] * 12:
        first = rng.choices(words, k=size) + (common if size == 200 else [])  # a passage that unrelated texts share
        texts.append(" ".join(first))
        for _ in range(2):
            copy = list(first)
            for i in rng.sample(range(size), changes):
                copy[i] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()}
    least = groups(texts)
    assert all(i in kept for i in set(least))  # nothing goes that all pairs would keep
    later = [i for i, x in enumerate(least) if x != i]
    assert sum(i not in kept for i in later) >= 0.95 * len(later)


def test_near_copies_hot_group(spark):
    rng = random.Random(6)
    first = rng.choices([f"w{i}" for i in range(2000)], k=200)
    texts = [" ".join(first[:i] + [f"own{i}"] + first[i + 1 :]) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()] == [0]


def test_similar_links_among_common_passages(spark, monkeypatch):
    """Long texts made of passages that many others hold too: no link is lost, whatever the passages' first members are."""
    from quernstone.llm import simhash
    from quernstone.llm.components import components

    rng = random.Random(8)
    pool = [[f"p{i}x{j}" for j in range(16)] for i in range(40)]
    texts = []
    for i in range(300):
        first = [w for p in sorted(rng.sample(pool, 31)) for w in p]
        texts.append(" ".join(first))
        for at in rng.sample(range(len(first)), 8):
            first[at] = f"c{i}-{at}"
        texts.append(" ".join(first))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    least = groups(texts)
    for frequent, members in ((4, 7), (64, 1_000)):  # passages last in the order, and blocks; neither
        monkeypatch.setattr(simhash, "FREQUENT", frequent)
        monkeypatch.setattr(simhash, "MEMBERS", members)
        root = {r.node: r.root for r in components(simhash.similar_links(rows), "a", "b").collect()}
        assert [root.get(i, i) for i in range(len(texts))] == least
    assert sum(i != x for i, x in enumerate(least)) >= 250


def test_near_copies_tells_texts_of_one_id_apart(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, one), (1, two), (2, two), (None, one), (3, None), (4, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, 5, 6) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k int, own int")
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(1, one), (1, two)]
    assert kept.count() == 3


@pytest.mark.parametrize("shared", [20, 60, 80])
def test_near_copies_among_boilerplate(spark, shared):
    """Pairs of 100 words of which all documents share some; two of a pair's own words are changed."""
    rng = random.Random(shared)
    boilerplate = [f"b{i}" for i in range(shared)]
    texts = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(100 - shared)]
        copy = list(own)
        at = rng.randrange(len(own) - 1)
        copy[at], copy[at + 1] = f"c{i}", f"d{i}"
        texts += [" ".join(boilerplate + own), " ".join(boilerplate + copy)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()}
    least = groups(texts)
    later = [i for i, x in enumerate(least) if x != i]
    assert len(later) >= 100 and sum(i not in kept for i in later) >= 0.9 * len(later)
    if shared < 80:  # there unrelated documents are similar enough for equal fingerprints of three words, which link too
        assert all(i in kept for i in set(least))


def test_stages_on_awkward_rows(spark):
    """Very long texts, ties, repeated rows, nulls and columns named as the operators name theirs."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, long), (1, long), (2, long), (3, None), (None, "a few words of an ordinary text"), (4, "line one here\nline one here\nline one here"), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 7, 7, 7, 7, 7, 7) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, own int, line_text int, k int, f int, n int, lang_pred int")
    kept = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    for name in ("language", "lines", "near_copies", "decontaminated"):
        assert kept[name].columns == docs.columns
    ids = {name: sorted(str(r.doc_id) for r in kept[name].select("doc_id").collect()) for name in kept}
    assert ids["language"] == ["1", "1", "2", "4", "None"] and ids["near_copies"] == ["1", "3", "4", "None"]
    assert set(ids["decontaminated"]) == set(ids["packed"]) == {"1", "2", "3", "4", "5", "None"}
