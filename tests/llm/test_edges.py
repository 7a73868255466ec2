"""Nulls, empty tables, repeated rows, extra columns and very long texts, for every operator and pipeline stage."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quernstone.llm import decontaminate, langid, linededup, packing, pii, quality, simhash, substrings, tokencount, toxicity

CLASH = ["key", "word", "w", "f", "doc", "at", "n", "end", "score", "held_out", "raw", "rank", "node", "root", "line_text", "n_lines", "bin", "length", "shard", "items", "win", "x", "__text", "__id", "least", "component_id", "h", "__doc", "__key", "__gone", "__of", "lines_gone", "own", "c", "v"]


def bench(spark):
    return spark.createDataFrame([(1, "one two three"), (None, "a b"), (2, None)], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


APPLY = {
    "langid": lambda s, d: langid.predict_languages(d, langid.sample_languages(d, "doc_id", "text", "lang")),
    "tokencount": lambda s, d: tokencount.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "decontaminate": lambda s, d: decontaminate.contamination(d, bench(s)),
    "packing": lambda s, d: packing.best_fit_packing(d, public_tokenizers.path("word_bpe_49k.json")),
    "pii": lambda s, d: pii.personal_data(d),
    "substrings": lambda s, d: substrings.repeated_passages(d),
    "linededup": lambda s, d: linededup.dedup_lines(d),
    "quality": lambda s, d: quality.quality_rules(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.train(d, labels(s))),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "one two three", None, "b", 13),
    (None, None, None, None, None), (4, "  \n\n ", "de", "c", 5), (5, LONG, "fr", None, len(LONG)), (6, "1234567 !!", "", "c", 10), (7, "line\nline\nline\nline\nline\nline", None, "c", 29), (8, "é漢字 ퟿ \U0001f600", "xx", "c", 4),
]
ONE_ROW_EACH = set(APPLY) - {"substrings", "packing"}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


@pytest.mark.parametrize("name", sorted(APPLY))
def test_awkward_rows(spark, docs, name):
    rows = APPLY[name](spark, docs).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
        twice = [r for r in rows if r.doc_id == 1]
        assert twice[0] == twice[1]
    elif name == "packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS} and sum(r.doc_id == 1 for r in rows) == 2
    else:
        assert rows == []


@pytest.mark.parametrize("name", sorted(APPLY))
def test_empty_table(spark, docs, name):
    assert APPLY[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(APPLY))
def test_all_texts_null(spark, docs, name):
    nulls = docs.withColumn("text", F.lit(None).cast("string"))
    rows = APPLY[name](spark, nulls).collect()
    assert len(rows) == (0 if name == "substrings" else len(ROWS))


def test_defined_results(spark, docs):
    lang = {r.doc_id: r for r in APPLY["langid"](spark, docs).collect()}
    assert {lang[d].lang_pred for d in (2, 3, 4, 6)} == {"und"} and lang[2].score == 0 and lang[None].held_out
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens) for r in APPLY["tokencount"](spark, docs).collect()}
    assert tokens[2] == tokens[3] == (0, 0)
    hits = {r.doc_id: r for r in APPLY["decontaminate"](spark, docs).collect()}
    assert hits[1].contaminated and hits[1].n_hit == 3 and not hits[2].contaminated and hits[2].n_words == 0
    same = {r.doc_id: (r.fingerprint, r.component_id) for r in APPLY["simhash"](spark, docs).collect()}
    assert same[2] == same[3] == same[4] == ("0" * 16, 2)
    lines = {r.doc_id: r for r in APPLY["linededup"](spark, docs).collect()}
    assert lines[2].line_text is None and lines[2].n_lines == 0 and lines[7].line_text == "line\nline"[: len(lines[7].line_text)]
    assert set(lines[1].asDict()) >= set(docs.columns)


def test_no_benchmark_and_no_labels(spark, docs):
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench(spark).limit(0)).collect())
    assert len({r.score for r in toxicity.toxicity(docs, toxicity.train(docs, labels(spark).limit(0))).collect()}) == 1


def test_repeated_passages_ignore_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in substrings.repeated_passages(rows).collect()) == [(1, 1), (2, 1)]
