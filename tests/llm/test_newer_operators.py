"""Ranked search, substring dedup and the Merkle manifest against brute force, with awkward rows and hot groups."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quernstone.llm import merkle, queries, ranking, suffixes
from quernstone.llm.common import table

SF = "/root/testdata/sf0.001"
CLASH = ["g", "k", "leaf", "other", "part", "at", "n", "term", "terms", "tf", "item", "score", "rank", "doc", "key", "core", "name", "begin", "end", "runs", "open", "own", "none", "kept", "cut_runs", "twice", "__doc", "__key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- ranked search


def ranked_by_hand(docs, items, top=20):
    words = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(d, words(t)) for d, t in docs if words(t)]
    n, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = [t for x in sorted({t for i, t in items if i == item and t}) for t in words(x)]
        rows = []
        for d, w in held:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if s > 0:
                rows.append((-s, d is not None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(rows)[:top], 1)]
    return out


def ranked(spark, docs, items, top=20):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    return [tuple(r) for r in ranking.ranked_search(docs.repartition(5), items, top).orderBy("item_id", "rank").collect()]


def test_ranking_by_hand(spark, monkeypatch):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(["a", "B", "c1", "dé", "漢字", "x_y", "zz", "q"]) for _ in range(n))
    docs = [(i, say(r.randrange(0, 40))) for i in range(200)] + [(7, "a b c1"), (None, "a b c1"), (None, "zz"), (900, None), (901, ""), (902, " -_- "), (903, "a b c1"), (903, "a b c1"), (904, say(30_000))]
    items = [(1, "A b"), (1, "A b"), (2, "dé zz zz nowhere"), (3, None), (4, ""), (None, "a"), (5, "x_y 漢字"), (6, "Q"), (6, "zz")]
    assert ranked(spark, docs, items) == ranked_by_hand(docs, items)
    assert ranked(spark, docs, items, 3) == ranked_by_hand(docs, items, 3)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 3)  # many blocks of items
    assert ranked(spark, docs, items) == ranked_by_hand(docs, items)


def test_ranking_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None)], [(1, None)]) == []


def test_slices_of_a_task_make_no_difference(monkeypatch):
    r = np.random.default_rng(5)
    rows = [type("R", (), {"item": i, "term": f"t{t}", "n": int(r.integers(1, 3))}) for i in range(30) for t in r.choice(50, 8, replace=False)]
    block = ranking.block_of(rows, {f"t{t}": int(r.integers(0, 5000)) for t in range(45)})
    of = np.sort(r.integers(0, 300, 3000))
    term, tf, m = r.integers(0, 45, 3000), r.integers(1, 9, 3000), r.integers(75, 200, 300)
    item, doc, score = ranking.scored(block, of, term, tf, m, 300)
    want = defaultdict(int)
    for o, t, f in zip(of.tolist(), term.tolist(), tf.tolist()):
        for j in range(block.bounds[t], block.bounds[t + 1]):
            want[int(block.item[j]), o] += int(block.weight[j]) * (1_000_000_000 * f // (1000 * f + 12 * int(m[o])))
    assert {(i, d): s for i, d, s in zip(item.tolist(), doc.tolist(), score.tolist())} == want


@given(st.lists(st.integers(0, 2**40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_radix_order(keys):
    keys = np.array(keys, np.int64)
    assert ranking.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


# --- substring dedup


def cut_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d))), hashlib.sha256(kept).hexdigest()))
    return out


def cut(spark, texts, length, clash=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df
    found = suffixes.dedup_substrings(df, length)
    assert set(found.columns) == {*df.columns, "kept", "cut_runs"}
    rows = sorted(found.select("doc_id", "text", "kept", "cut_runs").collect())
    assert all((r.kept is None) == (r.text is None) for r in rows)
    return [(len((r.text or "").encode()), sum(x.end - x.begin for x in r.cut_runs), len(r.cut_runs), hashlib.sha256(r.kept or b"").hexdigest()) for r in rows]


def pasted(r, length, n):
    base = ["".join(r.choice("abcdef é漢") for _ in range(r.randrange(length, 6 * length))) for _ in range(12)]
    texts = [None, "", "x" * length, "x" * (3 * length + 5), "ab" * 200, "y" * (length - 1), base[0], base[0]]
    for _ in range(n):
        t = ""
        for _ in range(r.randrange(1, 5)):
            b = r.choice(base)
            i = r.randrange(len(b))
            t += b[i : r.randrange(i, len(b) + 1)] + ("".join(r.choice("abc") for _ in range(r.randrange(30))) if r.random() < 0.7 else "")
        texts.append(t)
    return texts


@pytest.mark.parametrize("length", [7, 40, 64, 101])
def test_substrings_by_hand(spark, length):
    texts = pasted(random.Random(length), length, 70)
    assert cut(spark, texts, length) == cut_by_hand(texts, length)


def test_substrings_of_a_large_group(spark):
    """A third of all rows are copies of one text, another third shares a passage of it with text of their own around."""
    r = random.Random(8)
    own = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    body = own(700)
    texts = [body] * 120 + [own(r.randrange(200)) + body[90:600] + own(r.randrange(200)) for _ in range(120)] + [own(500) for _ in range(120)]
    assert cut(spark, texts, 400, False) == cut_by_hand(texts, 400)


def test_substrings_of_the_table(spark):
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").select("text").collect()]
    rows = sorted(tuple(r) for r in queries.op12_suffixes(spark, SF).collect())
    assert [r[1:] for r in rows] == cut_by_hand(texts, 400)


@pytest.mark.parametrize("piece", [50, 97, 1000])
def test_spans_hold_every_string_once(monkeypatch, piece):
    """Whatever the pieces, each string's anchor depends on its bytes only."""
    monkeypatch.setattr(suffixes, "PIECE", piece)
    data = [t.encode() for t in pasted(random.Random(piece), 30, 40) if t]
    body, ends = b"".join(data), np.cumsum([len(d) for d in data])
    place, starts = {}, []
    for at, begin, end, _ in suffixes.spans(np.frombuffer(body, np.uint8), ends, 30, 15):
        for a, b, e in zip(at.tolist(), begin.tolist(), end.tolist()):
            for p in range(b, e + 1):
                starts.append(p)
                assert 0 <= a - p <= 15 and place.setdefault(body[p : p + 30], a - p) == a - p
    assert sorted(starts) == [e - len(d) + i for d, e in zip(data, ends.tolist()) for i in range(len(d) - 29)]


def test_long_text_of_one_letter(spark):
    (row,) = suffixes.dedup_substrings(spark.createDataFrame([(None, "z" * 150_000)], "doc_id long, text string"), 400).collect()
    assert row.kept == b"" and [tuple(x) for x in row.cut_runs] == [(0, 150_000)]


def test_substrings_of_nothing(spark):
    assert cut(spark, [], 40) == [] and cut(spark, [None, "", "a"], 40) == cut_by_hand([None, "", "a"], 40)


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs_by_hand(nodes):
    """The root, and for each leaf [(place, others), ...]."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            b = i // 3 * 3
            way.append((i - b, level[b:i] + level[i + 1 : b + 3]))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def manifest_by_hand(rows):
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text))
    changed = lambda r: r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, changed(r)), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: proofs_by_hand([x[2] for x in sorted(groups[g])]) for g in names}
    root, up = proofs_by_hand([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, up):
        for (_, _, mine, other, d), way in zip(sorted(groups[g]), trees[g][1]):
            folded = other
            for place, others in way + above:
                folded = sha(*others[:place], folded, *others[place:])
            out.append((d, mine, trees[g][0], root, sha(*(x for _, others in way + above for x in others)), folded, folded == root))
    return sorted(out, key=repr)


def manifest(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.merkle_manifest(df, checked={"text": altered}).collect()), key=repr)


def archive(r, n, sources):
    rows = [(r.randrange(10**6), r.choice([None, "", "a\nb", "é\n\n漢", "plain"]), r.choice([None, "en"]), r.choice(sources), r.choice([None, 3])) for _ in range(n)]
    return rows + rows[:3] + [(None, "a\nb", None, sources[0], 1), (None, None, None, None, None)]


@pytest.mark.parametrize(("n", "part", "block"), [(200, 1 << 15, 13), (200, 16, 13), (400, 9, 2), (300, 5, 1), (1, 1, 1)])
def test_manifest_by_hand(spark, monkeypatch, n, part, block):
    """Partitions that cut runs anywhere, and blocks of few levels, so that peaks are merged in both steps."""
    monkeypatch.setattr(merkle, "PART_ROWS", part)
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block)
    rows = archive(random.Random(n + part), n, ["hot"] * 6 + ["b", "B", "é", None, ""])
    assert manifest(spark, rows) == manifest_by_hand(rows)


def test_manifest_of_one_row_and_of_none(spark):
    assert manifest(spark, []) == []
    one = [(2, "x" * 100_000 + "\n", "en", "a", 4)]
    assert manifest(spark, one) == manifest_by_hand(one)


def test_altered_rows_are_found(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in queries.op13_merkle(spark, SF).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")))


def test_nodes_of_the_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 20)
    docs = table(spark, SF, "documents")
    nodes = merkle.manifest_nodes(docs).collect()
    per = Counter(r.source for r in docs.select("source").collect())
    assert len(nodes) == sum(sum(merkle.sizes(n)) for n in per.values())
    known = {(r.g, r.level, r.idx): r.digest for r in nodes}
    for (g, level, i), x in known.items():
        if level:
            run = [known[g, level - 1, j] for j in range(3 * i, 3 * i + 3) if (g, level - 1, j) in known]
            assert x == sha(*run)


@given(st.integers(1, 120), st.lists(st.integers(1, 119), max_size=5))
@settings(max_examples=80, deadline=None)
def test_mountains_of_any_cut(n, cuts):
    leaves = [sha(str(i)) for i in range(n)]
    bounds = sorted({0, n, *[c for c in cuts if c < n]})
    peaks = []
    for a, b in zip(bounds, bounds[1:]):
        found = merkle.Mountains(a, n, leaves[a:b])
        assert all(leaves[a:b] == found.nodes[0] for _ in (0,))
        peaks += found.peaks
    size = merkle.sizes(n)
    made = {(level, i): x for level, i, x in [*peaks, *merkle.merged(peaks, n, len(size))]}
    assert made[len(size) - 1, 0] == proofs_by_hand(leaves)[0]
