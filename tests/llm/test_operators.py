"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from compare import compare, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quernstone.llm import components, decontaminate, linededup, packing, pii, quality, queries, simhash, substrings, tokencount
from quernstone.llm.common import table

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "a", "İ<|endoftext|>ı", "don't  we'll x\xa0 \t\n y", "x" * 3000, "é" * 50 + " 漢字かな 123 '", "\x00\x1f '", "<|endoftext|><|endoftext|> a"]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(r, n, most=10**9):
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE_SQL[name]) == ""


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    rows = queries.op1_langid(spark, sf).join(lang, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_learned_without_the_held_out(spark):
    docs = table(spark, SF, "documents")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang")))
    from quernstone.llm.langid import sample_languages

    assert sample_languages(docs, "doc_id", "text", "lang") == sample_languages(hidden, "doc_id", "text", "lang")


def test_languages_with_large_scripts_and_many_languages():
    from quernstone.llm.langid import Languages

    r = random.Random(12)
    scripts = {"aa": [chr(0x4E00 + i) for i in range(1500)], "bb": [chr(0xAC00 + i) for i in range(1500)], "cc": list("abcdefghijklm"), "dd": list("nopqrstuvwxyz")}
    lexicon = {k: ["".join(r.choice(v) for _ in range(r.randrange(2, 7))) for _ in range(300)] for k, v in scripts.items()}
    say = lambda k, n: " ".join(r.choice(lexicon[k]) for _ in range(n))
    model = Languages(tuple((k, say(k, 3000)) for k in sorted(lexicon)))
    asked = [(k, say(k, 20)) for k in lexicon for _ in range(20)]
    assert model.predict([x for _, x in asked])[0] == [k for k, _ in asked]
    lexicon = {f"l{i:03}": ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(40)] for i in range(300)}
    model = Languages(tuple((k, say(k, 120)) for k in sorted(lexicon)))
    asked = [(k, say(k, 12)) for k in r.sample(sorted(lexicon), 40)]
    assert np.mean([a == k for a, (k, _) in zip(model.predict([x for _, x in asked])[0], asked)]) > 0.95


def test_personal_data_in_long_stretches_of_digits():
    import time

    began = time.time()
    assert len(list(pii.triggered("1" * 1_000_000))) == 1  # one token
    found = list(pii.triggered("7 " * 500_000))
    assert time.time() - began < 60 and max(b - a for a, b in found) <= 2 * pii.MOST_REGION + 2 * pii.REACH
    assert found[0][0] == 0 and all(x[1] >= y[0] for x, y in zip(found, found[1:]))


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_token_counts_equal_the_library(spark, texts, libraries):
    every = [t or "" for t in texts] + ODD
    assert tokencount.count_tokens(every, BYTES) == [len(libraries[0].encode(t, add_special_tokens=False).ids) for t in every]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="aest'lrvd \n\t1é<|>", max_size=60))
def test_token_counts_of_any_text(libraries, a, b):
    for t in (a, b, a + b):
        assert tokencount.count_tokens([t], BYTES) == [len(libraries[0].encode(t, add_special_tokens=False).ids)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="aest'lrvdİß \n\t1é<|>", max_size=60))
def test_word_ids_of_any_text(libraries, a, b):
    for t in (a, b, a + b):
        assert np.frombuffer(packing.word_ids(WORDS).of(t), "<u4").tolist() == libraries[1].encode(t, add_special_tokens=False).ids


ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return x.translate({i: i + 32 for i in range(65, 91)})


def test_contamination_by_brute_force(spark):
    r = random.Random(1)
    item = [words(r, n) for n in (30, 12, 10, 4, 1)] + ["", "!!"]
    texts = [words(r, 20) + " " + item[0] + " " + words(r, 5), "X" + item[1].upper() + "?" + item[1], item[2], item[3] * 2, item[3] + " " + item[4], "", words(r, 9), " ".join(item[0].split()[5:15]), " ".join(item[0].split()[5:14])]
    got = {x.doc_id: x for x in decontaminate.contamination(docs_of(spark, [*texts, None]), spark.createDataFrame(list(enumerate(item)), "item_id long, text string")).collect()}
    windows = defaultdict(set)
    for i, t in enumerate(item):
        w = ASCII_WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    for d, t in enumerate(texts):
        w, hit, ids = ASCII_WORD.findall(lower(t)), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= of
        x = got[d]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(ids), bool(hit)), d
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert got[len(texts)].n_words == 0


def test_contamination_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, queries.op3_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, queries.op3_decontaminate(spark, SF).collect())) == want


def check_packing(rows, texts, library, capacity=4096):
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        of_doc[x.doc_id].append(x)
        of_seq[x.sequence_id].append(x)
    assert set(of_doc) == set(range(len(texts)))
    for d, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(of_doc[d], key=lambda x: x.piece)
        assert [x.start for x in parts] == list(range(0, len(ids), capacity))
        for x in parts:
            piece = ids[x.start : x.start + capacity]
            assert x.length == len(piece) and x.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    for held in of_seq.values():
        held.sort(key=lambda x: x.offset)
        assert [x.offset for x in held] == [sum(y.length for y in held[:i]) for i in range(len(held))]
        assert sum(x.length for x in held) <= capacity
    return len(of_seq), -(-sum(x.length for x in rows) // capacity)


def test_packing_round_trip(spark, texts, libraries):
    rows = packing.best_fit_packing(docs_of(spark, texts + ODD), WORDS).collect()
    used, least = check_packing(rows, texts + ODD, libraries[1])
    assert used <= least * 1.02 + 1


def test_packing_on_many_islands(spark, monkeypatch, libraries):
    monkeypatch.setattr(packing, "ISLAND", 40)
    r = random.Random(3)
    texts = [words(r, r.randrange(1, 40), 99) for _ in range(400)]
    rows = packing.best_fit_packing(docs_of(spark, texts), WORDS, capacity=64).collect()
    used, least = check_packing(rows, texts, libraries[1], 64)
    assert used <= least * 1.1 + 2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15],
    }


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-+%_ 0123456789()é\n", max_size=80))
def test_base_patterns(t):
    assert pii.base_spans(t) == plain_base(t)


def test_personal_data_keeps_base_spans(spark, texts):
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    for t, x in zip(texts, pii.personal_data(docs_of(spark, texts)).orderBy("doc_id").collect()):
        base = plain_base(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in base for a, b in base[k])
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(x.spans.split(","))


def test_field_on_held_out_sentences():
    r, field, right, found, gold_n = random.Random(99), pii.trained(), 0, 0, 0
    for _ in range(300):
        text, gold = pii.sentence(r)
        got = set(field.decode(pii.Region(text)))
        right, found, gold_n = right + len(got & set(gold)), found + len(got), gold_n + len(gold)
    assert right / found > 0.85 and right / gold_n > 0.85


def test_repeated_passages(spark):
    r = random.Random(5)
    passage, other = words(r, 70), words(r, 60)
    near = passage.split()
    near[20], near[55] = "changed", "too"
    texts = [words(r, 100) + " " + passage, words(r, 150), passage + " " + words(r, 30), words(r, 20) + " " + " ".join(near), other, other, words(r, 30) + " " + " ".join(passage.split()[:30]), "short", None, "", words(r, 200)]
    got = {x.doc_id: x for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    assert set(got) == {0, 2, 3, 4, 5}
    assert {d: x.class_id for d, x in got.items()} == {0: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    assert 50 <= got[3].n_words <= 70
    assert got[0].passages == "100-170" and got[2].passages == "0-70" and got[4].n_words == 60


def test_repeated_passages_of_many_documents(spark):
    r = random.Random(6)
    shared = [words(r, 55) for _ in range(12)]
    texts, want = [], set()
    for d in range(400):
        body = [words(r, r.randrange(20, 120)) for _ in range(2)]
        if d % 3 == 0:
            body.insert(1, shared[d % 12])
            want.add(d)
        texts.append(" ".join(body))
    got = {x.doc_id for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    assert want <= got and len(got - want) <= 1


def test_repeated_passages_whose_lines_stand_elsewhere(spark):
    """An earlier, unrelated document holds a line of the passage that two later ones share."""
    r = random.Random(8)
    texts, want = [], set()
    for k in range(60):
        passage = words(r, 50).split()
        line = " ".join(passage[10:40] if k % 2 else passage[:20])
        texts += [f"{words(r, 80)} {line} {words(r, 80)}", f"{words(r, 60)} {' '.join(passage)} {words(r, 60)}", f"{words(r, 30)} {' '.join(passage)} {words(r, 90)}"]
        want |= {3 * k + 1, 3 * k + 2}
    got = {x.doc_id: x for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    assert set(got) == want
    assert all(got[d].class_id == d - (d % 3 == 2) and got[d].n_words >= 50 for d in want)


def test_repeated_passages_with_many_heads(spark):
    """Groups of a common line in which different passages follow it."""
    r = random.Random(9)
    line, texts = words(r, 30), []
    for k in range(40):
        tail = words(r, 30)
        texts += [f"{words(r, 70)} {line} {tail} {words(r, 70)}" for _ in range(2 + k % 2)]
    got = {x.doc_id: x.class_id for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    assert set(got) == set(range(len(texts)))
    assert len(set(got.values())) == 40


@pytest.mark.parametrize("n, changes", [(50, 1), (100, 2), (200, 4)])
def test_recall_of_near_passages(spark, n, changes):
    """Passages of n words with so many words changed, at similarity 0.8 and more, of which a line stands elsewhere too."""
    r = random.Random(n + changes)
    texts, pairs = [], 100
    for _ in range(pairs):
        passage = words(r, n).split()
        other = list(passage)
        for i in r.sample(range(n), changes):
            other[i] = words(r, 1)
        grams = [{tuple(p[i : i + 5]) for i in range(n - 4)} for p in (passage, other)]
        if len(grams[0] & grams[1]) < 0.8 * len(grams[0] | grams[1]):
            other = list(passage)
        texts += [f"{words(r, 80)} {' '.join(passage[5:30])} {words(r, 80)}", f"{words(r, 60)} {' '.join(passage)} {words(r, 60)}", f"{words(r, 30)} {' '.join(other)} {words(r, 90)}"]
    got = {x.doc_id: x.class_id for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    found = sum(3 * k + 1 in got and got[3 * k + 1] == got.get(3 * k + 2) for k in range(pairs))
    assert found >= (0.97 if changes else 1) * pairs
    assert not any(d % 3 == 0 for d in got)


@pytest.mark.xfail(reason="op6 loses links among documents of nothing but the same few lines (README): 21 of 27 when last measured")
def test_repeated_passages_by_brute_force(spark):
    """Documents made of four lines alone, with words changed. Every pair of documents at every shift is compared as the
    operator compares candidates, that is in order: lines that stand in another order are similar as sets only (README)."""
    r = random.Random(21)
    pool = [words(r, r.randrange(8, 22)) for _ in range(4)]
    texts = []
    for _ in range(24):
        w = " ".join(r.choice(pool) for _ in range(r.randrange(4, 8))).split()
        for i in r.sample(range(len(w)), len(w) // 120):
            w[i] = words(r, 1)
        texts.append(" ".join(w))
    n = substrings.PASSAGE - substrings.SHINGLE + 1
    grams = [[tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)] for t in texts]
    hashed = [substrings.shingles(t) for t in texts]
    alike = lambda x, y: any(len(m[0]) > 30 and substrings.similar_passages(x, y, *m, n) for shift in range(-len(x), len(y), 4) for m in [substrings.matches(x, y, shift, n)])
    linked = {(a, b) for a in range(len(texts)) for b in range(a) if alike(hashed[a], hashed[b])}
    got = {x.doc_id: x.class_id for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    same = sum(a in got and got[a] == got.get(b) for a, b in linked)
    assert len(linked) > 20
    assert same >= 0.9 * len(linked), (same, len(linked))
    links = substrings.passage_links(docs_of(spark, texts).withColumnRenamed("doc_id", "doc"), n).collect()
    for x in links:
        mine, other = set(grams[x.doc][x.begin : x.end]), set(grams[x.other][x.other_begin : x.other_end])
        assert x.end - x.begin >= n and len(mine & other) >= 0.8 * len(mine | other)


def test_compact_windows_of_equal_values():
    r = np.random.default_rng(3)
    for n, length in ((9, 3), (30, 4), (60, 7)):
        for _ in range(40):
            values = r.integers(1, 6, n).astype(np.uint64)
            # every range of the length is in the window of its leftmost least value
            found = {c: (f, e) for f, c, e in substrings.compact_windows(values, length)}
            for i in range(n - length + 1):
                c = i + int(np.argmin(values[i : i + length]))
                assert found[c][0] <= i and i + length - 1 <= found[c][1]


def test_repeated_passages_after_a_recurring_line(spark):
    """The head holds a line before the passage too; three different texts share one passage."""
    r = random.Random(11)
    texts, want = [], {}
    for k in range(40):
        line, tail = words(r, 35), words(r, 15)
        texts += [f"{words(r, 20)} {line} {words(r, 200)} {line} {tail} {words(r, 60)}", f"{words(r, 70)} {line} {tail} {words(r, 50)}", f"{line} {tail} {words(r, 90)}"]
        want |= {3 * k: "255-305", 3 * k + 1: "70-120", 3 * k + 2: "0-50"}
    got = {x.doc_id: x for x in substrings.repeated_passages(docs_of(spark, texts)).collect()}
    assert {d: x.passages for d, x in got.items()} == want
    assert {x.n_links for x in got.values()} == {2}


def plain_line_dedup(texts):
    """Later copies of runs of 3 or more lines, or of 100 or more characters on 1, 2, 4, ... lines."""
    seqs = {d: [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for d, t in enumerate(texts) if t is not None}
    gone = defaultdict(set)
    for k in (1, 2, 3, 4, 8, 16):
        first = {}
        for d in sorted(seqs):
            for p in range(len(seqs[d]) - k + 1):
                run = tuple(x for _, x in seqs[d][p : p + k])
                if run in first and (k >= linededup.MIN_LINES or sum(map(len, run)) >= linededup.MIN_CHARS):
                    gone[d] |= {i for i, _ in seqs[d][p : p + k]}
                first.setdefault(run, (d, p))
    return gone


def test_line_dedup_by_brute_force(spark):
    r = random.Random(7)
    pool = [words(r, 3, 50) for _ in range(12)] + ["", "  ", "x" * 120]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(0, 14))) for _ in range(60)] + [None, ""]
    want = plain_line_dedup(texts)
    for x in linededup.dedup_lines(docs_of(spark, texts)).collect():
        assert x.lines_gone == sorted(want[x.doc_id]), x.doc_id
        if x.text is not None:
            assert x.line_text == "\n".join(y for i, y in enumerate(x.text.split("\n")) if i not in want[x.doc_id])


def test_line_dedup_with_shuffled_texts(spark, monkeypatch):
    want = sorted(map(str, queries.op7_linededup(spark, SF).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_DOCS", -1)
    assert sorted(map(str, queries.op7_linededup(spark, SF).collect())) == want


def test_quality_by_brute_force(spark, texts):
    for t, x in zip(texts + ODD, quality.quality_rules(docs_of(spark, texts + ODD)).orderBy("doc_id").collect()):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        places = defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        repeat = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert x.base_failed == (len(w) < 20 or 100 * len(repeat) > 30 * len(w)) and not (x.base_failed and x.kept)


def test_quality_bands(spark):
    r = random.Random(8)
    noise = "".join(chr(r.randrange(33, 127)) for _ in range(6000))
    prose = open(quality.__file__).read()[:1500]
    got = [x.kept for x in quality.quality_rules(docs_of(spark, [prose, " ".join(noise[i : i + 7] for i in range(0, 6000, 7)), " ".join(f"row {i} of many rows" for i in range(400))])).orderBy("doc_id").collect()]
    assert got[0] and not got[2]


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_by_brute_force(spark, texts):
    every = texts + ODD + [t + " x" for t in texts[:40] if t]
    prints = [plain_fingerprint(t) for t in every]
    want = plain_components(prints)
    for x in simhash.near_duplicates(docs_of(spark, every)).collect():
        assert (x.fingerprint, x.component_id) == (f"{prints[x.doc_id]:016x}", want[x.doc_id])


def test_links_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(500)]
    for _ in range(700):  # chains, some of them dense
        p = r.choice(prints)
        for _ in range(r.randrange(1, 5)):
            p ^= 1 << r.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "f long"))
    roots = {x.node: x.root for x in components.components(links, "a", "b").collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for i, (s, root) in enumerate(zip(signed, plain_components(prints))):
        groups[roots.get(s, s)].add(i)
        want[root].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {2000: 2000, 2001: 2000}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    y, s = np.array([x.toxic for x in rows]), np.array([x.score for x in rows])
    above = np.mean(s[y == 1][:, None] > s[y == 0][None, :]) + np.mean(s[y == 1][:, None] == s[y == 0][None, :]) / 2
    # some 350 toxic rows to learn from, of which each language but English has a few dozen
    assert above > 0.85 and np.mean((s >= 0.5) == y) > 0.93
    assert all(x.predicted == (x.score >= 0.5) for x in rows)


def test_many_pairs_are_compared_as_one_by_one():
    """Pairs of one batch, tiles of any size and pairs without a side among them, have the passages that each has alone."""
    r, rows, want, length = random.Random(12), [], [], 20
    for k in range(120):
        x = [r.randrange(1 << 48) for _ in range(r.randrange(0, 90))]
        y = [h if r.random() < r.choice((0.5, 0.95, 1)) else r.randrange(1 << 48) for h in x[r.randrange(5) :]] + x[: r.randrange(30)]
        a, o, shift = r.randrange(100), r.randrange(100), r.randrange(-3, 4)
        cut = lambda side, at, v: [(side, 10 * k + side, at + i, b"".join(h.to_bytes(6, "little") for h in v[i : i + 16])) for i in range(0, len(v), 16)]
        rows.append((shift + o - a, cut(0, a, x) + cut(1, o, y)))
        if x and y:
            hit, there = substrings.matches(np.array(x, np.uint64), np.array(y, np.uint64), shift, length)
            found = substrings.similar_passages(np.array(x, np.uint64), np.array(y, np.uint64), hit, there, length) if len(hit) >= 0.8 * length else []
            want.append((10 * k, 10 * k + 1, sorted((f + a, e + a, g + o, h + o, s) for f, e, g, h, s in found), sorted({i + a for i in hit.tolist()})))
    kind = pa.list_(pa.struct([("side", pa.int32()), ("doc", pa.int64()), ("at", pa.int32()), ("hashes", pa.binary())]))
    tiles = pa.array([[dict(zip(("side", "doc", "at", "hashes"), t)) for t in ts] for _, ts in rows], kind)
    got = substrings.passages_of(np.array([s for s, _ in rows]), tiles, length).to_pylist()
    assert [(g["doc"], g["other"], sorted(tuple(x.values()) for x in g["links"]), [i for h in g["hits"] for i in range(h["b"], h["e"])]) for g in got] == want
    assert sum(bool(w[2]) for w in want) > 20


def test_words_are_hashed_alike_whatever_stands_beside_them():
    texts = ["", " ", "A b\x0bC\x0cd e\r\n", " lead a b c d e f g h ", "É é ß  x y z w q  r s", "one"]
    values, counts = substrings.shingles_of(pa.array(texts))
    assert counts.tolist() == [0, 0, 1, 5, 6, 0] and len(values) == 12
    assert values.tolist() == [h for t in texts for h in substrings.shingles(t.lower() if t.isascii() else t).tolist()]
