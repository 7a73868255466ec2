"""Token counts by compiled finite-state transducers.

Two deterministic transducers are chained. The first reads character classes and marks where the byte-level
pattern starts a new word; it has twelve states. Texts are cut into fixed chunks, every chunk gets the map from
each possible start state to its end state, the maps are composed by a parallel prefix scan, and a last pass from
the then known start states writes the marks. The second reads the bytes of one word; a state holds the tokens
that end at each place from which a longer token may still grow, and a transition is annotated with the number of
tokens by which the byte changes the count. It is exact for byte-pair merges of any word length, and its states are
compiled when first met.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the byte-level pattern: the character classes ...
END, SPACE, WHITE, QUOTE, STMD, RV, E, L, LETTER, NUMBER, OTHER = range(11)
CLASSES = 11
#: ... and the states.
FRESH, IN_L, IN_N, IN_O, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, Q, Q_RV, Q_L, DONE = range(12)
STATES = 12
#: Outputs: a word starts at this character, at the one before it.
HERE, BEFORE = 16, 32
#: Separates texts in a joined string; no valid text holds a lone surrogate.
SEP = "\ud800"
CHUNK, SETTLE = 256, 24
#: States of the word transducer that are kept before it is compiled anew, and words whose count is kept.
MOST_STATES, MOST_WORDS = 250_000, 300_000


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = WHITE
    out[0x20], out[ord("'")], out[0xD800] = SPACE, QUOTE, END
    for letters, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(x) for x in letters]] = kind
    return out


@cache
def marker() -> np.ndarray:
    """The first transducer: marker()[state * CLASSES + class] = next state | outputs."""
    letters = {STMD, RV, E, L, LETTER}

    def fresh(c: int) -> int:
        to = FRESH if c == END else IN_L if c in letters else {NUMBER: IN_N, OTHER: IN_O, QUOTE: Q, SPACE: ONE_SPACE, WHITE: ONE_WHITE}[c]
        return to | HERE

    def step(q: int, c: int) -> int:
        if c in (SPACE, WHITE) and q in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
            return RUN_SPACE if c == SPACE else RUN_WHITE
        if c == END:
            return FRESH | HERE | (BEFORE if q in (Q_RV, Q_L) else 0)
        joined = IN_L if c in letters else IN_N if c == NUMBER else IN_O
        if q == ONE_SPACE:
            return joined
        if q == RUN_SPACE:
            return joined | BEFORE
        if q == RUN_WHITE:
            return fresh(c) | BEFORE
        if q == IN_L and c in letters or q == IN_N and c == NUMBER or q in (IN_O, Q) and c in (OTHER, QUOTE):
            return joined
        if q == Q and c in (STMD, RV, L):
            return {STMD: DONE, RV: Q_RV, L: Q_L}[c]
        if (q, c) in ((Q_RV, E), (Q_L, L)):
            return DONE
        if q in (Q_RV, Q_L):  # the quote stood alone and its letter opened a word
            return (IN_L if c in letters else fresh(c)) | BEFORE
        return fresh(c)

    return np.array([step(q, c) for q in range(STATES) for c in range(CLASSES)], np.uint8)


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i of the result maps a start state through chunks 0..i."""
    out, width = maps.copy(), 1
    while width < len(out):
        out[width:] = np.take_along_axis(out[width:], out[:-width], axis=1)
        width *= 2
    return out


def word_starts(joined: str) -> np.ndarray:
    """Where words start in texts joined by SEP; a SEP is a word of its own."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, table = len(codes), marker()
    chunks = -(-n // CHUNK)
    kinds = np.full(chunks * CHUNK, END, np.uint8)
    kinds[:n] = classes()[codes]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
    lanes = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, 1)
    for t in range(SETTLE):
        lanes = table[lanes * np.uint8(CLASSES) + kinds[t]] & 15
    same = (lanes == lanes[0]).all(0)
    one, open_, left = lanes[0].copy(), lanes[:, ~same], kinds[:, ~same]
    for t in range(SETTLE, CHUNK):
        one = table[one * np.uint8(CLASSES) + kinds[t]] & 15
        if open_.shape[1]:
            open_ = table[open_ * np.uint8(CLASSES) + left[t]] & 15
    maps = np.repeat(one[:, None], STATES, 1)
    maps[~same] = open_.T
    state = np.concatenate([[FRESH], compose(maps)[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), np.uint8)
    for t in range(CHUNK):
        out[t] = table[state * np.uint8(CLASSES) + kinds[t]]
        state = out[t] & 15
    flat = np.ascontiguousarray(out.T).reshape(-1)
    mark = (flat & HERE) > 0
    mark[:-1] |= (flat[1:] & BEFORE) > 0
    return np.flatnonzero(mark[:n])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """Counts the byte-pair tokens of a word, byte by byte."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"] for x in model["added_tokens"]]
        back, bpe = byte_alphabet(), model["model"]
        ids = {bytes(back[c] for c in k): v for k, v in bpe["vocab"].items()}
        self.ids, self.merge, self.parts, self.made = ids, {}, {}, {}
        for rank, m in enumerate(bpe["merges"]):
            a, b = (bytes(back[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
            if ids[a + b] not in self.parts:
                self.parts[ids[a + b]], self.made[ids[a + b]] = (ids[a], ids[b]), rank
        self.spelled = {v: k for k, v in ids.items()}
        self.prefixes = {k[:i] for k in ids for i in range(1, len(k) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, int] = {SEP: 0}
        self.reset()

    def reset(self) -> None:
        #: A state: the pending bytes, and for the place before each and after the last the token that ends there
        #: and the count so far, less the count at the end.
        self.start: tuple = (b"", ((-1, 0),), {})
        self.states = {self.start[:2]: self.start}

    def merged(self, first: list[int]) -> list[int]:
        """Plain byte-pair merging, by which single tokens are judged."""
        ids = list(first)
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            pair, out, i = (ids[best[1]], ids[best[1] + 1]), [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(self.merge[pair][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def spell(self, token: int) -> list[int]:
        return [self.ids[bytes([b])] for b in self.spelled[token]]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging keeps these two tokens as they are when they stand side by side (left -1: a word's start)."""
        if right not in self.whole:
            self.whole[right] = self.merged(self.spell(right)) == [right]
        if left < 0 or not self.whole[right]:
            return self.whole[right]
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.seam_holds(left, right)
        return known

    def seam_holds(self, a: int, b: int) -> bool:
        """Walks back through the merges that built both sides: no merge across the seam may come before the merge
        that takes one of its two tokens away. Of equal ranks the left place is merged first."""
        until = 2 * len(self.merge) + 2  # twice the rank; odd: a merge on the right, which gives way to the seam
        while True:
            across = self.merge.get((a, b))
            if across is not None and 2 * across[0] < until:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until, a = 2 * made_a, self.parts[a][1]
            else:
                until, b = 2 * made_b + 1, self.parts[b][0]

    def grow(self, state: tuple, b: int) -> tuple:
        pending, ends, known = state
        text = pending + bytes([b])
        for j in range(len(text)):
            token = self.ids.get(text[j:])
            if token is not None and ends[j] and self.fit(ends[j][0], token):
                last, change = token, ends[j][1] + 1
                break
        # places from which no longer token grows are forgotten, so that more words share a state
        alive = [text[j:] in self.prefixes for j in range(len(text))]
        cut = alive.index(True) if True in alive else len(text)
        key = (text[cut:], tuple((ends[j][0], ends[j][1] - change) if alive[j] else None for j in range(cut, len(text))) + ((last, 0),))
        if key not in self.states:
            self.states[key] = (*key, {})
        known[b] = self.states[key], change
        return known[b]

    def count(self, word: str) -> int:
        state, total = self.start, 0
        for b in word.encode():
            step = state[2].get(b) or self.grow(state, b)
            state, change = step
            total += change
        return total

    def counts(self, words: list[str]) -> list[int]:
        if len(self.states) > MOST_STATES:
            self.reset()
        if len(self.words) > MOST_WORDS:
            self.words = {SEP: 0}
        known, count = self.words, self.count
        for w in set(words).difference(known):
            known[w] = count(w)
        return [known[w] for w in words]


@cache
def transducer(vocabulary: str) -> WordTransducer:
    return WordTransducer(vocabulary)


def count_tokens(texts: list[str], vocabulary: str) -> list[int]:
    """Tokens of each text."""
    model, total = transducer(vocabulary), []
    for begin, end in slices([len(x) for x in texts]):
        part, extra = list(texts[begin:end]), np.zeros(end - begin, np.int64)
        pieces = np.ones(end - begin, np.int64)
        for i, x in enumerate(part):
            for s in model.special:
                if s in x:
                    extra[i] += x.count(s)
                    x = part[i] = x.replace(s, SEP)
            pieces[i] = x.count(SEP) + 1
        joined = SEP.join(part) + SEP
        at = word_starts(joined)
        ends = np.append(at[1:], len(joined)).tolist()
        n = np.array(model.counts([joined[a:b] for a, b in zip(at.tolist(), ends)]), np.int64)
        closing = np.cumsum([len(x) + 1 for x in part]) - 1
        of = np.searchsorted(closing, at, "left")
        total += (np.bincount(of, n, len(part)).astype(np.int64) + extra).tolist()
    return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    One row comes out for each row that goes in: repeated rows are counted each, a null id stays null, a null text
    counts as empty (no tokens). Very long texts are cut into chunks whose state maps are composed; there are no ties; an
    empty table gives no rows. Other columns are not looked at. `vocabulary` is the path, the same on all
    executors, of a byte-level tokenizers file; strings of its added tokens count as one token each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_tokens(b.column(2).to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
