"""Language identification by cross-parsing entropy.

A language is learned as a suffix automaton of a bounded sample of its labelled text. A text is parsed against
each automaton into the longest phrases that occur in the sample; phrases times log2 of the sample's length is the
cost of the text in that language, and the cheapest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, model, slices, tidy

#: Bounds of the learned sample: characters a language at most and at least, characters in all (however many languages
#: there are, each has the least), characters of one row.
LANG_CHARS, LEAST_CHARS, ALL_CHARS, ROW_CHARS = 60_000, 1_000, 400_000, 2_000
#: Entries of a language's transition table. Every letter of its sample has a symbol of its own there, so the sample of a
#: script with thousands of letters is shorter; letters that the sample lacks end a phrase.
ENTRIES = 1 << 24
#: A phrase ends at the end of a block, in every language alike, so that blocks of all texts are parsed side by side.
BLOCK = 1024


def sample_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """A bounded sample of text per language: of rows that are not held out, those with the smallest id hashes."""
    learn = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    part = F.substring(text_col, 1, ROW_CHARS)
    sizes = learn.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(F.length(part)).alias("n"))
    counts = [(r.lang, r.n) for r in sizes.orderBy(F.desc("n"), "lang").collect()]
    if not counts:
        return {}
    most = min(LANG_CHARS, max(LEAST_CHARS, ALL_CHARS // len(counts)))
    # 1.5 times as many characters as wanted are expected below the threshold, so that few languages fall short
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, 1.5 * most / n)))])
    spread = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = learn.where(spread < F.try_element_at(share, F.col(lang_col)))
    rows = drawn.select(F.col(lang_col).alias("lang"), spread.alias("at"), part.alias("text")).collect()
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.at, r.text)):
        if len(texts.get(r.lang, "")) < most:
            texts[r.lang] = texts.get(r.lang, "") + r.text + "\n"
    return texts


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the smallest automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return step


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Languages:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in samples]
        # the letters of all samples, by number; 0 stands for any run of non-letters, the last for all other letters
        every = sorted({c for _, x in samples for c in x.lower() if c.isalpha()})
        self.symbol = np.where(letters(), np.int32(len(every) + 1), np.int32(0))
        self.symbol[[ord(c) for c in every]] = np.arange(1, len(every) + 1, dtype=np.int32)
        self.tables, self.bits, self.own, self.widths = [], [], [], []
        for _, text in samples:
            symbols = self.symbols([text])[0]
            width = len(np.unique(symbols)) + 2
            symbols = symbols[: max(1, ENTRIES // (2 * width))]  # an automaton has less than two states a symbol
            own = np.full(len(every) + 2, width - 1, np.int32)
            own[0] = 0
            there = np.unique(symbols[symbols > 0])
            own[there] = np.arange(1, len(there) + 1)
            step = suffix_automaton(own[symbols].tolist())
            first = np.zeros(width, np.int32) + 1  # a missing symbol: back to the start, a phrase counted
            for c, to in step[0].items():
                first[c] = to << 1 | 1
            flat = np.tile(first, len(step))
            at = [s * width + c for s, x in enumerate(step) for c in x]
            flat[at] = [to << 1 for x in step for to in x.values()]
            self.tables.append(flat)
            self.own.append(own)
            self.widths.append(np.int32(width))
            self.bits.append(float(np.log2(len(symbols) + 2)))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the lower-cased texts, joined, and how many each text has; runs of non-letters are one 0."""
        low = [x.lower() for x in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(low)), [len(x) for x in low])
        kinds = self.symbol[codes]
        keep = np.ones(len(kinds), bool)
        keep[1:] = (kinds[1:] > 0) | (kinds[:-1] > 0) | (of[1:] != of[:-1])
        return kinds[keep], np.bincount(of[keep], minlength=len(low))

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text (row) in each language (column), and whether the text has a letter."""
        kinds, sizes = self.symbols(texts)
        begins = np.cumsum(sizes) - sizes
        has_letter = np.array([x > 0 for x in np.add.reduceat(np.append(kinds > 0, False).astype(int), np.minimum(begins, len(kinds)))]) & (sizes > 0) if len(sizes) else np.zeros(0, bool)
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begins[of] + nth * BLOCK
        size = np.minimum(BLOCK, sizes[of] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        of, start, size = of[order], start[order], size[order]
        out = np.zeros((len(texts), len(self.names)))
        active = np.searchsorted(-size, -np.arange(BLOCK), "left") if len(size) else np.zeros(BLOCK, int)
        columns = []
        for t in range(int(size[0]) if len(size) else 0):
            columns.append(kinds[start[: active[t]] + t])
        for k, table in enumerate(self.tables):
            state, phrases = np.zeros(len(of), np.int32), np.zeros(len(of), np.int32)
            width, own = self.widths[k], self.own[k]
            for c in columns:
                m = len(c)
                went = table[state[:m] * width + own[c]]
                phrases[:m] += went & 1
                state[:m] = went >> 1
            phrases += state > 0
            out[:, k] = np.bincount(of, phrases, len(texts)) * self.bits[k]
        return out, has_letter

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for begin, end in slices([len(x) for x in texts]):
            bits, has = self.costs(texts[begin:end])
            for row, known in zip(bits, has):
                if not known or not self.names:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmin())
                names.append(self.names[best])
                scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -500)).sum()))
        return names, scores


def learned(samples: tuple[tuple[str, str], ...]) -> Languages:
    """A model is some 30 MB a language."""
    return model(("languages", samples), lambda: Languages(samples))


def predict_languages(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and the columns named in keep) for every row of docs.

    score is the share of the winner when each language weighs 2 ** -cost. Texts that are null, empty or without a
    letter, and all texts when nothing was learned, get `und` and 0. Equal costs: the alphabetically first language.
    Repeated rows each get their row; a null id stays null and counts as held out. Very long texts are parsed in blocks
    side by side; an empty table gives no rows. No other column is read.
    """
    known = tuple(sorted(samples.items()))
    kept = [c for c in keep if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = learned(known).predict([x or "" for x in b.column("__text").to_pylist()])
            rest = [i for i, f in enumerate(b.schema.names) if f != "__text" or text_col in keep]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in rest] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[b.schema.names[i] for i in rest] + ["lang_pred", "score"])
        tidy()

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), held_out(F.col(id_col)).alias("__held"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)])
    out = rows.mapInArrow(run, T.StructType([f for f in rows.schema if f.name != "__text" or text_col in keep]).add("lang_pred", "string").add("score", "double"))
    back = {c: f"__k{i}" for i, c in enumerate(kept)} | {text_col: "__text"}
    return out.select(F.col("__id").alias("doc_id"), F.col("__held").alias("held_out"), "lang_pred", "score", *[F.col(back[c]).alias(c) for c in keep])
