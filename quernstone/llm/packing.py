"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised, cut into pieces of at most the capacity, and packed into sequences. Islands are partitions of
bounded size. An island evolves a few packings: a child takes whole well-filled bins of one parent, bins of the other
that hold a piece already placed are dissolved, and the displaced pieces go where they fit best. Full enough bins are
final; elites migrate: the pieces of the other bins, kept together bin by bin, move to other islands for the next
round, fewer islands each time, until one island holds the rest.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model, single_threaded, slices, stored, tidy

#: Pieces an island should hold, packings it evolves, crossovers, and the share of well-filled bins that a child takes.
ISLAND, PACKINGS, CROSSOVERS, TAKEN = 6_000, 4, 10, 0.7
#: A bin is final in round r if at most this share of it is free; later rounds ask for less.
FREE, ROUNDS = (0.0005, 0.002, 0.01), 3
#: Words whose ids are kept.
MOST_WORDS = 400_000
#: Code points below which, with those of general punctuation, the quick path and the library agree.
PLAIN = 0x250


class WordIds(dict):
    """Ids of single words as little-endian bytes. The library splits a text into words before it merges, so a
    word's ids do not depend on what stands around it."""

    def __init__(self, vocabulary: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": []}
        for i in range(PLAIN):
            kind = "Z" if chr(i).isspace() and i not in range(0x1C, 0x20) else unicodedata.category(chr(i))[0]
            if kind in kinds:
                kinds[kind].append(re.escape(chr(i)))
        letters, numbers, white = ("".join(kinds[k]) for k in "LNZ")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")
        self.odd = re.compile(f"[^\x00-{chr(PLAIN - 1)}‐-‧‰-⁞]|İ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """The ids of a text, as the library gives them."""
        if self.odd.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            low = unicodedata.normalize("NFC", text).lower()
            if self.odd.search(low):
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return b"".join(map(self.__getitem__, self.words.findall(low)))
        return b"".join(map(self.__getitem__, self.words.findall(text.lower())))


def word_ids(vocabulary: str) -> WordIds:
    return model(("word ids", vocabulary), lambda: WordIds(vocabulary))


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocabulary)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at, piece, start, length, crc = [], [], [], [], []
            for begin, stop in slices([len(x) for x in texts]):
                for i in range(begin, stop):
                    data = known.of(texts[i]) + end
                    for k in range(0, len(data), 4 * capacity):
                        part = data[k : k + 4 * capacity]
                        at.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], order: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Puts each piece into the fullest bin that takes it, or a new one. Changes bins and fill."""
    room = sorted((capacity - f, i) for i, f in enumerate(fill) if f < capacity)
    for p in order:
        at = bisect_left(room, (sizes[p], -1))
        if at < len(room):
            free, i = room.pop(at)
        else:
            free, i = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[i].append(p)
        fill[i] += sizes[p]
        if free > sizes[p]:
            insort(room, (free - sizes[p], i))


def fitness(fill: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, those filled more unevenly, which leave more room in one place."""
    return -len(fill), sum((f / capacity) ** 2 for f in fill)


def evolve(sizes: list[int], groups: list[list[int]], capacity: int, random: np.random.Generator) -> list[list[int]]:
    """groups: bins of pieces that came together; they are one packing of the first generation."""

    def packed(order: list[int]) -> tuple[list[list[int]], list[int]]:
        bins: list[list[int]] = []
        fill: list[int] = []
        best_fit(sizes, order, bins, fill, capacity)
        return bins, fill

    down = sorted(range(len(sizes)), key=lambda p: -sizes[p])
    parents = [packed(down), ([list(g) for g in groups], [sum(sizes[p] for p in g) for g in groups])]
    while len(parents) < PACKINGS:
        noise = random.normal(1, 0.15, len(sizes))
        parents.append(packed(sorted(range(len(sizes)), key=lambda p: -sizes[p] * noise[p])))
    least = -(-sum(sizes) // capacity)
    for _ in range(CROSSOVERS):
        parents.sort(key=lambda x: fitness(x[1], capacity), reverse=True)
        if len(parents[0][1]) == least:
            break
        a, b = random.choice(min(3, len(parents)), 2, replace=False)
        (bins, fill), (other, other_fill) = parents[a], parents[b]
        best = sorted(range(len(fill)), key=lambda i: -fill[i])[: max(1, int(TAKEN * len(fill)))]
        child = [list(bins[i]) for i in best]
        child_fill = [fill[i] for i in best]
        placed = {p for g in child for p in g}
        displaced: list[int] = []
        for g, f in zip(other, other_fill):
            if placed.isdisjoint(g):
                child.append(list(g))
                child_fill.append(f)
            else:
                displaced += [p for p in g if p not in placed]
        # bins that are far from full are dissolved too, so that their pieces find a better place
        poor = [i for i in range(len(child)) if child_fill[i] < 0.9 * capacity]
        displaced += [p for i in poor for p in child[i]]
        gone = set(poor)
        child = [g for i, g in enumerate(child) if i not in gone]
        child_fill = [f for i, f in enumerate(child_fill) if i not in gone]
        best_fit(sizes, sorted(displaced, key=lambda p: -sizes[p]), child, child_fill, capacity)
        if fitness(child_fill, capacity) > fitness(parents[-1][1], capacity):
            parents[-1] = child, child_fill
    return max(parents, key=lambda x: fitness(x[1], capacity))[0]


def pack_island(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """group: key, length, bin (where the piece came from), island. Adds nothing but the new bin and its fill."""
    group = group.sort_values(["bin", "key"]).reset_index(drop=True)
    sizes = group.length.tolist()
    groups = [g.tolist() for g in group.groupby("bin", sort=True).indices.values()]
    random = np.random.default_rng(len(group))
    bins = evolve(sizes, groups, capacity, random)
    number, fill = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for i, g in enumerate(bins):
        number[g] = i
        fill[g] = sum(sizes[p] for p in g)
    return pd.DataFrame({"key": group.key, "length": group.length, "bin": group.island.iloc[0] * (1 << 24) + number, "fill": fill})


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: key (unique), length. Returns key, length, bin."""
    done, left = None, pieces.select("key", "length", F.col("key").alias("bin"), F.lit(0).cast("long").alias("fill"))
    for r in range(ROUNDS + 1):
        n = left.count()
        islands = max(1, round(n / ISLAND))
        dealt = left.withColumn("island", F.pmod(F.xxhash64("bin", F.lit(r)), F.lit(islands)) + (r << 32))
        packed = stored(dealt.groupBy("island").applyInPandas(lambda g: pack_island(g, capacity), "key long, length long, bin long, fill long"))
        last = islands == 1 or r == ROUNDS
        final = packed if last else packed.where(F.col("fill") >= int(capacity * (1 - FREE[r])))
        done = final if done is None else done.union(final)
        if last:
            break
        left = packed.where(F.col("fill") < int(capacity * (1 - FREE[r])))
    return done.select("key", "length", "bin")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 4096, separator: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null texts count as empty; an empty text is one piece, the separator. Only documents longer than the capacity are
    cut. Repeated rows are packed each; a null id stays null. Very long texts become as many pieces as they need; of bins
    with equal room the one opened first takes a piece; an empty table gives no rows. Other columns are not read. `vocabulary` is a path of a
    tokenizers file that is the same on all executors.
    """
    cut = pieces_of(docs, vocabulary, capacity, separator, id_col, text_col)
    rows = stored(cut.withColumn("key", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": -F.col("key") - 1, "offset": F.lit(0).cast("long")})
    placed = pack(rows.where(F.col("length") < capacity), capacity)
    inside = placed.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("key", "length"))).alias("held"))  # at most capacity pieces
    before = F.transform("held", lambda x, i: F.struct(x.key.alias("key"), F.aggregate(F.slice("held", 1, i), F.lit(0).cast("long"), lambda s, y: s + y.length).alias("offset")))
    spots = inside.select(F.col("bin").alias("sequence_id"), F.explode(before).alias("spot")).select("spot.key", "spot.offset", "sequence_id")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return rows.join(spots, "key").select(names).union(full.select(names))
