"""Ranked lexical search of a table of queries over all documents, by sort-based accumulation.

Documents are read once, into a table of the queries' terms in each (the index). A task takes the documents of its
partition in slices: every posting meets the items that hold its term, which gives arrays of item, document and impact;
keys packed of item and document are radix-sorted, and impacts of equal keys are summed between their bounds
(reduceat). Each item's best documents go through a heap that the task keeps over its slices, so what leaves a task is
at most `top` rows an item, however many documents match. Items and best rows are then range-partitioned by item. The
items are taken in blocks whose terms fit a task; documents are never shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored
from .decontaminate import words_of

#: Terms of the items (with repeats) that are looked for at once: some 100 MB of a Python worker.
BLOCK_TERMS = 400_000
#: Item-document pairs that are sorted at once (some 60 bytes each).
PAIRS = 1 << 20
#: All ASCII but letters and digits becomes a blank, A-Z become a-z; other bytes of UTF-8 belong to words.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term, n: how often an item's text has a term; texts of one id are one item, equal texts count once."""
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    return rows.select("item", F.explode(words_of(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("n"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys, by counting sorts on 16 bits at a time from the lowest; digits that don't differ are passed over."""
    order, bits = None, int(keys.max()).bit_length() if len(keys) else 0
    for shift in range(0, bits, 16):
        digit = ((keys if order is None else keys[order]) >> shift).astype(np.uint16)
        if digit.min() != digit.max():
            step = np.argsort(digit, kind="stable")  # numpy's stable sort of 16-bit integers is a radix sort
            order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


@dataclass(frozen=True)
class Block:
    """Some items: their ids, their terms' numbers, and by term the items that hold it, from bounds[term] on."""

    items: list
    terms: dict[bytes, int]
    bounds: np.ndarray
    item: np.ndarray
    weight: np.ndarray  # 1000 ln(...) of the term, times its repeats in the item


def block_of(rows: list, w: dict[str, int]) -> Block:
    """rows: (item, term, n) of whole items; w: the weight of each term, those of no document left out."""
    ids = sorted({r.item for r in rows})
    number = {x: i for i, x in enumerate(ids)}
    terms = {t: i for i, t in enumerate(sorted(w))}
    pairs = sorted((terms[r.term], number[r.item], r.n * w[r.term]) for r in rows if r.term in terms)
    term, item, weight = np.array(pairs, np.int64).reshape(-1, 3).T
    bounds = np.searchsorted(term, np.arange(len(terms) + 1))
    return Block(ids, {t.encode(): i for t, i in terms.items()}, bounds, item, weight)


def read_terms(docs: DataFrame, known: frozenset[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (words), terms, tf of every document with words: the items' terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = frozenset(t.encode() for t in known)
        for b in batches:
            n, terms, tf, sizes = [], [], [], [0]
            for text in b.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").translate(PLAIN).split()
                held = Counter(filter(wanted.__contains__, words))
                n.append(len(words))
                terms += held.keys()
                tf += held.values()
                sizes.append(len(terms))
            bounds = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<string>, tf array<long>").where("n > 0")


def scored(block: Block, of: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, document, score of every pair that shares a term; of, term, tf: the postings, m: the documents' norms."""
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])
    first = block.bounds[term]
    width = block.bounds[term + 1] - first
    if not width.sum():
        return (np.empty(0, np.int64),) * 3
    at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    keys = block.item[at] * n_docs + np.repeat(of, width)
    parts = block.weight[at] * np.repeat(impact, width)
    order = radix_order(keys)
    keys, parts = keys[order], parts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads] // n_docs, keys[heads] % n_docs, np.add.reduceat(parts, heads)


class Best:
    """A heap for each item of the rows with the highest scores, then the least ids (null before all)."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.heaps: dict[int, list] = {}

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list) -> None:
        bounds = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            heap, s, d = self.heaps.setdefault(int(item[a]), []), score[a:b], doc[a:b]
            least = heap[0][0] if len(heap) == self.top else 1
            if b - a > self.top:  # what is below the slice's own best can't be among the best of all
                least = max(least, int(np.partition(s, len(s) - self.top)[len(s) - self.top]))
            for i in np.flatnonzero(s >= max(least, 1)).tolist():
                key = ids[d[i]]
                entry = (int(s[i]), Last(key), key)
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif heap[0] < entry:
                    heapq.heapreplace(heap, entry)


class Last:
    """Orders ids the other way round: the least is the greatest."""

    __slots__ = ("key",)

    def __init__(self, key) -> None:
        self.key = key

    def __lt__(self, other: Last) -> bool:
        return other.key is None and self.key is not None or (self.key is not None and other.key is not None and self.key > other.key)

    def __eq__(self, other) -> bool:
        return self.key == other.key


def best_of_partition(block: Block, n_all: int, length: int, top: int, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, widths = Best(top), np.diff(block.bounds)
        for b in batches:
            counts = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = b.column(2).flatten().cast(pa.binary()).dictionary_encode()
            number = np.array([block.terms.get(x, -1) for x in words.dictionary.to_pylist()], np.int64)
            term = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
            tf, of = b.column(3).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
            good = term >= 0
            term, tf, of = term[good], tf[good], of[good]
            m = 75 + (25 * b.column(1).to_numpy() * n_all) // length
            pairs = np.bincount(of, widths[term], len(counts)).astype(np.int64) if len(of) else np.zeros(len(counts), np.int64)
            ids = b.column(0).to_pylist()
            for begin, end in slices(pairs.tolist(), PAIRS):
                a, z = np.searchsorted(of, [begin, end])
                item, doc, score = scored(block, of[a:z] - begin, term[a:z], tf[a:z], m[begin:end], end - begin)
                if len(item):
                    best.add(item, doc, score, ids[begin:end])
        rows = [(block.items[i], key, s) for i, heap in best.heaps.items() for s, _, key in heap]
        if rows:
            item, key, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, kinds[0]), pa.array(key, kinds[1]), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `top` documents with the highest scores above 0.

    Terms are runs of ASCII letters (A-Z as a-z), digits and non-ASCII characters. A null or empty text, of a document
    or an item, has none and is never found. Equal scores are ordered by id, null first; repeated rows are documents of
    their own, each with its rank. Items with a null id are left out; rows of one item id are one item. An empty table
    on either side gives no rows. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    asked = stored(item_terms(items, item_col, item_text_col))
    kinds = tuple(to_arrow_type(x) for x in (asked.schema["item"].dataType, docs.schema[id_col].dataType))
    blocks = 1 + (asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n) // BLOCK_TERMS
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    schema = f"item_id {asked.schema['item'].dataType.simpleString()}, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
    found = []
    for i in range(blocks):
        rows = asked.where(F.col("block") == i).select("item", "term", "n").collect()  # of a stated query set, in blocks
        index = stored(read_terms(docs, frozenset(r.term for r in rows), id_col, text_col))
        total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        w = {r.term: math.floor(1000 * math.log((2 * total.n + 2) / (2 * r.df + 1))) for r in df}
        block = spark.sparkContext.broadcast(block_of(rows, w))
        found.append(stored(index.mapInArrow(lambda it, b=block, n=total.n, size=total.length: best_of_partition(b.value, n, size, top, kinds)(it), schema)))
    best = found[0]
    for x in found[1:]:
        best = best.union(x)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return best.repartitionByRange("item_id").withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
o AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY item_id, term),
p AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, 75 + (25 * len(w) * o.n) // o.l AS m, unnest(w) AS term FROM d, o WHERE len(w) > 0) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * o.n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, o GROUP BY term, o.n),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN p USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
