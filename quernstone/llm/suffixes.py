"""Substring dedup: every byte goes that lies in a string of `length` bytes which stands elsewhere too.

Bucket-pointer refinement over sampled suffixes. A string's anchor is the place in it whose q-gram has the least hash,
the leftmost of such; equal strings have it at the same distance, so suffixes are sorted from anchors only, one for some
ninety bytes. The initial buckets are the anchors' q-grams. A bucket's members are refined on the identifiers of what
stands at other offsets from the anchor: all strings that share an anchor (its span) are named at once by the bytes
that they cover together, then, where the names differ, in blocks of BLOCK distances, then one by one. At each step a
name that repeats settles a whole span, a bucket with one member is left, and only what is open is sorted again, beside
one span for each settled name of its bucket. All
sorting is counting and joining of 64-bit names by two hashes each; no bucket's members need to meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, forget, joined_ids, stored

#: Distances from an anchor that the second refinement names together; the third names each.
BLOCK = 16
#: Starts of strings that are looked at together; bounds a Python worker's memory and fits its cache.
PIECE = 1 << 17
#: Documents, and runs in them, up to which they are broadcast to the texts; beyond either the texts are shuffled.
BROADCAST_DOCS, BROADCAST_RUNS = 200_000, 1_000_000

_R = np.random.default_rng(8128)
BYTE_VALUES = _R.integers(1, 1 << 63, 256, np.uint64)
BASE, MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
NAMES = pa.schema([("at", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("core", pa.int64()), ("name", pa.int64())])


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on, by doubling the width."""
    h, power, width, found, done = BYTE_VALUES[data], BASE, 1, None, 0
    while True:
        if q & width:  # the widths that make up q, from small to large
            if found is None:
                found, done = h, width
            else:
                n = len(data) - done - width + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                found, done = found[:n] * power + h[done : done + n], done + width
        if 2 * width > q:
            break
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h, power, width = h[:-width] * power + h[width:], np.uint64(int(power) ** 2 % (1 << 64)), 2 * width
    found = (found ^ (found >> np.uint64(31))) * MIX
    return found ^ (found >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of places the one with the least hash (of 32 bits), the leftmost of equal ones."""
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= window and len(least) > width:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if len(hashes) < window:
        return np.empty(0, np.int64)
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def spans(data: np.ndarray, ends: np.ndarray, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor, first and last start of the strings that share it, and its bucket, for texts that stand end to end in
    data. A span that is longer than a piece comes in parts."""
    for begin in range(0, len(data) - length + 1, PIECE):
        part = data[begin : begin + PIECE + length - 1]
        hashes = gram_hashes(part, q)
        at = anchors(hashes, length - q + 1)[:PIECE]
        p = np.arange(begin, begin + len(at))
        of = np.searchsorted(ends, p, "right")
        good = np.flatnonzero(p + length <= ends[of])
        if len(good):
            p, at, of = p[good], at[good], of[good]
            new = np.flatnonzero((np.diff(at) != 0) | (np.diff(p) != 1) | (np.diff(of) != 0)) + 1
            first, last = np.concatenate([[0], new]), np.concatenate([new, [len(p)]]) - 1
            yield at[first] + begin, p[first], p[last], hashes[at[first]]


def columns_of(batch: pa.RecordBatch, i: int) -> tuple[memoryview, np.ndarray]:
    """The bytes of a column of texts, and where each text ends (the first begins at 0)."""
    texts = batch.column(i).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    return memoryview(body)[offsets[0] : offsets[-1]] if body is not None else memoryview(b""), offsets[1:] - offsets[0]


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def batch_of(batch: pa.RecordBatch, rows: np.ndarray, arrays: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """The batch's first two columns (id and key of a document) for each row, and more columns."""
    take = pa.array(rows)
    own = [batch.column(i).take(take) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*own, *[pa.array(x, f.type, safe=False) for x, f in zip(arrays, schema)]], names=["doc", "key", *schema.names])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text")


def initial_buckets(docs: DataFrame, length: int, q: int, id_col: str, text_col: str) -> DataFrame:
    """doc, key, at (the anchor), begin, end (first and last start of its span), core (the bucket), name (of all bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, ends = columns_of(b, 2)
            data = np.frombuffer(body, np.uint8)
            for at, begin, end, core in spans(data, ends, length, q):
                seeds = ((at - begin) << 32 | (end - begin)).tolist()
                name = signed([xxhash.xxh3_64_intdigest(body[i : j + length], s) for i, j, s in zip(begin.tolist(), end.tolist(), seeds)])
                of = np.searchsorted(ends, begin, "right")
                base = np.concatenate([[0], ends])[of]
                yield batch_of(b, of, [at - base, begin - base, end - base, core.view(np.int64), name], NAMES)

    rows = docs.where(F.octet_length(text_col) >= length).select(*keyed(docs, id_col, text_col))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, key long, at int, begin int, end int, core long, name long")


def finer_buckets(found: DataFrame, length: int, block: int) -> DataFrame:
    """Of the open spans of each text (doc, key, text, open: structs of at, begin, end) parts of `block` distances from
    the anchor: core names the bytes that all strings of a part have, name those of the part as it stands here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, other = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for b in batches:
            body, ends = columns_of(b, 2)
            starts = [0, *ends.tolist()]
            rows, parts, cores, names = [], [], [], []
            for i, listed in enumerate(b.column(3).to_pylist()):
                base = starts[i]
                for s in listed:
                    at, near, far = s["at"], s["at"] - s["end"], s["at"] - s["begin"]
                    for k in range(near // block, far // block + 1):
                        low, high = max(near, k * block), min(far, k * block + block - 1)
                        parts.append((at, at - high, at - low))
                        rows.append(i)
                        cores.append(digest(body[base + at - k * block : base + at - (k * block + block - 1) + length], k))
                        names.append(other(body[base + at - high : base + at - low + length], low << 32 | high))
            if rows:
                yield batch_of(b, np.array(rows), [*np.array(parts).T, signed(cores), signed(names)], NAMES)

    return found.mapInArrow(run, f"doc {found.schema['doc'].dataType.simpleString()}, key long, at int, begin int, end int, core long, name long")


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of named spans those whose name repeats, and what is to be refined: the others of buckets with two members or
    more, and beside them one span for each repeated name of their bucket, since its strings may be theirs too."""
    shared = stored(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    left = stored(joined_ids(rows, shared, "core", "left_semi"))
    forget(rows)
    forget(shared)
    span = ("doc", "key", "at", "begin", "end")
    twice = stored(left.groupBy("core", "name").agg(F.count("*").alias("n"), F.min(F.struct(*span)).alias("one")).where("n > 1").select("core", "name", "one"))
    names = twice.select("core", "name", F.lit(True).alias("twice"))
    small = twice.count() <= BROADCAST_IDS // 2
    found = stored(left.join(F.broadcast(names) if small else names, ["core", "name"], "left").select(*span, "core", F.coalesce("twice", F.lit(False)).alias("twice")))
    forget(left)
    alone = found.where("NOT twice")
    beside = joined_ids(twice, stored(alone.select("core").distinct()), "core", "left_semi").select("one.*")
    return found.where("twice").select("doc", "key", "begin", "end"), alone.select(*span).union(beside)


def joined_texts(docs: DataFrame, lists: DataFrame, column: str, id_col: str, text_col: str, how: str, extra: list[Column]) -> DataFrame:
    """Texts with a stored table of lists by document; the texts are shuffled only where the lists are many."""
    size = lists.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("runs")).first()
    small = size.docs <= BROADCAST_DOCS and size.runs <= BROADCAST_RUNS
    right = lists.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), column)
    left = docs.select(*keyed(docs, id_col, text_col), *extra)
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__key"))
    return left.join(F.broadcast(right) if small else right, same, how).drop("__doc", "__key")


def runs_of(covered: DataFrame, length: int) -> DataFrame:
    """doc, key, runs (begin, end; disjoint, in order): the bytes that strings with starts in the given spans cover."""
    kind = covered.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin, end = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
            order = np.lexsort((begin, of))
            of, begin, end = of[order], begin[order], end[order] + length
            far = np.maximum.accumulate(end + (of << 32))
            new = np.flatnonzero(np.concatenate([[True], begin[1:] + (of[1:] << 32) > far[:-1]]))
            last = np.concatenate([new[1:], [len(of)]]) - 1
            counts = np.bincount(of[new], minlength=len(lists))
            pairs = pa.StructArray.from_arrays([pa.array(begin[new], pa.int32()), pa.array(far[last] - (of[last] << 32), pa.int32())], names=["begin", "end"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed], names=["doc", "key", "runs"])

    lists = covered.groupBy("doc", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return lists.mapInArrow(run, f"doc {kind}, key long, runs array<struct<begin:int,end:int>>")


def repeated_runs(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, key (hash of the text), runs: the byte ranges of the texts that repeat, for texts that have some."""
    q = max(1, length // 2)
    covered, open_spans = settled(stored(initial_buckets(docs, length, q, id_col, text_col)))
    for block in (max(1, min(BLOCK, q // 2)), 1):  # shorter than what the strings of a part share
        lists = stored(open_spans.groupBy("doc", "key").agg(F.collect_set(F.struct("at", "begin", "end")).alias("open")))
        found = joined_texts(docs, lists, "open", id_col, text_col, "inner", [])
        more, open_spans = settled(stored(finer_buckets(found, length, block)))
        covered = covered.union(more)
    return runs_of(covered, length)


def cut(texts, runs):
    """The bytes of each text outside its runs; null where there are none."""
    import pandas as pd

    out = []
    for text, listed in zip(texts, runs):
        if text is None or listed is None:
            out.append(None)
            continue
        data, at, kept = text.encode(), 0, []
        for r in listed:
            kept.append(data[at : r["begin"]])
            at = r["end"]
        out.append(b"".join([*kept, data[at:]]))
    return pd.Series(out, dtype=object)


def dedup_substrings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row and column of docs, and two more: kept (binary: the text's UTF-8 bytes without those that a repeated
    string of `length` bytes covers) and cut_runs (the byte ranges that went, disjoint and in order).

    All copies go, the first included. Strings stand inside one text; a null or empty text, or one shorter than
    `length`, has none, and a null text has a null `kept`. Every row is a text of its own, so that repeated rows are
    copies of each other; a null id is an id. Texts of any length are read in pieces. No rows give no rows. Columns of
    docs named as the new ones are replaced. Strings are compared by two 64-bit hashes of different kinds.
    """
    runs = stored(repeated_runs(docs, length, id_col, text_col))
    own = F.struct(*[F.col(c) for c in docs.columns if c not in ("kept", "cut_runs")]).alias("own")  # so that no name clashes
    found = joined_texts(docs, runs, "runs", id_col, text_col, "left", [own, F.col(text_col).isNull().alias("none")])
    rest = F.pandas_udf(cut, "binary")(F.when(F.col("runs").isNotNull(), F.col("text")), F.col("runs"))
    kept = F.when(~F.col("none"), F.coalesce(rest, F.col("text").cast("binary")))
    return found.select("own.*", kept.alias("kept"), F.coalesce("runs", F.array().cast("array<struct<begin:int,end:int>>")).alias("cut_runs"))
