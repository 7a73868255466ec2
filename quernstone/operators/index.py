"""A stored inverted index over text columns, and BM25 answered from it.

Three Parquet tables under one path, each in segments: `postings` (term, key, tf, length), split in folders by a hash of
the term and sorted by term and key, with a frequent term's rows in several files; `terms`, the sorted dictionary, from
which prefixes are expanded; `totals`, number and length of the rows. A query reads the folders of its terms and, by the
files' statistics, little else in them; texts are not read. New rows become a segment of their own; merging writes all
segments as one.

An index may be made for stated terms only, as for a few known queries: all rows are read and count in the totals, and
only the postings of those terms travel and are written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import tokens
from quernstone.operators.search import TermQuery, scored_frequencies
from quernstone.operators.stored import forget, kept

SHARDS = 32
#: Words that prefixes may expand to and still be written into the query; more are joined.
MOST_WORDS = 5_000
#: Tokens that are counted together; bounds a Python worker's memory.
TOKENS = 1 << 20


def shard_of(term: str) -> int:
    return zlib.crc32(term.encode()) % SHARDS


@dataclass(frozen=True)
class Terms:
    """Terms an index is made for: words, and beginnings of words."""

    words: frozenset[str]
    prefixes: frozenset[str] = frozenset()

    @staticmethod
    def of(query: TermQuery) -> Terms:
        return Terms(frozenset(query.all + query.any), query.prefixes)

    def holds(self, token: Column) -> Column:
        return reduce(lambda a, p: a | token.startswith(p), sorted(self.prefixes), token.isin(sorted(self.words)))

    def cover(self, terms: tuple[str, ...], prefixes: frozenset[str]) -> bool:
        longer = tuple(self.prefixes)
        return all(t.startswith(longer) if t in prefixes else t in self.words or t.startswith(longer) for t in terms)


def row_terms(rows: DataFrame, key: str, columns: dict[str, float], only: Terms | None = None) -> DataFrame:
    """key, length (tokens) and, by column, the tokens (of `only` these terms; all count in the length)."""
    held = [tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)]
    names = [f"t{i}" for i in range(len(columns))]
    length = sum((F.size(t) for t in names), F.lit(0)).cast("double").alias("length")
    return rows.select(F.col(key).alias("key"), *held).select("key", *[F.filter(t, only.holds).alias(t) if only else t for t in names], length)


def few_term_counts(held: DataFrame, weights: list[float]) -> DataFrame:
    """As `term_counts`, of rows that hold few tokens each."""
    weigh = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    every = F.explode(F.concat(*[F.transform(f"t{i}", weigh(w)) for i, w in enumerate(weights)]))
    return held.select("key", "length", every.alias("t")).groupBy("t.term", "key").agg(F.sum("t.w").alias("tf"), F.first("length").alias("length"))


def term_counts(held: DataFrame, weights: list[float]) -> DataFrame:
    """term, key, tf (weighted), length: a row's tokens are counted where they are, so that only its postings travel."""

    def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(sum(b.column(2 + i).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(weights))))
        begin = 0
        while begin < len(b):  # one row at least
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + TOKENS, "right")))
            yield b.slice(begin, end - begin)
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole)):
            lists = [b.column(2 + i) for i in range(len(weights))]
            sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            if not len(coded):
                continue
            n = len(coded.dictionary)
            of = np.concatenate([np.repeat(np.arange(len(b)), s) for s in sizes])
            weight = np.concatenate([np.full(s.sum(), w) for s, w in zip(sizes, weights)])
            pair, at = np.unique(of * n + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            tf = np.bincount(at, weight, len(pair))
            row = pa.array(pair // n)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(pair % n)), b.column(0).take(row), pa.array(tf), b.column(1).take(row)], names=["term", "key", "tf", "length"])

    named = held.select("key", "length", *[f"t{i}" for i in range(len(weights))])
    return named.mapInArrow(run, f"term string, key {held.schema['key'].dataType.simpleString()}, tf double, length double")


@dataclass(frozen=True)
class TextIndex:
    """Rows are named by their key; each key is in one segment."""

    spark: SparkSession
    path: str
    only: Terms | None = None

    @staticmethod
    def build(rows: DataFrame, key: str, columns: dict[str, float], path: str, only: Terms | None = None) -> TextIndex:
        """columns: the texts' weights. Null texts have no tokens; rows without any count in the totals. only: the terms
        that can be asked, where not all."""
        found = TextIndex(rows.sparkSession, path, only)
        found._write(rows, key, columns, 0)
        return found

    def append(self, rows: DataFrame, key: str, columns: dict[str, float]) -> None:
        """A further segment of rows with new keys. If it fails half-way, totals are missing and it isn't read."""
        self._write(rows, key, columns, 1 + max(r.segment for r in self.totals().select("segment").collect()))

    def _write(self, rows: DataFrame, key: str, columns: dict[str, float], segment: int) -> None:
        held = row_terms(rows, key, columns, self.only)
        if self.only:  # what is left of a row is small: kept, so that texts are read once
            held = kept(held, "terms")
        # kept, since range partitioning reads its rows twice
        counted = kept((few_term_counts if self.only else term_counts)(held, list(columns.values())), "postings")
        self._postings(counted, segment)
        forget(counted)
        held.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length")).write.mode("overwrite").parquet(f"{self.path}/totals/segment={segment}")
        if self.only:
            forget(held)

    def _postings(self, each: DataFrame, segment: int) -> None:
        order = ["shard", "term", "key"]
        sharded = each.withColumn("shard", (F.crc32("term") % SHARDS).cast("int"))
        # frequent terms stand in several ranges, so that no task and no file gets all of one
        sharded.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/postings/segment={segment}")
        if each.isEmpty():  # no folder of a shard came of it; a file without rows keeps the columns
            each.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/postings/segment={segment}/shard=0")
        written = self.spark.read.parquet(f"{self.path}/postings/segment={segment}")
        written.groupBy("term").agg(F.count("*").alias("df")).orderBy("term").write.mode("overwrite").parquet(f"{self.path}/terms/segment={segment}")

    def _read(self, name: str) -> DataFrame:
        segments = [r.segment for r in self.totals().select("segment").collect()] if name != "totals" else []
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.where(F.col("segment").isin(segments)) if segments else rows

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def merged(self, path: str) -> TextIndex:
        """All segments as one, at another path."""
        found = TextIndex(self.spark, path, self.only)
        found._postings(self.postings().drop("segment", "shard"), 0)
        self.totals().agg(F.sum("n").alias("n"), F.sum("length").alias("length")).coalesce(1).write.parquet(f"{path}/totals/segment=0")
        return found

    def matching(self, terms: tuple[str, ...], prefixes: frozenset[str]) -> DataFrame:
        """The postings of the terms, and of the words that begin like one of the prefixes."""
        if self.only and not self.only.cover(terms, prefixes):
            raise ValueError(f"the index was made without some of these terms: {', '.join(terms)}")
        open_ends = [t for t in terms if t in prefixes]
        words, postings = set(terms), self.postings()
        if open_ends:
            starts = F.lit(False)
            for t in open_ends:
                starts = starts | F.col("term").startswith(t)
            longer = self._read("terms").where(starts).select("term").distinct()
            found = longer.take(MOST_WORDS + 1)
            if len(found) > MOST_WORDS:
                return postings.join(longer.union(self.spark.createDataFrame([(t,) for t in words], "term string")).distinct(), "term")
            words |= {r.term for r in found}
        return postings.where(F.col("shard").isin(sorted({shard_of(w) for w in words})) & F.col("term").isin(sorted(words)))

    def bm25(self, terms: tuple[str, ...], prefixes: frozenset[str] = frozenset()) -> DataFrame:
        """key, score, n_terms of the rows that hold a term, as `search.bm25` gives them from the texts."""
        if not terms:
            return self.postings().select("key", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms")).limit(0)
        test = lambda t: F.col("term").startswith(t) if t in prefixes else F.col("term") == t
        found = self.matching(terms, prefixes).groupBy("key").agg(F.first("length").alias("length"), *[F.coalesce(F.sum(F.when(test(t), F.col("tf"))), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        size = self.totals().agg(F.sum("n").alias("__n"), (F.sum("length") / F.sum("n")).alias("__avg"))
        df = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
        return scored_frequencies(found, size.join(df), "key", len(terms))  # one row and one row

    def search(self, query: TermQuery) -> tuple[DataFrame, bool]:
        """key, score of the rows with every term, or, if there is none, of those with any that means something; and
        whether it came to that."""
        strict = self.bm25(query.all).where(F.col("n_terms") == len(query.all)).select("key", "score")
        if not strict.isEmpty() or not query.any:
            return strict, False
        return self.bm25(query.any, query.prefixes).select("key", "score"), True
