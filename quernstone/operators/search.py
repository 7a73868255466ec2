"""Text retrieval: term queries, BM25, relaxation, title coverage, rank fusion and grouping by conversation.

A query's terms are few, so each list is one scan: term frequencies come from array functions over a row's tokens and
corpus statistics from one aggregate row. For many queries over one corpus, `postings` is the stored form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import QUERY_STOPWORDS, tokens

K1, B = 1.2, 0.75
#: Smallest idf of a term that most rows hold.
LEAST_IDF = 1e-6
RRF_K = 60.0
#: Weight of a list that only the any-term query filled.
RELAXED = 0.6
#: Weights of the lists in the fusion.
WEIGHTS = {"titles": 1.5, "cards": 1.2, "text": 1.0, "vectors": 1.5}
#: Rows a conversation may show, and what its other hits may add to the best one's score.
PER_CONVERSATION, CORROBORATION = 3, 0.12


@dataclass(frozen=True)
class TermQuery:
    """all: every term, for a strict search; any: the terms that mean something, for a relaxed one; prefixes: those
    of `any` that also match longer words."""

    all: tuple[str, ...]
    any: tuple[str, ...]
    prefixes: frozenset[str]


def term_query(text: str, most: int = 24, prefix_from: int = 6) -> TermQuery:
    words = list(dict.fromkeys(re.findall(r"\w+", text.lower())[:most]))
    telling = [w for w in words if w not in QUERY_STOPWORDS] or words
    return TermQuery(tuple(words), tuple(telling), frozenset(w for w in telling if len(w) >= prefix_from))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def term_frequencies(rows: DataFrame, key: str, columns: dict[str, float], terms: tuple[str, ...], prefixes: frozenset[str] = frozenset()) -> DataFrame:
    """key, length (tokens in all columns) and tf0, tf1, ...: weighted frequency of each term."""
    held = rows.select(key, *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"__{i}") for i, c in enumerate(columns)])
    weights = list(columns.values())

    def hits(term: str) -> Column:
        test = (lambda x: x.startswith(term)) if term in prefixes else (lambda x: x == term)
        return _sum([F.lit(float(w)) * F.size(F.filter(f"__{i}", test)) for i, w in enumerate(weights)])

    return held.select(key, _sum([F.size(f"__{i}") for i in range(len(weights))]).alias("length"), *[hits(t).alias(f"tf{i}") for i, t in enumerate(terms)])


def bm25(rows: DataFrame, key: str, columns: dict[str, float], terms: tuple[str, ...], prefixes: frozenset[str] = frozenset()) -> DataFrame:
    """key, score, n_terms of the rows that hold a term. Statistics are over all rows: apply other filters after.

    Null texts have no tokens. No terms or no rows: an empty result.
    """
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms")).limit(0)
    found = term_frequencies(rows, key, columns, terms, prefixes)
    corpus = found.agg(F.count("*").alias("__n"), F.avg("length").alias("__avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    return scored_frequencies(found, corpus, key, len(terms))


def scored_frequencies(found: DataFrame, corpus: DataFrame, key: str, n_terms: int) -> DataFrame:
    """key, score, n_terms from found (key, length, tf0, tf1, ...) and corpus: one row of __n, __avg and __df0, __df1, ..."""
    n = range(n_terms)
    idf = lambda i: F.greatest(F.lit(LEAST_IDF), F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5)))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("__avg"))
    part = lambda i: F.when(F.col(f"tf{i}") > 0, idf(i) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)).otherwise(0.0)
    matched = reduce(lambda a, b: a + b, [F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in n])
    holds = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in n])
    # one row; broadcasting it is no join of data
    return found.where(holds).join(F.broadcast(corpus)).select(key, _sum([part(i) for i in n]).alias("score"), matched.cast("long").alias("n_terms"))


def relaxed(scored: DataFrame, n_all: int) -> DataFrame:
    """Rows with every term if there is one, else all rows; `relaxed` says which."""
    strict = F.max(F.col("n_terms") >= n_all).alias("__strict")
    return scored.join(F.broadcast(scored.agg(strict))).where("NOT __strict OR n_terms >= " + str(n_all)).withColumn("relaxed", ~F.col("__strict")).drop("__strict")


def postings(rows: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """term, key, tf (weighted), length: the inverted index, to be written bucketed by term."""
    weigh = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    weighted = [F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), weigh(w)) for c, w in columns.items()]
    held = rows.select(key, F.concat(*weighted).alias("__t")).withColumn("length", F.size("__t"))
    return held.select(key, "length", F.explode("__t").alias("t")).groupBy(F.col("t.term").alias("term"), key).agg(F.sum("t.w").alias("tf"), F.first("length").cast("double").alias("length"))


def score_postings(index: DataFrame, corpus: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query, key, score of many queries (query, term) over an index; corpus: one row, n and avg_length."""
    hits = index.join(F.broadcast(queries.distinct()), "term")
    df = hits.select("term", key).distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("avg_length"))
    each = hits.join(F.broadcast(df), "term").join(F.broadcast(corpus)).withColumn("s", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    return each.groupBy("query", key).agg(F.sum("s").alias("score"))


def title_matches(rows: DataFrame, key: str, title: Column, terms: tuple[str, ...]) -> DataFrame:
    """key, title, matched, coverage: the titles that hold as many terms as the best title does."""
    listed = F.array(*[F.lit(t) for t in terms])
    found = rows.select(key, title.alias("title")).withColumn("matched", F.size(F.filter(listed, lambda t: F.contains(F.lower("title"), t)))).where("matched > 0")
    best = found.agg(F.max("matched").alias("__best"))
    return found.join(F.broadcast(best), F.col("matched") == F.col("__best")).select(key, "title", F.col("matched").cast("long").alias("matched"), (F.col("matched") / F.lit(float(len(terms)))).alias("coverage"))


def top(rows: DataFrame, key: str, depth: int, by: str = "score") -> DataFrame:
    return rows.orderBy(F.desc(by), key).limit(depth)


def ranked_list(rows: DataFrame, name: str, key: str, raw: str, weight: float) -> DataFrame:
    """list, key, rank, raw, weight of one list that was cut to its depth already."""
    rank = F.row_number().over(W.partitionBy("list").orderBy(F.desc("raw"), "key"))
    return rows.select(F.lit(name).alias("list"), F.col(key).alias("key"), F.col(raw).cast("double").alias("raw"), F.lit(float(weight)).alias("weight")).withColumn("rank", rank.cast("long"))


def fuse(lists: DataFrame, k: float = RRF_K) -> DataFrame:
    """key, score, n_lists, provenance by weighted reciprocal rank: a list gives weight / (k + rank)."""
    given = F.col("weight") / (F.lit(k) + F.col("rank"))
    by = F.struct("list", "rank", "raw", given.alias("contribution"))
    return lists.groupBy("key").agg(F.sum(given).alias("score"), F.count("*").alias("n_lists"), F.array_sort(F.collect_list(by)).alias("provenance"))


def diversify(hits: DataFrame, conversation: str, key: str, most: int = PER_CONVERSATION) -> DataFrame:
    """The best hits of each conversation, with their place in it."""
    place = F.row_number().over(W.partitionBy(conversation).orderBy(F.desc("score"), key))
    return hits.withColumn("place", place).where(F.col("place") <= most)


def without_repeats(hits: DataFrame, conversation: str, text: Column, key: str) -> DataFrame:
    """Later hits of a conversation with a text that an earlier one has go; blank texts stay."""
    nth = F.row_number().over(W.partitionBy(conversation, "__t").orderBy(F.desc("score"), key))
    return hits.withColumn("__t", F.trim(text)).withColumn("__n", nth).where("__t = '' OR __t IS NULL OR __n = 1").drop("__t", "__n")


def conversations(hits: DataFrame, conversation: str, key: str, corroboration: float = CORROBORATION) -> DataFrame:
    """conversation, score, n_hits, best (key): the best hit's score and, within bounds, half of the others'."""
    best, rest = F.max("score"), F.sum("score") - F.max("score")
    return hits.groupBy(conversation).agg((best + F.least(rest / 2, F.lit(corroboration) * best)).alias("score"), F.count("*").alias("n_hits"), F.min_by(key, F.struct(-F.col("score"), F.col(key))).alias("best"))


def explain(fused: DataFrame) -> DataFrame:
    """key, list, rank, contribution, share of the hit's score, and the hit's margin to the next one."""
    margin = F.col("score") - F.lead("score").over(W.orderBy(F.desc("score"), "key"))  # of a result page, cut before
    rows = fused.withColumn("margin", margin).select("key", "score", "margin", F.explode("provenance").alias("p"))
    return rows.select("key", "p.list", "p.rank", "p.contribution", (F.col("p.contribution") / F.col("score")).alias("share"), "margin")


def note_score(body: Column, heading: Column, terms: tuple[str, ...], require_all: bool) -> Column:
    """Share of the terms that a section's body holds, half as much for its heading, less for long bodies."""
    listed = F.array(*[F.lit(t) for t in terms])
    count = lambda text: F.size(F.filter(listed, lambda t: F.contains(F.lower(text), t)))
    either = F.size(F.filter(listed, lambda t: F.contains(F.lower(body), t) | F.contains(F.lower(heading), t)))
    score = (count(body) + 0.5 * count(heading)) / len(terms) / (1 + F.log10(1 + F.char_length(body) / F.lit(400.0)))
    return F.when(either >= (len(terms) if require_all else 1), score).otherwise(0.0)


def federate(lists: DataFrame, k: float = RRF_K, unranked: float = 0.5) -> DataFrame:
    """Hits of several stores (list, key, rank, weight, scored) as one: a list without scores counts half."""
    weight = F.col("weight") * F.when(F.col("scored"), 1.0).otherwise(unranked)
    return lists.groupBy("key").agg(F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"))
