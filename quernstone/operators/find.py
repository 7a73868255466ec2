"""The full search: text lists, titles and vector lists, fused by weighted rank, grouped by conversation.

Each list is cut to its depth before the fusion; what comes after works on a few hundred rows. Text lists are answered
from stored indexes, every word first and then, list by list, any telling word at a lower weight. Vectors are asked only
where the words did not settle the question.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators import search as S
from quernstone.operators.index import TextIndex
from quernstone.operators.vectors import nearest

#: How many candidates a list gives for a page, at least.
DEPTH, PER_PAGE = 60, 10


@dataclass(frozen=True)
class Archive:
    """What is searched. rows: key, session, conversation, seq, text and whatever filters read, for all lists; titles:
    key, title; texts: an index by list; vectors: key, vector by list (unit vectors); main: the text list whose answer
    settles whether vectors are asked."""

    rows: DataFrame
    titles: DataFrame | None
    texts: Mapping[str, TextIndex]
    vectors: Mapping[str, DataFrame] = field(default_factory=dict)
    weights: Mapping[str, float] = field(default_factory=dict)
    main: str = ""


@dataclass(frozen=True)
class Found:
    """fused: key, score, n_lists, provenance of all candidates; hits: of the page, with their conversation; sessions:
    conversation, score, n_hits, best; weights: by list that ran; relaxed: the lists that any-word search filled."""

    fused: DataFrame
    hits: DataFrame
    sessions: DataFrame
    weights: dict[str, float]
    relaxed: tuple[str, ...]


def allowed_lists(names: list[str], ghosts: str = "include", sidechains: str = "include", status: str | None = None, by_file: bool = False, ghost_lists: tuple[str, ...] = (), live_lists: tuple[str, ...] = ()) -> list[str]:
    """The lists that the tri-state filters leave on: ghosts only turns the live lists off; ghosts excluded, sidechains
    only, a status of living sessions or a file filter turn the ghosts' lists off."""
    only = status == "ghost" or ghosts == "only"
    off = set(live_lists) if only else set()
    if not only and (ghosts == "exclude" or status) or sidechains == "only" or by_file:
        off |= set(ghost_lists)
    return [n for n in names if n not in off]


def title_list(titles: DataFrame, terms: tuple[str, ...]) -> tuple[DataFrame, float]:
    """key, raw of the titles with the most of the terms, shorter ones first; and the share of the terms they have."""
    found = S.title_matches(titles, "key", F.col("title"), terms)
    best = found.agg(F.max("coverage").alias("c")).first().c
    return found.select("key", F.col("matched").cast("double").alias("raw"), F.char_length("title").alias("tie")), best or 0.0


def find(archive: Archive, query: str, where: Column | None = None, lists: list[str] | None = None, query_vector: list[float] | None = None, vectors: bool | None = None, limit: int = 10, k: float = S.RRF_K) -> Found:
    """The page of conversations for a query. where: a condition on archive.rows, met by every candidate before its
    list is cut. vectors: True asks them, False doesn't, None only if the main text list had to relax or is empty.

    No word in the query, no list or no row: an empty page.
    """
    terms, depth = S.term_query(query), max(limit * PER_PAGE, DEPTH)
    names = [n for n in ["titles", *archive.texts, *archive.vectors] if lists is None or n in lists]
    rows = archive.rows if where is None else archive.rows.where(where)
    parts, weights, relaxed, settled = [], {}, [], False

    def add(name: str, hits: DataFrame, weight: float, descending: bool = True) -> None:
        """hits: key, raw and, to part equal ones, tie."""
        order = [F.desc("raw") if descending else F.asc("raw"), *(["tie"] if "tie" in hits.columns else []), "key"]
        cut = hits.join(rows.select("key"), "key", "left_semi").orderBy(*order).limit(depth)
        parts.append(cut.select("key", F.lit(name).alias("list"), "raw", F.lit(float(weight)).alias("weight"), F.row_number().over(W.orderBy(*order)).cast("long").alias("rank")))  # of a list that is cut
        weights[name] = float(weight)

    if not terms.all:
        names = []
    if "titles" in names and archive.titles is not None:
        hits, coverage = title_list(archive.titles, terms.all)
        add("titles", hits, archive.weights.get("titles", S.WEIGHTS["titles"]) * coverage)
    for name, index in archive.texts.items():
        if name in names:
            hits, loose = index.search(terms)
            hits = hits.withColumnRenamed("score", "raw")
            add(name, hits, archive.weights.get(name, 1.0) * (S.RELAXED if loose else 1.0))
            relaxed += [name] if loose else []
            settled |= name == archive.main and not loose and not hits.isEmpty()
    if query_vector is not None and vectors is not False and not (vectors is None and settled):
        for name, held in archive.vectors.items():
            if name in names:
                # filters stand before the nearest are taken
                near = nearest(held.join(rows.select("key"), "key", "left_semi"), "key", "vector", query_vector, depth)
                add(name, near.select("key", F.col("distance").alias("raw")), archive.weights.get(name, S.WEIGHTS["vectors"]), False)
    if not parts:
        nothing = rows.select("key", F.lit("").alias("list"), F.lit(0.0).alias("raw"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("rank")).limit(0)
        parts.append(nothing)
    fused = S.fuse(reduce(DataFrame.unionByName, parts), k)
    known = rows.select("key", "session", "conversation", "seq", "text")
    ranked = fused.join(known, "key")  # of at most depth rows a list; the page is cut below
    first = F.row_number().over(W.partitionBy("conversation").orderBy(F.desc("score"), F.coalesce("seq", F.lit(0)), "key"))
    hits = ranked.withColumn("place", first).where(F.col("place") <= S.PER_CONVERSATION)
    # three pages of conversations in the order of their best hits, then by their own score
    lead = hits.where("place = 1").orderBy(F.desc("score"), F.coalesce("seq", F.lit(0)), "key").limit(3 * limit).select("conversation")
    hits = S.without_repeats(hits.join(lead, "conversation", "left_semi"), "conversation", F.col("text"), "key")
    sessions = S.conversations(hits, "conversation", "key").orderBy(F.desc("score"), "conversation").limit(limit)
    return Found(fused, hits.join(sessions.select("conversation"), "conversation", "left_semi"), sessions, weights, tuple(relaxed))


def solve_weights(hits: DataFrame, k: float = S.RRF_K, passes: int = 3) -> dict[str, float]:
    """The lists' weights as the hits' scores tell them: hits of one list give its weight, hits with one list of unknown
    weight the rest of theirs; the median counts. hits: key, score, provenance of a result page. Lists that no hit
    isolates are missing."""
    rows = hits.select("key", "score", F.explode("provenance").alias("p")).select("key", "score", "p.list", (k + F.col("p.rank")).alias("away"))
    samples, known = None, {}
    for _ in range(1 + passes):
        weight = F.lit(None).cast("double")
        for name, w in known.items():  # a handful
            weight = F.when(F.col("list") == name, F.lit(w)).otherwise(weight)
        left = rows.withColumn("w", weight).groupBy("key", "score").agg(F.sum(F.coalesce(F.col("w") / F.col("away"), F.lit(0.0))).alias("had"), F.count_if(F.col("w").isNull()).alias("open"), F.first(F.when(F.col("w").isNull(), F.struct("list", "away")), True).alias("x"))
        more = left.where("open = 1").select("x.list", ((F.col("score") - F.col("had")) * F.col("x.away")).alias("w")).where("w > 0")
        samples = more if samples is None else samples.union(more)
        found = {r.list: r.w for r in samples.groupBy("list").agg(F.median("w").alias("w")).collect()}
        if found.keys() == known.keys():
            break
        known = found
    return known


def ledger(hits: DataFrame, weights: Mapping[str, float], k: float = S.RRF_K) -> DataFrame:
    """key, list, rank, weight, part (what the list gave by that weight), residual (of the hit's score; what no weight
    explains), for each list of each hit of a page. Lists without a known weight count 1."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("list") == name, F.lit(float(w))).otherwise(weight)
    rows = hits.select("key", "score", F.explode("provenance").alias("p")).select("key", "score", "p.list", "p.rank")
    rows = rows.withColumn("weight", weight).withColumn("part", F.col("weight") / (k + F.col("rank")))
    return rows.withColumn("residual", F.col("score") - F.sum("part").over(W.partitionBy("key"))).drop("score")


def best_side(sides: list[tuple[str, Column]], phrase: str, terms: tuple[str, ...], boilerplate: Column | None = None) -> Column:
    """Which of several texts to quote: the one with the whole phrase, then with the most different terms, then one that
    is not boilerplate, then the first. Texts without any term are not quoted: null."""
    listed, rows = F.array(*[F.lit(t) for t in terms]), []
    for i, (name, text) in enumerate(sides):
        low = F.lower(F.coalesce(text, F.lit("")))
        n = F.size(F.filter(listed, lambda t: F.contains(low, t)))  # noqa: B023
        plain = F.lit(0) if boilerplate is None else F.when(boilerplate, 1).otherwise(0)
        rows.append(F.struct((-F.contains(low, F.lit(phrase.lower())).cast("int")).alias("p"), (-n).alias("n"), plain.alias("b"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    first = F.get(F.array_sort(F.array(*rows)), F.lit(0))
    return F.when(first.n < 0, first["name"])
