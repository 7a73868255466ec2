"""Session cards: planning, merging, open threads, budgets, calibration, evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import token_estimate
from quernstone.operators.stored import kept

#: Characters from which a transcript is cut into chunks, of a chunk, of a unit; exchanges and prompts that make a card.
WHOLE, CHUNK, UNIT, MIN_EXCHANGES, MIN_PROMPTS = 60_000, 40_000, 20_000, 3, 5
#: A token in more than this share of the cards is generic, once there are so many cards.
GENERIC_SHARE, GENERIC_CARDS = 0.3, 20
#: Shared tokens of two projects, anchors of a decision, similarity that counts as a mention.
OVERLAP, ANCHORS, MENTION = 3, 2, 0.35
#: Decisions, and things said, that meet in a task; similarities computed at once; tokens up to which they are broadcast.
ASKED, SAID, CELLS, FEW_TOKENS = 1_000, 10_000, 1 << 20, 1_000_000


def plan_cards(units: DataFrame, cards: DataFrame, session: str, chars: str, modified: str, created: str, least: int = MIN_EXCHANGES) -> DataFrame:
    """session, n, chars, calls, reason (`new` or `stale`): sessions large enough without a card, or with one older
    than their source. units: session, chars, modified; cards: session, created."""
    size = F.least(F.col(chars), F.lit(UNIT))
    held = units.groupBy(session).agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(modified).alias("__m")).where(F.col("n") >= least)
    rows = held.join(cards.select(F.col(session).alias("__s"), F.col(created).alias("__c")), F.col(session) == F.col("__s"), "left")
    chunks = F.ceil(F.col("chars") / CHUNK)
    calls = F.when(F.col("chars") <= WHOLE, 1).otherwise(chunks + 1).cast("long")
    reason = F.when(F.col("__c").isNull(), "new").when(F.col("__m") > F.col("__c"), "stale")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(session, "n", "chars", calls.alias("calls"), "reason")


def generic_tokens(cards: DataFrame, key: str, tokens: str, share: float = GENERIC_SHARE, least: int = GENERIC_CARDS) -> DataFrame:
    """token, n_cards of the tokens that too many cards hold to say anything."""
    held = cards.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    df = held.groupBy("token").agg(F.count("*").alias("n_cards"))
    total = cards.agg(F.count("*").alias("__total"))
    return df.join(F.broadcast(total)).where((F.col("__total") >= least) & (F.col("n_cards") > share * F.col("__total"))).drop("__total")


def telling_tokens(cards: DataFrame, project: str, tokens: str, among: DataFrame | None = None, share: float = GENERIC_SHARE, least: int = GENERIC_CARDS) -> DataFrame:
    """project, token (distinct) of the cards' tokens without generic ones, counted in one pass. among: a stored table
    of distinct tokens; the others are dropped before they are counted."""
    words = cards.select(project, F.explode(F.array_distinct(tokens)).alias("token"))
    if among is not None:
        words = words.join(F.broadcast(among) if among.count() <= FEW_TOKENS else among, "token", "left_semi")
    held = words.groupBy(project, "token").agg(F.count("*").alias("__n"))
    held = held if among is None else kept(held)
    total = cards.count()
    if total < least:
        return held.select(project, "token")
    generic = held.groupBy("token").agg(F.sum("__n").alias("__n")).where(F.col("__n") > share * total).select("token")
    return held.join(F.broadcast(generic), "token", "left_anti").select(project, "token")  # 1 / share times a card's tokens at most


def merge_lists(base: Column, extra: Column, most: int) -> Column:
    """base, then what extra adds, compared without case, at most so many."""
    low = F.transform(base, F.lower)
    fresh = F.filter(extra, lambda x: ~F.array_contains(low, F.lower(x)))
    once = F.aggregate(fresh, F.array().cast("array<string>"), lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))))
    return F.slice(F.concat(base, once), 1, most)


def same_project(a: Column, b: Column) -> Column:
    x, y = F.rtrim(a, F.lit("/")), F.rtrim(b, F.lit("/"))
    return (a == b) | x.startswith(F.concat(y, F.lit("/"))) | y.startswith(F.concat(x, F.lit("/")))


def best_alike(asked: DataFrame, said: DataFrame) -> DataFrame:
    """decision, b, best: of what each project says the highest cosine with each decision, where they share a token.

    asked: decision, tokens; said: b, tokens; both read from stored tables, none null or empty, tokens distinct. They meet block by block, and of each pair
    of blocks only the best of a decision and project goes on.
    """
    blocks, parts = max(1, -(-asked.count() // ASKED)), max(1, -(-said.count() // SAID))
    one_of = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(one_of(blocks).alias("block"), "decision", "tokens").withColumn("part", each(parts))
    right = said.select(one_of(parts).alias("part"), "b", "tokens").withColumn("block", each(blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"decision": left["decision"].slice(0, 0), "b": right["b"].slice(0, 0), "best": pa.array([], pa.float64())})
        flat, n = pc.list_flatten(left["tokens"]).combine_chunks(), pc.list_value_length(left["tokens"]).to_numpy()
        terms = pc.unique(flat)
        ids = pc.index_in(flat, terms).to_numpy()
        order = np.argsort(ids, kind="stable")
        decision, first = np.repeat(np.arange(len(n)), n)[order], np.searchsorted(ids[order], np.arange(len(terms) + 1))
        size = pc.list_value_length(right["tokens"]).to_numpy()
        found = pc.index_in(pc.list_flatten(right["tokens"]), terms, skip_nulls=True).combine_chunks()
        there = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        term, of = found.fill_null(-1).to_numpy()[there], np.repeat(np.arange(len(size)), size)[there]
        projects = right["b"].combine_chunks().dictionary_encode()
        b, best, step = projects.indices.to_numpy(), np.zeros((len(projects.dictionary), len(n))), max(1, CELLS // len(n))
        for low in range(0, len(size), step):
            high = min(len(size), low + step)
            i, j = np.searchsorted(of, (low, high))
            times = first[term[i:j] + 1] - first[term[i:j]]
            places = np.repeat(first[term[i:j]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            shared = np.bincount(np.repeat(of[i:j] - low, times) * len(n) + decision[places], minlength=(high - low) * len(n)).reshape(high - low, len(n))
            np.maximum.at(best, b[low:high], shared / np.sqrt(n.astype(np.float64) * size[low:high, None]))
        y, x = np.nonzero(best)
        return pa.table({"decision": left["decision"].combine_chunks().take(pa.array(x)), "b": projects.dictionary.take(pa.array(y)), "best": best[y, x]})

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c, rows in (("decision", asked), ("b", said))]
    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, f"{', '.join(kinds)}, best double")
    return near.groupBy("decision", "b").agg(F.max("best").alias("best"))


def open_threads(decisions: DataFrame, tokens: DataFrame, mentions: DataFrame, limit: int, overlap: int = OVERLAP, anchors: int = ANCHORS, mention: float = MENTION, telling: DataFrame | None = None) -> DataFrame:
    """Decisions of one project that bear on another one which never mentions them.

    decisions: decision, project, what, tokens (array); tokens: project, token (distinct, no generic ones);
    mentions: project, tokens (array) of what the other side says; telling: those rows of tokens whose token a decision
    has, where they are at hand for less. Projects meet on the tokens they share, never all with all. All tokens are
    read only for projects that share too few of the decisions' tokens to be known as overlapping.
    """
    d = decisions.select("decision", F.col("project").alias("a"), "what", F.array_distinct("tokens").alias("dt"))
    telling = kept(tokens.join(d.select(F.explode("dt").alias("token")).distinct(), "token", "left_semi") if telling is None else telling)
    # the decisions' own tokens lead: a word that many projects have makes no pairs of projects unless a decision has it
    told = d.select("decision", "a", F.explode("dt").alias("token")).join(telling.withColumnRenamed("project", "a"), ["a", "token"], "left_semi")
    apart = (F.col("a") != F.col("b")) & ~same_project(F.col("a"), F.col("b"))
    met = told.join(telling.select(F.col("project").alias("b"), "token"), "token").where(apart)
    anchored = kept(met.groupBy("decision", "a", "b").agg(F.count("*").alias("anchor"), F.collect_set("token").alias("by")).where(F.col("anchor") >= anchors))
    known = anchored.select("a", "b", F.explode("by").alias("token")).distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = kept(known.select("a", "b", (F.col("n") >= overlap).alias("near")))
    near, rest = pairs.where("near").select("a", "b"), pairs.where("NOT near").select("a", "b")
    if not rest.isEmpty():
        mine = rest.join(tokens.withColumnRenamed("project", "a"), "a")
        near = near.union(mine.join(tokens.withColumnRenamed("project", "b"), ["b", "token"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= overlap).select("a", "b"))
    raised = kept(anchored.select("decision", "a", "b", "anchor").join(near, ["a", "b"]))
    asked = kept(raised.select("decision", "a").distinct().join(d, ["decision", "a"]).select("decision", F.col("dt").alias("tokens")))
    said = mentions.where("project IS NOT NULL AND size(tokens) > 0").select(F.col("project").alias("b"), F.array_distinct("tokens").alias("tokens"))
    alike = best_alike(asked, said)
    scored = raised.join(alike, ["decision", "b"], "left").fillna(0.0, ["best"]).where(F.col("best") < mention)
    rows = scored.join(d.select("decision", "what"), "decision").withColumn("score", F.col("anchor") * (1 - F.least(F.lit(1.0), F.col("best") / mention)))
    first = F.row_number().over(W.partitionBy(F.lower("what")).orderBy(F.desc("score"), "decision", "b"))
    return rows.withColumn("__n", first).where("__n = 1").orderBy(F.desc("score"), "what").limit(limit).select("decision", F.col("a").alias("project"), F.col("b").alias("other"), "what", "score")


def word_budget(rows: DataFrame, group: str, order: str, words: str, most: int = 150) -> DataFrame:
    """Rows up to a running sum of words; the first stays whatever its size, and after the first cut all go."""
    w = W.partitionBy(group).orderBy(order)
    rows = rows.withColumn("__used", F.sum(words).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return rows.where((F.col("__used") <= most) | (F.col("__n") == 1)).drop("__used", "__n")


def token_budget(rows: DataFrame, group: str, order: str, chars: str, most: int) -> DataFrame:
    """The last rows of each group whose estimated tokens fit, the newest at least."""
    w = W.partitionBy(group).orderBy(F.desc(order))
    rows = rows.withColumn("__used", F.sum(token_estimate(F.col(chars))).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return rows.where((F.col("__used") <= most) | (F.col("__n") == 1)).drop("__used", "__n")


def number_citations(rows: DataFrame, group: str, position: str, source: str) -> DataFrame:
    """A dense number for each source, in order of its first appearance within the group."""
    first = F.min(position).over(W.partitionBy(group, source))
    return rows.withColumn("__first", first).withColumn("number", F.dense_rank().over(W.partitionBy(group).orderBy("__first", source))).drop("__first")


def check_citations(cited: DataFrame, sessions: DataFrame, units: DataFrame, key: str, seq: str, prefix: int) -> DataFrame:
    """cited: prefix (of an id), seq. Adds verdict: `unknown`, `unresolved` or `ok`, by equality on prefix and seq."""
    ids = sessions.select(F.substring(F.col(key).cast("string"), 1, prefix).alias("prefix")).distinct().withColumn("__id", F.lit(1))
    there = units.select(F.substring(F.col(key).cast("string"), 1, prefix).alias("prefix"), F.col(seq).alias("seq")).distinct().withColumn("__seq", F.lit(1))
    rows = cited.join(ids, "prefix", "left").join(there, ["prefix", "seq"], "left")
    return rows.withColumn("verdict", F.when(F.col("__id").isNull(), "unknown").when(F.col("__seq").isNull(), "unresolved").otherwise("ok")).drop("__id", "__seq")


def filter_answer(sentences: DataFrame, evidence: DataFrame, units: DataFrame, order: str, most_words: int = 150) -> DataFrame:
    """Sentences (answer, order, text, cites) of which a citation holds: the cited unit (session, seq) exists and has
    the quote, verbatim after normalising. evidence: answer, cite, session, seq, quote. Within a word budget."""
    from quernstone.functions.text import quotes, word_count

    good = evidence.join(units, ["session", "seq"]).where(quotes(F.col("unit_text"), F.col("quote"))).select("answer", F.col("cite").alias("c")).distinct()
    kept = sentences.withColumn("c", F.explode("cites")).join(good, ["answer", "c"]).groupBy("answer", order, "text").agg(F.array_sort(F.collect_set("c")).alias("cites"))
    return word_budget(kept.withColumn("words", word_count(F.col("text"))), "answer", order, "words", most_words)


def fair_excerpts(units: DataFrame, group: str, order: str, chars: str, budget: int) -> DataFrame:
    """Units of each group up to its share of a character budget: rounds of one unit a group, so that short groups
    leave their share to long ones."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(order))
    rows = units.withColumn("round", nth)
    per = rows.groupBy("round").agg(F.sum(chars).alias("__c")).withColumn("__used", F.sum("__c").over(W.orderBy("round")))  # one row a round
    last = per.where(F.col("__used") <= budget).agg(F.coalesce(F.max("round"), F.lit(1)).alias("__last"))
    return rows.join(F.broadcast(last)).where("round <= __last").drop("__last")


def calibration(runs: DataFrame, by: list[str], ratio: Column, complete: Column, recent: Column, last: int = 5) -> DataFrame:
    """by, n, ratio: median of the last so many complete runs' ratios, held between 1/5 and 5."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(recent.desc()))
    rows = runs.where(complete).withColumn("__r", ratio).withColumn("__n", nth).where(F.col("__n") <= last)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.greatest(F.lit(0.2), F.least(F.lit(5.0), F.median("__r"))).alias("ratio"))


def estimate(rows: DataFrame, chars: str, seconds_per_call: float, usd_per_mtoken: float, concurrency: int) -> DataFrame:
    """Calls, tokens, seconds and money that carding the rows takes."""
    calls = F.when(F.col(chars) <= WHOLE, 1).otherwise(F.ceil(F.col(chars) / CHUNK) + 1)
    each = rows.select(calls.cast("long").alias("calls"), token_estimate(F.col(chars)).alias("tokens"))
    total = each.agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    together = F.least(F.lit(concurrency), F.greatest(F.col("calls"), F.lit(1)))
    return total.withColumn("seconds", F.ceil(F.col("calls") / together) * seconds_per_call).withColumn("usd", F.col("tokens") * usd_per_mtoken / 1e6)


def recall_at(expected: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """expected: query, prefix; ranked: query, key (text), rank. One row: queries, and hits within each k."""
    hits = expected.join(ranked, "query", "left").where(F.col("key").startswith(F.col("prefix"))).groupBy("query").agg(F.min("rank").alias("rank"))
    rows = expected.join(hits, "query", "left")
    return rows.agg(F.count("*").alias("n_queries"), *[F.count_if(F.col("rank") <= k).alias(f"hits_at_{k}") for k in ks])


def nearest_rank(rows: DataFrame, group: str, value: str, shares: tuple[float, ...], pieces: int = 256) -> DataFrame:
    """group, p50, ...: percentiles as elements of the sorted values, the one at floor(p * n), from 0; nulls don't count.

    Equal values are counted before they are sorted. A group's values fall into pieces between approximate quantiles;
    counts tell the piece that holds a rank, and only that one is sorted, so that no task gets all values of a group.
    Approximate quantiles differ from one computation to the next, so the pieces are made once and kept."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    bounds = kept(counts.groupBy(group).agg(F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 10 * pieces).alias("bounds"), F.sum("n").alias("total")))
    cut = kept(counts.join(bounds, group).withColumn("piece", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds"))
    sums = cut.groupBy(group, "piece", "total").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(group).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = F.explode(F.array(*[F.struct(F.lit(f"p{round(100 * p)}").alias("name"), F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total"))).alias("at")) for p in shares]))
    held = sums.withColumn("before", before).select(group, "piece", "m", "before", wanted.alias("x")).where("x.at >= before AND x.at < before + m")
    until = F.sum("n").over(W.partitionBy(group, "piece", "name").orderBy("v"))
    inside = cut.join(held.select(group, "piece", "before", "x.name", "x.at"), [group, "piece"]).withColumn("until", F.col("before") + until)
    found = inside.where("at < until AND at >= until - n")
    return found.groupBy(group).agg(*[F.max(F.when(F.col("name") == f"p{round(100 * p)}", F.col("v"))).alias(f"p{round(100 * p)}") for p in shares])


def overlap_share(question: Column, target: Column) -> Column:
    """Share of the question's distinct words that the target holds."""
    q = F.array_distinct(question)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, target)) / F.size(q).cast("double"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
