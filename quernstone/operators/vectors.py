"""Exact nearest neighbours, coverage, evidence and greedy de-duplication over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.vector import cosine, l2, l2_to_cosine

#: Similarity from which a unit counts as covered, a claim as supported, two claims as one.
COVERED, SUPPORTED, SAME = 0.6, 0.6, 0.8
#: Share of uncovered units from which a supplement is asked for.
UNCOVERED = 0.25


def nearest(rows: DataFrame, key: str, vector: str, probe: list[float], n: int, where: Column | None = None) -> DataFrame:
    """key, distance, similarity of the n nearest rows. The filter comes first, so n rows are found if there are any."""
    kept = rows if where is None else rows.where(where)
    d = l2(F.col(vector), F.array(*[F.lit(float(x)) for x in probe]))
    return kept.select(key, d.alias("distance")).orderBy("distance", key).limit(n).withColumn("similarity", l2_to_cosine(F.col("distance")))


def nearest_many(rows: DataFrame, key: str, vector: str, probes: np.ndarray, names: list, n: int) -> DataFrame:
    """probe, key, distance of the n nearest rows of each of a bounded set of probes: every task keeps its own n best
    of each probe in one matrix product, and the tasks' bests are merged by a grouped top n."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"probe": [], "key": [], "distance": []})
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) if len(b) else np.zeros((0, probes.shape[1]))
            d = np.sqrt(np.maximum(0, (x**2).sum(1)[None, :] + (probes**2).sum(1)[:, None] - 2 * probes @ x.T))
            at = np.argsort(d, axis=1, kind="stable")[:, :n]
            found = pd.DataFrame({"probe": np.repeat(np.arange(len(probes)), at.shape[1]), "key": b[key].to_numpy()[at.reshape(-1)], "distance": np.take_along_axis(d, at, 1).reshape(-1)})
            best = pd.concat([best, found]).sort_values(["probe", "distance", "key"]).groupby("probe").head(n)
        best["probe"] = [names[int(i)] for i in best["probe"]]
        yield best

    found = rows.select(key, vector).mapInPandas(run, f"probe {'string' if names and isinstance(names[0], str) else 'long'}, key {kind}, distance double")
    top = F.slice(F.array_sort(F.collect_list(F.struct("distance", "key"))), 1, n)
    return found.groupBy("probe").agg(F.explode(top).alias("t")).select("probe", F.col("t.key").alias(key), "t.distance")


def nearest_to_rows(rows: DataFrame, key: str, vector: str, probes: DataFrame, n: int, block: int = 2048) -> DataFrame:
    """probe, key, distance, similarity: of each row of probes (key, vector) the n nearest of rows.

    Both tables are dealt into blocks of about `block` vectors by a hash of the key, every block of probes meets every
    block of rows in one matrix product, and the n nearest of each block are merged; nothing passes the driver but the
    two counts. Null vectors are left out; ties go by key."""
    have = rows.where(F.col(vector).isNotNull()).select(key, vector)
    asked = probes.where(F.col(vector).isNotNull()).select(F.col(key).alias("probe"), F.col(vector).alias("pv"))
    dealt = lambda df, c, seed, name: (k := max(1, -(-df.count() // block)), df.groupBy(F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(k)).alias(name)))[1]
    left = dealt(asked, "probe", 1, "pb").agg(F.collect_list("probe").alias("probes"), F.collect_list("pv").alias("pvs"))
    right = dealt(have, key, 2, "rb").agg(F.collect_list(key).alias("keys"), F.collect_list(vector).alias("vs"))
    p, k = rows.schema[key].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for names, pvs, keys, vs in zip(b.probes, b.pvs, b["keys"], b.vs):
                x, y, keys, names = np.stack(vs).astype(float), np.stack(pvs).astype(float), np.asarray(keys), np.asarray(names)
                rough = (x**2).sum(1)[None, :] - 2 * y @ x.T
                # the cut is inclusive, with room for rounding; the distances of what passes are computed plainly
                cut = np.partition(rough, n - 1, axis=1)[:, n - 1 : n] if len(keys) > n else np.full((len(names), 1), np.inf)
                i, j = np.nonzero(rough <= cut + 1e-9 * (1 + np.abs(cut)))
                far = np.sqrt(((y[i] - x[j]) ** 2).sum(1))
                yield pd.DataFrame({"probe": names[i], "key": keys[j], "distance": far})

    met = left.crossJoin(right).select("probes", "pvs", "keys", "vs").mapInPandas(run, f"probe {p}, key {k}, distance double")
    top = F.row_number().over(W.partitionBy("probe").orderBy("distance", "key"))
    found = met.withColumn("__n", top).where(F.col("__n") <= n)
    return found.select("probe", F.col("key").alias(key), "distance", l2_to_cosine(F.col("distance")).alias("similarity"))


def best_matches(units: DataFrame, items: DataFrame, group: str, unit: str, vector: str, item: str) -> DataFrame:
    """group, unit, similarity, item: each unit's most similar item of its own group (the first of equal ones); a unit
    without any has similarity 0. Items of a group are a card's, a few dozen."""
    others = items.select(F.col(group).alias("__g"), F.col(item).alias("__item"), F.col(vector).alias("__v"))
    near = cosine(F.col(vector), F.col("__v"))
    pairs = units.join(others, units[group] == others["__g"], "left").withColumn("__s", F.when(F.col("__v").isNotNull(), near).otherwise(0.0))
    return pairs.groupBy(group, unit).agg(F.max("__s").alias("similarity"), F.min_by("__item", F.struct(-F.col("__s"), F.col("__item"))).alias("item"))


def coverage(matches: DataFrame, group: str, least: float = COVERED, most: float = UNCOVERED) -> DataFrame:
    """group, n_units, n_uncovered, ratio, supplement."""
    out = matches.groupBy(group).agg(F.count("*").alias("n_units"), F.count_if(F.col("similarity") < least).alias("n_uncovered"))
    return out.withColumn("ratio", F.col("n_uncovered") / F.col("n_units")).withColumn("supplement", F.col("ratio") > most)


def verify_evidence(claims: DataFrame, windows: DataFrame, group: str, least: float = SUPPORTED) -> DataFrame:
    """claims: group, claim, seq, vector; windows: group, seq, vector (windows of the cited unit). Each cited place
    with its best similarity and why it goes: `missing` (no such place), `unsupported`, or null if it stays."""
    places = windows.select(F.col(group).alias("__g"), F.col("seq").alias("__seq"), F.col("vector").alias("__v"))
    pairs = claims.join(places, (claims[group] == places["__g"]) & (claims["seq"] == places["__seq"]), "left")
    scored = pairs.withColumn("__s", F.when(F.col("__v").isNotNull(), cosine(F.col("vector"), F.col("__v"))))
    best = scored.groupBy(group, "claim", "seq").agg(F.max("__s").alias("similarity"))
    return best.withColumn("dropped", F.when(F.col("similarity").isNull(), "missing").when(F.col("similarity") < least, "unsupported"))


def greedy_leaders(vectors: np.ndarray, least: float) -> list[int]:
    """For each vector in order the first leader that is similar enough; itself if none is."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
    leaders: list[int] = []
    out = []
    for i, v in enumerate(unit):
        near = np.flatnonzero(unit[leaders] @ v >= least) if leaders else []
        if len(near):
            out.append(leaders[near[0]])
        else:
            leaders.append(i)
            out.append(i)
    return out


def greedy_dedupe(rows: DataFrame, group: str, order: str, vector: str, least: float = SAME) -> DataFrame:
    """group, order, leader: each row's leader within its group, in order. The outcome depends on the order, so a group
    is one task's work; groups are a card's claims, bounded by the card."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).reset_index(drop=True)
        at = greedy_leaders(np.stack(g[vector].to_numpy()).astype(float), least)
        return pd.DataFrame({group: g[group], order: g[order], "leader": g[order].to_numpy()[at]})

    t = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(group, order, vector).groupBy(group).applyInPandas(run, f"{group} {t[group]}, {order} {t[order]}, leader {t[order]}")
