"""SimHash near-duplicates, found by vantage-point trees over Hamming distance.

The different fingerprints are dealt into shards by the upper levels of a vantage-point tree, fitted to a bounded
sample: inside a node's ball or outside of it. A fingerprint is also sent, as a query, to each shard that a ball of
the link distance around it overlaps. Every shard builds the lower levels of the tree over its own fingerprints and
searches its queries, pruning by the triangle bound, so all pairs within the distance are met. A shard returns
links that span what it joined, not all pairs.

A few bits over whole texts miss most texts of which a tenth was changed, so `near_copies` adds an exact join of the
sets of shingles by filtered prefixes: rare shingles lead them, groups are joined through a first member, and what
that leaves apart is compared pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, joined_ids, no_model, slices, stored, tidy
from .components import components
from .substrings import FACTOR, mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
SEED = 42
#: Fingerprints a shard should own; the sample that the upper tree is fitted to: fingerprints of each shard, and in
#: all at least and at most (32 MB in the driver; beyond it shards grow with the table).
SHARD, OF_SHARD, LEAST_SAMPLE, MOST_SAMPLE = 16_384, 64, 8_192, 1 << 22
#: Own fingerprints of a leaf, and comparisons made at once.
LEAF, BLOCK = 192, 1 << 20
#: Share of the documents that frequent shingles are counted in, and documents at least; documents that make one
#: frequent; as many are told apart at most (8 MB); members of a block of those that share a shingle.
SAMPLED, LEAST_SAMPLED, FREQUENT, MOST_FREQUENT, MEMBERS = 1 / 16, 4_096, 64, 1 << 20, 1_000


def words_of(text: str) -> list[bytes]:
    """Words between the six white bytes \\x20 \\x09-\\x0D, A-Z lower-cased."""
    return text.encode().translate(TO_LOWER).split()


def shingles_of(words: list[bytes], shingle: int) -> list[bytes]:
    """The shingles, repeats included; of fewer words the whole sequence, of none nothing."""
    if len(words) >= shingle:
        return [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))]
    return [b" ".join(words)] if words else []


def fingerprints(texts: list[str], shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for begin, end in slices([len(x) for x in texts], 1 << 19):
        hashes: list[int] = []
        sizes = []
        for x in texts[begin:end]:
            grams = shingles_of(words_of(x), shingle)
            hashes += [digest(g, SEED) for g in grams]
            sizes.append(len(grams))
        if not hashes:
            continue
        n = np.array(sizes)
        full = np.flatnonzero(n)
        out[begin + full] = majority(np.split(np.array(hashes, np.uint64), np.cumsum(n[full])[:-1]))
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array(fingerprints(b.column(1).to_pylist(), shingle).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), f], names=["doc_id", "f"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, f long")


def distance(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def halves(points: np.ndarray, random: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that parts the points best, or None if they can't be parted."""
    best = None
    for v in random.choice(points, min(3, len(points)), replace=False):
        d = distance(points, v)
        r = int(np.median(d))
        if (d <= r).all():
            r -= 1
        near = np.abs(d - r) <= 3
        if (inside := int((d <= r).sum())) and inside < len(points) and (best is None or near.mean() < best[0]):
            best = near.mean(), v, r
    return best and best[1:]


def fit_tree(sample: np.ndarray, depth: int, random: np.random.Generator, at: int = 1) -> dict[int, tuple[np.uint64, int]]:
    """The upper tree: node number -> vantage point, radius. Children of node n: 2n inside, 2n + 1 outside."""
    if depth == 0 or len(sample) < OF_SHARD // 2 or not (cut := halves(sample, random)):
        return {}
    inside = distance(sample, cut[0]) <= cut[1]
    return {at: cut} | fit_tree(sample[inside], depth - 1, random, 2 * at) | fit_tree(sample[~inside], depth - 1, random, 2 * at + 1)


def routes(points: np.ndarray, tree: dict, within: int, at: int = 1, index: np.ndarray | None = None, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, positions of the points that go there, and which of them it owns."""
    if index is None:
        index, own = np.arange(len(points)), np.ones(len(points), bool)
    if not len(index):
        return
    if at not in tree:
        yield at, index, own
        return
    vantage, radius = tree[at]
    d = distance(points[index], vantage)
    low, high = d <= radius + within, d > radius - within
    yield from routes(points, tree, within, 2 * at, index[low], own[low] & (d[low] <= radius))
    yield from routes(points, tree, within, 2 * at + 1, index[high], own[high] & (d[high] > radius))


class Links:
    """Joins positions, keeping one tree of links for each joined set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while not np.array_equal(up := p[r], r):
            r = up
        p[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def search(points: np.ndarray, own: np.ndarray, ask: np.ndarray, within: int, links: Links, random: np.random.Generator) -> None:
    """Joins each point of ask with the points of own (positions, both) within the distance."""
    if not len(own) or not len(ask):
        return
    cut = halves(points[own], random) if len(own) > LEAF else None
    if cut is None:
        for k in range(0, len(own), LEAF):
            some = own[k : k + LEAF]
            for j in range(0, len(ask), max(1, BLOCK // len(some))):
                other = ask[j : j + max(1, BLOCK // len(some))]
                x, y = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[other][None, :]) <= within)
                links.join(some[x], other[y])
        return
    vantage, radius = cut
    d, e = distance(points[own], vantage), distance(points[ask], vantage)
    search(points, own[d <= radius], ask[e <= radius + within], within, links, random)
    search(points, own[d > radius], ask[e > radius - within], within, links, random)


def shard_links(f: np.ndarray, own: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    points, links = f.view(np.uint64), Links(len(f))
    search(points, np.flatnonzero(own), np.arange(len(f)), within, links, np.random.default_rng(7))
    root = links.roots(np.arange(len(f)))
    joined = np.flatnonzero(root != np.arange(len(f)))
    return f[joined], f[root[joined]]


def near_links(prints: DataFrame, within: int = 3) -> DataFrame:
    """a, b: links that join all different fingerprints (column f) which chains of at most `within` bits connect."""
    spark = prints.sparkSession
    n = prints.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    tree: dict = {}
    if depth:
        spread = F.pmod(F.xxhash64("f"), F.lit(1 << 30)) / float(1 << 30)
        size = min(MOST_SAMPLE, max(LEAST_SAMPLE, OF_SHARD << depth))
        sample = np.sort(prints.where(spread < size / n).toArrow().column("f").to_numpy()).view(np.uint64)
        tree = fit_tree(sample, depth, np.random.default_rng(7))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for shard, index, own in routes(f.view(np.uint64), tree, within):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), shard), pa.int64()), pa.array(f[index]), pa.array(own)], names=["shard", "f", "own"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(group.f.to_numpy(), group.own.to_numpy(), within)
        return pd.DataFrame({"a": a, "b": b})

    if not depth:  # one shard: no tree fitted, the search below is the whole one
        dealt = prints.select(F.lit(1).cast("long").alias("shard"), "f", F.lit(True).alias("own"))
    else:
        dealt = prints.select("f").mapInArrow(deal, "shard long, f long, own boolean")
    return dealt.groupBy("shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, within: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of docs.

    component_id is the least id among the rows whose fingerprints chains of at most `within` differing bits connect,
    the row itself included. Null, empty and blank texts have fingerprint zero, which links like any other. Repeated
    rows each get their row. A row with a null id gets its component's least id, null if it has none. Other columns
    are not read; an empty table gives an empty result.
    """
    rows = stored(with_fingerprints(docs, id_col, text_col, shingle))
    prints = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(prints, within), "a", "b")
    classes = prints.join(roots, prints.f == roots.node, "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(classes.join(named, "root").select("f", "component_id"))
    return rows.join(of, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words (of fewer the whole sequence's, of none nothing), from the words' hashes."""
    width = min(width, len(ids))
    out = ids[: len(ids) - width + 1].copy() if width else ids
    for i in range(1, width):
        out = mixed(out * np.uint64(FACTOR) + ids[i : len(ids) - width + 1 + i])
    return out


def majority(parts: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each sequence of shingle hashes, none of them empty."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    bits = np.unpackbits(np.concatenate(parts).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
    return np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1)


def shingle_sets(texts: list[str], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Position and different shingles, as sorted hashes, of each text that has a word."""
    for begin, end in slices([len(x) for x in texts], 1 << 19):
        known: dict[bytes, int] = {}
        for i in range(begin, end):
            if words := words_of(texts[i]):
                known.update((w, xxhash.xxh64_intdigest(w, SEED)) for w in set(words).difference(known))
                yield i, np.unique(rolled(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), shingle))


def frequent_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that some FREQUENT documents or more hold, by a sample, the rarest first. They only set an order,
    in which the others come first, so what the sample misses costs time and no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_model()
        for b in batches:
            for _, once in shingle_sets(b.column(0).to_pylist(), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], names=["f"])
        tidy()

    share = min(1.0, max(SAMPLED, LEAST_SAMPLED / max(1, rows.count())))
    some = rows.where(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    counts = some.select("text").mapInArrow(run, "f long").groupBy("f").agg(F.count("*").alias("m")).where(F.col("m") >= max(4, FREQUENT * share))
    most = counts.orderBy(F.desc("m"), "f").limit(MOST_FREQUENT).toArrow()
    return most.column("f").to_numpy().view(np.uint64)[::-1]


def with_prefixes(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """h (the key's hash), n (different shingles of the document) and f: its first shingles, in an order that all documents
    share, as many as must hold one in common with any text that is similar enough."""
    spark = rows.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_model()
        by_hash = np.argsort(frequent.value)
        hashes = frequent.value[by_hash]
        for b in batches:
            of, sizes, parts = [], [], []
            for i, once in shingle_sets(b.column(1).to_pylist(), shingle):
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, once), len(hashes) - 1)
                    last = hashes[at] == once
                    ordered = np.concatenate([once[~last], once[last][np.argsort(by_hash[at[last]])]])
                else:
                    ordered = once
                parts.append(ordered[: len(once) - met_elsewhere(len(once), similarity)])
                of.append(i)
                sizes.append(len(once))
            if parts:
                n = list(map(len, parts))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(of, n))), pa.array(np.repeat(sizes, n), pa.int32()), pa.array(np.concatenate(parts).view(np.int64))], names=["h", "n", "f"])
        tidy()

    return rows.select(F.xxhash64("k").alias("h"), "text").mapInArrow(run, "h long, n int, f long")


def met_elsewhere(n: int, similarity: float) -> int:
    """Shingles behind the prefix of a set of n: one fewer than it must share with a set to be that similar."""
    return max(0, math.ceil(similarity * n - 1e-9) - 1)


def enough(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that the prefixes of similar sets of n and m have in common, at least. Up to the lesser of both prefixes'
    ends they share all that they share there, and behind it no more than one of the sets still has."""
    behind = F.greatest(F.lit(0), F.ceil(similarity * F.greatest(n, m) - 1e-9) - 1)
    return F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9) - behind)


def similar(pairs: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b: keys of those pairs (a, b: hashes of keys) whose texts share that much of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = (set(shingles_of(words_of(v.as_py()), shingle)) for v in (x, y))
                both = len(s & t)
                near.append(both > 0 and both >= similarity * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ends = stored(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    texts = stored(joined_ids(rows.select(F.xxhash64("k").alias("h"), "k", "text"), ends, "h", "left_semi"))
    left, right = texts.select(F.col("h").alias("a"), F.col("k").alias("ka"), F.col("text").alias("x")), texts.select(F.col("h").alias("b"), F.col("k").alias("kb"), F.col("text").alias("y"))
    kind = rows.schema["k"].dataType.simpleString()
    met = pairs.join(left, "a").join(right, "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "x", "y")
    return met.mapInArrow(run, f"a {kind}, b {kind}")


def apart_pairs(rooted: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of documents of different groups (rooted: f, h, n, first, root) that may be similar by what their
    prefixes share. Of each f the group of its first document is met by the members of the others only."""
    held = rooted.groupBy("f").agg(F.count("*").alias("m"), F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.when(F.col("h") == F.col("first"), F.col("root"))).alias("main"))
    mixed = stored(rooted.select("f", "h", "n", "root").join(held.where("least < most").select("f", "m", "main"), "f"))
    # a frequent f is dealt in blocks: every block of the others meets every block of all
    blocks = F.ceil(F.col("m") / MEMBERS).cast("int")
    own, other = F.pmod(F.xxhash64("h"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    asks = mixed.where("root <> main").select("f", F.col("h").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "main", own.alias("i"), other.alias("j"))
    told = mixed.select("f", F.col("h").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), own.alias("j"), other.alias("i"))
    near = F.least("na", "nb") >= similarity * F.greatest("na", "nb")
    once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))
    met = asks.join(told, ["f", "i", "j"]).where((F.col("ra") != F.col("rb")) & once & near)
    sides = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"))
    return sides.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= enough(F.col("na"), F.col("nb"), similarity)).select("a", "b")


def similar_links(rows: DataFrame, similarity: float = 0.8, shingle: int = 5, known: DataFrame | None = None) -> DataFrame:
    """a, b: links between keys of different documents (columns k and text, each text once) whose sets of shingles have that
    Jaccard similarity, verified, that join all such documents, with the known links (a, b: keys), if any are given.

    Two sets of that similarity share a shingle of their prefixes (see `with_prefixes`), and so many of them
    (`enough`). A first round compares each document with the first one of those that hold the same shingle, which joins
    large groups by as many links as they have members. A second one compares all pairs that the links so far have not
    joined. So no similar pair stays in different groups, and pairs of one group need not be links themselves.
    """
    parts = stored(with_prefixes(rows, similarity, shingle))
    met = stored(parts.groupBy("f").agg(F.count("*").alias("m"), F.min("h").alias("first")).where("m > 1").select("f", "first"))
    shared = stored(parts.join(met, "f"))
    forget(parts)
    behind = F.greatest(F.lit(0), F.ceil(similarity * F.col("n") - 1e-9) - 1)
    heads = shared.where("h <> first").groupBy("h", "n", "first").agg(F.count("*").alias("c"))
    # a document may share other shingles with its first one; what is left out here is met in the second round
    pairs = stored(heads.where(3 * F.col("c") >= F.col("n") - behind).select(F.col("first").alias("a"), F.col("h").alias("b")))
    links = stored(similar(pairs, rows, similarity, shingle))
    joined = links if known is None else links.union(known.select("a", "b"))
    roots = stored(components(joined.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), "a", "b").withColumnRenamed("node", "h"))
    rooted = joined_ids(shared, roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    more = similar(stored(apart_pairs(rooted, similarity)), rows, similarity, shingle)
    return links.union(more)


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, within: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k: keys (see `document_key`) of all documents but the least of each group of near copies.

    Links are those of `near_duplicates` and those of `similar_links`; a group is what chains of links connect. Null,
    empty and blank texts are one group. An id with different texts is as many documents; repeated rows are one, named
    at most once. An empty table gives an empty result.
    """
    rows = docs.select(document_key(F.col(id_col), F.col(text_col)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    groups = near_duplicates(rows, within, id_col="k").where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    once = stored(rows.groupBy("k.digest").agg(F.min("k").alias("k")).select("k"))
    different = joined_ids(rows, once, "k", "left_semi").where("trim(translate(text, '\\n\\t\\r', '   ')) <> ''")
    groups = stored(groups)
    links = stored(groups.union(similar_links(different, similarity, shingle, groups)))
    return components(links, "a", "b").where("node <> root").select(F.col("node").alias("k")).distinct()


def document_key(id_col: Column, text_col: Column) -> Column:
    """What tells documents apart and orders them: ids before none, the least id first, then a digest of the text."""
    return F.struct(id_col.isNull().alias("none"), id_col.alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"))
