"""Merkle manifest of a dataset: every row is a leaf, every group a tree, the groups' roots one more tree.

Leaves are ordered by (group, key) in range partitions. Each partition runs through its stretch of a group as a
mountain range: a stack in base `FANOUT`, in which a full run of nodes is hashed and carried one level up. Runs that
began in an earlier partition can't be completed there; their nodes leave the stack as peaks. Peaks are few (some for
each level and end of a stretch) and are merged apart, in blocks of FANOUT**BLOCK_LEVELS leaves and then by group. The
last run of a level is hashed as short as it is, without padding. For the proofs each partition gets back the nodes
beside its stretch and runs over its leaves once more; neither texts nor leaves of two partitions ever meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

FANOUT = 3
#: Leaves of a range partition, about; one partition is in a task's memory (some 200 bytes a leaf).
PART_ROWS = 1 << 15
#: Peaks are merged in blocks of so many levels; a source of 10^12 leaves has some 600,000 such blocks.
BLOCK_LEVELS = 13


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sizes(total: int) -> list[int]:
    """Nodes of each level of a tree, up to the level that has one."""
    found = [total]
    while found[-1] > 1:
        found.append(-(-found[-1] // FANOUT))
    return found


class Mountains:
    """The nodes that one stretch of a tree's leaves completes. nodes[level] holds consecutive ones from first[level]
    on; peaks are those whose parent needs leaves from outside."""

    def __init__(self, begin: int, total: int, leaves: Iterable[str]) -> None:
        self.sizes = sizes(total)
        self.first: list[int | None] = [None] * len(self.sizes)
        self.nodes: list[list[str]] = [[] for _ in self.sizes]
        self.peaks: list[tuple[int, int, str]] = []
        waiting: list[list[tuple[int, str]]] = [[] for _ in self.sizes]
        for i, leaf in enumerate(leaves, begin):
            level, node = 0, leaf
            while True:
                if self.first[level] is None:
                    self.first[level] = i
                self.nodes[level].append(node)
                run = waiting[level]
                run.append((i, node))
                last = i + 1 == self.sizes[level]
                if len(self.sizes) == level + 1 or not (last or i % FANOUT == FANOUT - 1):
                    break
                if run[0][0] % FANOUT:  # the run's beginning is in an earlier partition
                    self.peaks += [(level, *x) for x in run]
                    run.clear()
                    break
                node = digest(x for _, x in run)
                run.clear()
                level, i = level + 1, i // FANOUT
        self.peaks += [(level, *x) for level, run in enumerate(waiting) for x in run]

    def held(self, level: int) -> range:
        first = self.first[level]
        return range(0) if first is None else range(first, first + len(self.nodes[level]))

    def outside(self, begin: int, n: int) -> Iterator[tuple[int, int]]:
        """(level, index) of the nodes that proofs of the leaves begin .. begin + n - 1 need and that aren't here."""
        for level, size in enumerate(self.sizes[:-1]):
            low, high = begin // FANOUT * FANOUT, min((begin + n - 1) // FANOUT * FANOUT + FANOUT, size)
            held = self.held(level)
            if not held:
                yield from ((level, i) for i in range(low, high))
            else:
                yield from ((level, i) for i in range(low, min(held.start, high)))
                yield from ((level, i) for i in range(max(held.stop, low), high))
            n = (begin + n - 1) // FANOUT - begin // FANOUT + 1
            begin //= FANOUT


def merged(peaks: Iterable[tuple[int, int, str]], total: int, top: int) -> list[tuple[int, int, str]]:
    """The nodes up to level `top` that are made of the given ones."""
    size, known, made = sizes(total), {(level, i): x for level, i, x in peaks}, []
    for level in range(min(top, len(size) - 1)):
        for parent in sorted({i // FANOUT for at, i in known if at == level}):
            if (level + 1, parent) not in known:
                run = range(parent * FANOUT, min(parent * FANOUT + FANOUT, size[level]))
                known[level + 1, parent] = digest(known[level, i] for i in run)
                made.append((level + 1, parent, known[level + 1, parent]))
    return made


#: A leaf's way up: at each level the place in its run, and the run's other nodes.
Step = tuple[int, list[str]]


def ways(stretch: Mountains, begin: int, n: int, beside: dict[tuple[int, int], str]) -> Iterator[list[Step]]:
    """The way up of each leaf. Parts that neighbours share are built once."""

    def node(level: int, i: int) -> str:
        held = stretch.held(level)
        return stretch.nodes[level][i - held.start] if i in held else beside[level, i]

    above: dict[int, tuple[int, list[Step]]] = {}

    def way(level: int, i: int) -> list[Step]:
        if level == len(stretch.sizes) - 1:
            return []
        run = range(i // FANOUT * FANOUT, min(i // FANOUT * FANOUT + FANOUT, stretch.sizes[level]))
        parent = i // FANOUT
        if above.get(level, (-1, []))[0] != parent:
            above[level] = (parent, way(level + 1, parent))
        return [(i - run.start, [node(level, j) for j in run if j != i]), *above[level][1]]

    for i in range(begin, begin + n):
        yield way(0, i)


def folded(leaf: str, way: list[Step]) -> str:
    for place, others in way:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def _rows(t: pa.Table) -> list[dict]:
    return t.to_pylist()


class Forest:
    """Trees over rows (g: the tree, k: the order in it, leaf, other: a leaf to be held against the tree, or null)."""

    def __init__(self, rows: DataFrame) -> None:
        leaves = stored(rows.select("g", "k", "leaf", "other"))
        self.kind, self.key_kind = (leaves.schema[c].dataType.simpleString() for c in ("g", "k"))
        order = [F.asc_nulls_first("g"), F.asc_nulls_first("k"), F.asc("leaf")]
        parts = 1 + leaves.count() // PART_ROWS
        number = F.monotonically_increasing_id()
        placed = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed = placed.select(F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "*")
        self.leaves = stored(placed)  # the partition and the place in it hold from here on
        ahead = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        counted = self.leaves.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        self.stretches = stored(counted.select("*", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"), F.sum("n").over(W.partitionBy("g")).alias("total")))
        self.records = stored(self._records(False))
        self.nodes = stored(self._merged())
        self.roots = self.nodes.where("top").select("g", F.col("digest").alias("leaf"))

    def _records(self, every: bool) -> DataFrame:
        """part, g, level, idx, digest (null: wanted for the partition's proofs), total, top; `every`: all nodes."""
        names = ["part", "g", "level", "idx", "digest", "total", "top"]
        schema = pa.schema([("part", pa.int64()), ("g", _arrow(self.stretches, "g")), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("total", pa.int64()), ("top", pa.bool_())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            leaf, out = left.sort_by("at").column("leaf").to_pylist(), []
            for s in _rows(right):
                found = Mountains(s["begin"], s["total"], leaf[s["first"] : s["first"] + s["n"]])
                own = (s["part"], s["g"])
                if every:
                    out += [(*own, level, i, x, s["total"], found.sizes[level] == 1) for level, held in enumerate(found.nodes) for i, x in zip(found.held(level), held)]
                else:
                    out += [(*own, *x, s["total"], found.sizes[x[0]] == 1) for x in found.peaks]
                    out += [(*own, *x, None, s["total"], False) for x in found.outside(s["begin"], s["n"])]
            return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(names), schema)], schema=schema)

        return self.leaves.groupBy("part").cogroup(self.stretches.groupBy("part")).applyInArrow(run, f"part long, g {self.kind}, level int, idx long, digest string, total long, top boolean")

    def _merged(self) -> DataFrame:
        """g, level, idx, digest, top: the peaks, and what they make together."""
        out = f"g {self.kind}, level int, idx long, digest string, total long, top boolean"
        schema = pa.schema([("g", _arrow(self.stretches, "g")), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("total", pa.int64()), ("top", pa.bool_())])

        def up_to(level: int | None):
            def run(t: pa.Table) -> pa.Table:
                rows = _rows(t)
                total = rows[0]["total"]
                size = sizes(total)
                made = merged([(r["level"], r["idx"], r["digest"]) for r in rows], total, len(size) if level is None else level)
                made = [(rows[0]["g"], *x, total, size[x[0]] == 1) for x in made]
                return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made) if made else [[]] * len(schema), schema)], schema=schema)

            return run

        peaks = self.records.where("digest IS NOT NULL").drop("part")
        block = F.floor(F.col("idx") / F.pow(F.lit(float(FANOUT)), F.lit(BLOCK_LEVELS) - F.col("level")))
        low = peaks.where(f"NOT top AND level < {BLOCK_LEVELS}").withColumn("block", block)
        low = stored(low.groupBy("g", "block").applyInArrow(up_to(BLOCK_LEVELS), out))
        high = peaks.union(low).where(f"NOT top AND level >= {BLOCK_LEVELS}").groupBy("g").applyInArrow(up_to(None), out)
        return peaks.union(low).union(high).drop("total")

    def every_node(self) -> DataFrame:
        """g, level (0: leaves), idx, digest of all nodes of all trees."""
        own = self._records(True).select("g", "level", "idx", "digest")
        return own.union(self.nodes.select("g", "level", "idx", "digest")).distinct()

    def beside(self) -> DataFrame:
        """part, g, nodes: for each stretch the nodes that its proofs need from elsewhere."""
        want = self.records.where("digest IS NULL").select("part", F.col("g").alias("of"), F.col("level").alias("l"), F.col("idx").alias("i"))
        known = self.nodes.select("g", "level", "idx", "digest")
        found = want.join(known, F.col("of").eqNullSafe(F.col("g")) & (F.col("l") == F.col("level")) & (F.col("i") == F.col("idx")))
        return found.groupBy("part", "of").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("nodes"))

    def proofs(self, upper: DataFrame | None) -> DataFrame:
        """With `upper` (g, way, subroot, root): k, leaf, subroot, root, proof_sha256, folded_root. Without: g (here the
        row's k), way, subroot (its leaf), root of the one tree."""
        beside = self.beside().withColumnRenamed("part", "p")
        right = self.stretches.join(beside, (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("of")), "left").drop("p", "of")
        if upper is not None:
            up = upper.withColumnRenamed("g", "of")
            right = right.join(up, F.col("g").eqNullSafe(F.col("of"))).drop("of")
        last = upper is not None
        step = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
        k = _arrow(self.leaves, "k")
        if last:
            schema = pa.schema([("k", k), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])
            out = f"k {self.key_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        else:
            schema = pa.schema([("g", k), ("way", step), ("subroot", pa.string()), ("root", pa.string())])
            out = f"g {self.key_kind}, way array<struct<place:int,others:array<string>>>, subroot string, root string"

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("at")
            leaf, other = left.column("leaf").to_pylist(), left.column("other").to_pylist()
            rows: list[tuple] = [()] * len(leaf)
            for s in _rows(right):
                at, n = s["first"], s["n"]
                stretch = Mountains(s["begin"], s["total"], leaf[at : at + n])
                known = {(x["level"], x["idx"]): x["digest"] for x in s["nodes"] or []}
                more = [(x["place"], x["others"]) for x in s["way"]] if last else []
                for i, way in enumerate(ways(stretch, s["begin"], n, known), at):
                    if last:
                        way = way + more
                        rows[i] = (leaf[i], s["subroot"], s["root"], digest(x for _, others in way for x in others), folded(leaf[i] if other[i] is None else other[i], way))
                    else:
                        rows[i] = ([{"place": p, "others": o} for p, o in way], leaf[i], folded(leaf[i], way))
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * (len(schema) - 1), list(schema)[1:])]
            return pa.Table.from_arrays([left.column("k").combine_chunks().cast(k), *arrays], schema=schema)

        return self.leaves.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, out)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def field(column: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", checked: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    A leaf is the SHA-256 of the row's `columns`; `checked` gives, by column, what is held against the manifest (a
    later copy of the table, say), and `verified` tells whether the row's proof leads from that leaf to the root.

    Nulls are values of their own (`-`) and sort first, as ids and as groups. Rows of one group and id are ordered by
    their leaf, so that repeated rows have proofs of their own and the root doesn't depend on the order of the input.
    An empty text is `0:`; very long texts are hashed where they are read and never shuffled. An empty table gives no
    rows. Other columns are not read.
    """
    changed = [(checked or {}).get(c, F.col(c)) for c in columns]
    leaf, other = leaf_of(*map(F.col, columns)), leaf_of(*changed) if checked else F.lit(None).cast("string")
    rows = docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("k"), leaf.alias("leaf"), F.nullif(other, leaf).alias("other"))
    groups = Forest(rows)
    tops = Forest(groups.roots.select(F.lit(0).alias("g"), F.col("g").alias("k"), "leaf", F.lit(None).cast("string").alias("other")))
    found = groups.proofs(stored(tops.proofs(None)))
    return found.select(F.col("k").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_nodes(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """g, level, idx, digest: all nodes of the groups' trees, leaves included, to be kept beside the dataset."""
    rows = docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("k"), leaf_of(*map(F.col, columns)).alias("leaf"), F.lit(None).cast("string").alias("other"))
    return Forest(rows).every_node()


def _oracle(levels: int) -> str:
    """The manifest of documents in DuckDB SQL, for groups of at most FANOUT**levels rows."""
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_concat([xor(a, c)], {[0] * 8}), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(rows: str, name: str) -> str:
        """CTEs {name}0 .. {name}{levels} of nodes (g, i, h, n) and {name}s0 .. of what stands before and behind a node in its run."""
        parts = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {rows})"]
        for k in range(levels):
            run = f"OVER (PARTITION BY g, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            side = lambda frame: f"CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') {run} {frame}), '') END"  # noqa: B023, E731
            parts.append(f"{name}s{k} AS (SELECT g, i, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // {FANOUT} AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // {FANOUT}))")
        return ",\n".join(parts)

    def climb(begin: str, name: str, prefix: str) -> str:
        """CTEs {prefix}0 .. {prefix}{levels}: rows (key, g, i, f: folded so far, p: siblings so far)."""
        parts = [f"{prefix}0 AS ({begin})"]
        for k in range(levels):
            parts.append(f"{prefix}{k + 1} AS (SELECT key, a.g, a.i // {FANOUT} AS i, CASE WHEN s.n = 1 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p FROM {prefix}{k} a JOIN {name}s{k} s ON a.g IS NOT DISTINCT FROM s.g AND a.i = s.i)")
        return ",\n".join(parts)

    return f"""WITH d AS (SELECT doc_id, source AS g, {leaf('text')} AS h, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS f FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, row_number() OVER (ORDER BY g NULLS FIRST, doc_id NULLS FIRST, h) AS key FROM d),
{tree("o", "t")},
subs AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM t{levels}),
{tree("subs", "u")},
{climb("SELECT key, g, i, f, '' AS p FROM o", "t", "a")},
{climb(f"SELECT key, 0 AS g, s.i, f, p FROM a{levels} x JOIN subs s ON x.g IS NOT DISTINCT FROM s.source", "u", "b")}
SELECT o.doc_id, o.h AS leaf, s.h AS subroot, u.h AS root, sha256(b.p) AS proof_sha256, b.f AS folded_root, b.f = u.h AS verified
FROM o JOIN b{levels} b USING (key) JOIN subs s ON o.g IS NOT DISTINCT FROM s.source CROSS JOIN u{levels} u"""


ORACLE = _oracle(8)
