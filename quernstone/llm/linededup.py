"""Line deduplication by a suffix array over line ids, in DataFrame functions only.

Prefix doubling: at order k every suffix of a document's line sequence has the rank of its first 2^k lines. Ranks of
order k + 1 are those of the pairs (rank here, rank 2^k lines on), numbered in sorted order by a range-partitioned
sort. A suffix whose first 2^k lines stand nowhere else leaves: only the longest-common-prefix intervals of length
2^k and more go on, so each order is smaller than the last and the work ends with the longest repeated run. Suffixes
of one interval but its first are later copies; the lines that later copies cover are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: A repeated run counts if it has so many lines, or so many characters.
MIN_LINES, MIN_CHARS = 3, 100
ROW = ("doc", "key")
#: Documents with deletions, and deleted lines, up to which the deletions are broadcast to the texts (some 20 MB);
#: beyond either the texts are shuffled to them.
BROADCAST_DOCS, BROADCAST_LINES = 200_000, 2_000_000


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key, raw (line number), at (number among the lines with text), a, b (the line's identity, 96 bits), chars."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("raw")))
    full = F.filter(lines, lambda x: x.line != "")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.posexplode_outer(full).alias("at", "x")).where("x is not null")
    return rows.select(*ROW, "x.raw", "at", F.xxhash64("x.line").alias("a"), F.hash("x.line").alias("b"), F.length("x.line").cast("long").alias("chars")).dropDuplicates([*ROW, "at"])


def ranked(suffixes: DataFrame, by: tuple[str, str], most_rows: int | None) -> DataFrame:
    """The repeated values of `by`, with their rank in sorted order and the place of their first suffix."""
    groups = suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "at")).alias("first")).where("n > 1")
    return stored(groups.orderBy(*by).select(*[F.col(c).alias(f"by_{c}") for c in by], "first", F.monotonically_increasing_id().alias("_rank")), most_rows)


def next_order(suffixes: DataFrame, by: tuple[str, str], most_rows: int | None = None) -> DataFrame:
    ranks = ranked(suffixes, by, most_rows)
    here = F.struct(*ROW, "at")
    found = suffixes.join(ranks, (F.col(by[0]) == ranks[f"by_{by[0]}"]) & (F.col(by[1]) == ranks[f"by_{by[1]}"]))
    return stored(found.select(*ROW, "raw", "at", F.col("_rank").alias("rank"), "chars", (here > F.col("first")).alias("later")), most_rows)


def pairs_ahead(order: DataFrame, step: int) -> DataFrame:
    """Each suffix with the rank (then) of the one `step` lines on, where that has one; chars are those of both."""
    ahead = W.partitionBy(*ROW).orderBy("at").rangeBetween(step, step)
    pairs = order.select(*ROW, "raw", "at", "rank", F.first("rank").over(ahead).alias("then"), (F.col("chars") + F.first("chars").over(ahead)).alias("chars"))
    return pairs.where("then is not null")


def suffix_orders(docs: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """For k = 0, 1, ... the suffixes whose first 2^k lines stand elsewhere too: doc, key, raw, at, rank, chars (of
    those lines) and whether an earlier suffix has them."""
    orders = [next_order(line_table(docs, id_col, text_col), ("a", "b"))]
    while n := orders[-1].count():  # each order is smaller than the last
        orders.append(next_order(pairs_ahead(orders[-1], 1 << (len(orders) - 1)), ("rank", "then"), n))
    return orders[:-1]


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, key, gone: the line numbers that later copies of repeated runs cover, per document that has some."""
    orders = suffix_orders(docs, id_col, text_col)
    if not orders:
        orders = [next_order(line_table(docs, id_col, text_col), ("a", "b"))]
    runs = [(1 << k, x) for k, x in enumerate(orders)]
    k = min_lines.bit_length() - 1
    if 1 << k < min_lines and k < len(orders):  # two overlapping runs of 2^k lines name one of min_lines
        runs.append((min_lines, next_order(pairs_ahead(orders[k], min_lines - (1 << k)), ("rank", "then"), orders[k].count())))
    cover = orders[0].select(*ROW, "at", "raw", F.lit(0).alias("end"))
    for n, x in runs:
        counts = x.where(F.col("later") & ((F.lit(n) >= min_lines) | (F.col("chars") >= min_chars)))
        cover = cover.union(counts.select(*ROW, "at", "raw", (F.col("at") + n).alias("end")))
    ends = cover.groupBy(*ROW, "at").agg(F.min("raw").alias("raw"), F.max("end").alias("end"))
    reached = F.max("end").over(W.partitionBy(*ROW).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    gone = ends.withColumn("reached", reached).where("reached > at")
    return gone.groupBy(*ROW).agg(F.array_sort(F.collect_list("raw")).alias("gone"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row and column of docs, and three more: line_text (the text without later copies of repeated line runs),
    n_lines, lines_gone (numbers of the deleted lines, from 0).

    A run counts from min_lines lines on, and, if it has 1, 2, 4, ... lines, from min_chars characters on; lines are
    compared without surrounding blanks, and blank lines neither break runs nor go. Copies are ordered by id
    (null first), then by a hash of the text, then by line. Rows with the same id and text are one document and get the same result. Null texts stay null, with no
    lines. Very long texts are rows of lines like any other; an empty table gives no rows. Columns of docs named as the new
    ones are replaced.
    """
    found = stored(repeated_lines(docs, min_lines, min_chars, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("gone").alias("__gone")))
    size = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("__gone")), F.lit(0)).alias("lines")).first()
    if size.docs <= BROADCAST_DOCS and size.lines <= BROADCAST_LINES:
        found = F.broadcast(found)
    own = F.struct(*[F.col(c) for c in docs.columns if c not in ("line_text", "n_lines", "lines_gone")])  # so that no name clashes
    base = docs.select(own.alias("own"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("of"))
    joined = base.join(found, F.col("id").eqNullSafe(F.col("__doc")) & (F.col("of") == F.col("__key")), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    return joined.select("own.*", text.alias("line_text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), gone.alias("lines_gone"))


ORACLE = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, n, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos FROM raw WHERE trim(line, ' ') <> ''),
docs AS (SELECT doc_id, list(line ORDER BY pos) AS w FROM lines GROUP BY doc_id),
wins AS (SELECT doc_id, pos, k, w[pos + 1:pos + k] AS win FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM docs, (SELECT unnest([1, 2, {MIN_LINES}, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS k) WHERE len(w) >= k)),
firsts AS (SELECT doc_id, pos, k, list_sum(list_transform(win, lambda x: length(x))) AS chars, min((doc_id, pos)) OVER (PARTITION BY k, win) AS first FROM wins),
covers AS (SELECT doc_id, pos, k FROM firsts WHERE (doc_id, pos) > first AND (k >= {MIN_LINES} OR chars >= {MIN_CHARS})),
gone AS (SELECT DISTINCT l.doc_id, l.n FROM lines l JOIN covers c ON c.doc_id = l.doc_id AND l.pos >= c.pos AND l.pos < c.pos + c.k),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.n) AS text FROM raw r ANTI JOIN gone g ON g.doc_id = r.doc_id AND g.n = r.n GROUP BY r.doc_id),
sums AS (SELECT doc_id, count(*) AS n_lines FROM raw GROUP BY doc_id),
went AS (SELECT doc_id, count(*) AS n_gone, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS lines_gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, coalesce(lines_gone, '') AS lines_gone,
  sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END) AS text_sha256
FROM documents d LEFT JOIN sums USING (doc_id) LEFT JOIN went USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
