"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Items become windows of `size` consecutive words (one shorter window for a shorter item). Containment of a window is
all or nothing, so its necessary prefix in rarity order is one word: its rarest in the documents. Document words are
joined to windows on that word; position and length bounds drop what would stick out of the document, and the words
around the position are compared with the whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_IDS, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which they are broadcast (of `size` words each); beyond it the same join shuffles.
BROADCAST_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAP), "")


def item_windows(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """win (the words), items (ids as strings) of each different window."""
    read = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    cuts = F.when(F.size("w") <= size, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size)))
    rows = read.where(F.size("w") > 0).select("item", F.explode(cuts).alias("win"))
    return rows.groupBy("win").agg(F.collect_set("item").alias("items"))


def rarest_words(docs: DataFrame, windows: DataFrame, text_col: str, small: bool) -> DataFrame:
    """Windows with the word they are joined on and its place; windows with a word that no document has are gone."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    seen = docs.select(F.explode_outer(words_of(F.col(text_col))).alias("word"))
    if small:
        seen = seen.join(F.broadcast(vocabulary), "word")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("win", "items", F.posexplode("win").alias("place", "word")).join(counts, "word", "left")
    best = placed.groupBy("win").agg(F.first("items").alias("items"), F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("word", "place"), F.struct("n", "word", "place")).alias("key"))
    return best.where("least > 0").select("win", "items", F.col("key.word").alias("word"), F.col("key.place").alias("place"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Null and empty texts have no words and no hits. Rows are told apart by id and text, so ids may repeat or be null;
    equal rows get equal results. Items with a null id or without words are left out; an item that stands twice
    counts once. An empty item table leaves every document clean, an empty table of documents gives no rows. Of equally
    rare words of a window the alphabetically first, then its first place, is joined on, which changes no result. Very
    long texts are split into words as they are; beyond BROADCAST_WINDOWS only stretches around chosen words travel. No
    other columns are read.
    """
    windows = stored(item_windows(items, size, item_col, item_text_col))
    small = windows.count() <= BROADCAST_WINDOWS
    keyed = stored(rarest_words(docs, windows, text_col, small))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("w"))
    near = rows.select("doc_id", "key", "w", F.posexplode_outer("w").alias("at", "word"))
    if not small:  # only the places of chosen words travel, each with the words that a window can reach
        chosen = stored(keyed.select("word").distinct())
        if chosen.count() <= BROADCAST_IDS:
            near = near.join(F.broadcast(chosen), "word", "left_semi")
        near = near.select("doc_id", "key", "word", F.least("at", F.lit(size - 1)).alias("at"), F.slice("w", F.greatest(F.col("at") - size + 2, F.lit(1)), 2 * size - 1).alias("w"), F.greatest(F.col("at") - size + 1, F.lit(0)).alias("before"))
    else:
        near = near.withColumn("before", F.lit(0))
    begin, length = F.col("at") - F.col("place"), F.size("win")
    fits = (begin >= 0) & (begin + length <= F.size("w"))
    found = near.join(F.broadcast(keyed) if small else keyed, "word").where(fits).where(F.slice("w", F.greatest(begin + 1, F.lit(1)), length) == F.col("win"))
    hits = found.select("doc_id", "key", (F.col("before") + begin).alias("begin"), (F.col("before") + begin + length).alias("end"), "items")
    spans = hits.groupBy("doc_id", "key", "begin").agg(F.max("end").alias("end"), F.flatten(F.collect_set("items")).alias("items"))
    earlier = W.partitionBy("doc_id", "key").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(earlier), F.lit(0))))
    per_doc = spans.withColumn("fresh", fresh).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    whole = rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    same = whole.doc_id.eqNullSafe(per_doc.doc_id) & (whole.key == per_doc.key)
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return whole.join(per_doc, same, "left").select(whole.doc_id, "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
cut AS (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS phrase, len(w[i:i + 9]) AS n FROM cut),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT spot.doc_id, spot.i, win.n, win.item FROM spot CROSS JOIN sizes s JOIN win ON win.n = s.n AND array_to_string(spot.w[spot.i:spot.i + s.n - 1], ' ') = win.phrase WHERE spot.i + s.n - 1 <= len(spot.w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
