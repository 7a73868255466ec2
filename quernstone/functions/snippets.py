"""The passage of a text that answers a query best, from the places of its hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a passage, and of it before the hit that it is cut around.
MOST, LEAD = 200, 40
LETTER = r"[\p{L}\p{N}_]"
MASK = "‹[^›]*›"


def word_pattern(term: str) -> str:
    """Words that match a term: equal, or one begins with the other where that has four letters or more."""
    t = re.escape(term)
    shorter = [re.escape(term[:n]) for n in range(len(term) - 1, 3, -1)]
    return "|".join([t + LETTER + "*", *shorter]) if len(term) >= 4 else t


def hits(text: Column, terms: list[str]) -> Column:
    """begin, end (characters, from 0) and term (its number) of each word that matches one; the longest term counts.
    Words inside a mask are none."""
    order = sorted(range(len(terms)), key=lambda i: (-len(terms[i]), terms[i]))
    whole = rf"(?iu){MASK}|(?<!{LETTER})(?:{'|'.join(f'(?:{word_pattern(terms[i])})' for i in order)})(?!{LETTER})"
    which = lambda w: F.coalesce(*[F.when(w.rlike(f"(?iu)^(?:{word_pattern(terms[i])})$"), i) for i in order])
    found = F.arrays_zip(F.split(text, whole).alias("gap"), F.regexp_extract_all(text, F.lit(whole), F.lit(0)).alias("word"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,word:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + F.char_length(x.gap)
        end = begin + F.coalesce(F.char_length(x.word), F.lit(0))
        return F.struct(end.alias("at"), F.when(x.word.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(F.struct(begin.alias("begin"), end.alias("end"), x.word.alias("word"))))).alias("out"))

    placed = F.transform(F.aggregate(found, start, step).out, lambda h: F.struct(h.begin.alias("begin"), h.end.alias("end"), which(h.word).alias("term")))
    return F.filter(placed, lambda h: h.term.isNotNull())


def passage(text: Column, at: Column, most: int = MOST) -> Column:
    """Up to `most` characters around a place, cut at whole words and outside of masks."""
    n = F.char_length(text)
    low = F.greatest(F.lit(0), F.least(at - LEAD, n - most))
    # with the characters before and behind, which tell whether a word is cut
    piece = F.substring(text, F.greatest(low, F.lit(1)), F.lit(most) + F.when(low > 0, 2).otherwise(1))
    front = F.when(low > 0, F.regexp_replace(piece, rf"^(?:{LETTER}+|(?s:.))", "")).otherwise(piece)
    behind = low + most < n
    back = F.when(behind, F.regexp_replace(front, rf"(?s)(?:{LETTER}+|.)\z", "")).otherwise(front)
    return F.when(n <= most, text).otherwise(F.trim(F.regexp_replace(F.regexp_replace(back, "^[^‹›]*›", ""), r"‹[^›]*\z", "")))


def dense_snippets(rows: DataFrame, key: str, text: str, terms: list[str], out: str = "snippet", most: int = MOST) -> DataFrame:
    """rows with the passage that holds the most different terms, then the most hits, then comes first; the beginning
    where there is no hit. key names a row. A null text stays null.

    Hits, not texts, are grouped; each window looks at the hits within its characters, so the work grows with their
    number however many a text has."""
    wanted = sorted({t.lower() for t in terms if t})
    if not wanted:
        return rows.withColumn(out, passage(F.col(text), F.lit(0), most))
    held = rows.where(F.char_length(text) > most).select(F.col(key).alias("__key"), F.char_length(text).alias("n"), F.explode(hits(F.col(text), wanted)).alias("h"))
    low = F.greatest(F.lit(0), F.least(F.col("h.begin") - LEAD, F.col("n") - most))
    near = held.select("__key", F.col("h.begin").alias("begin"), F.col("h.end").alias("end"), F.col("h.term").alias("term"), low.alias("low"))
    frame = W.partitionBy("__key").orderBy("begin").rangeBetween(-most, most)
    inside = F.filter(F.collect_list(F.struct("begin", "end", "term")).over(frame), lambda x: (x.begin >= F.col("low")) & (x.end <= F.col("low") + most))
    scored = near.withColumn("inside", inside).select("__key", "begin", (-F.size(F.array_distinct(F.transform("inside", lambda x: x.term)))).alias("kinds"), (-F.size("inside")).alias("n"))
    best = scored.groupBy("__key").agg(F.min_by("begin", F.struct("kinds", "n", "begin")).alias("__at"))
    return rows.join(best, rows[key] == best["__key"], "left").withColumn(out, passage(F.col(text), F.coalesce("__at", F.lit(0)), most)).drop("__key", "__at")


def lead(text: Column, most: int = MOST) -> Column:
    """The beginning, cut back to a whole word."""
    cut = F.substring(text, 1, most)
    return F.when(F.char_length(text) <= most, text).otherwise(F.regexp_replace(cut, r"\s+\S*\z", ""))
