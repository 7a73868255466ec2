"""From raw documents to packed training sequences: language ID, line dedup, near-duplicates, decontamination,
packing. Each stage reads what the one before it kept, written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import simhash
from quernstone.llm.common import joined_ids, stored, table
from quernstone.llm.decontaminate import contamination
from quernstone.llm.langid import predict_languages, sample_languages
from quernstone.llm.linededup import dedup_lines
from quernstone.llm.packing import best_fit_packing
from quernstone.llm.simhash import document_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or without a text) go; the others keep all of their columns. Repeated rows stay, each;
    of languages that cost the same the first by name is taken, which decides about no document."""
    keep = tuple(docs.columns)
    found = predict_languages(docs.select(*[F.col(c).alias(f"_{c}") for c in keep]), sample_languages(docs, "doc_id", "text", "lang"), "_doc_id", "_text", tuple(f"_{c}" for c in keep))
    return found.where("lang_pred <> 'und'").select(*[F.col(f"_{c}").alias(c) for c in keep])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts, and documents that consisted of such copies only. Repeated
    rows of one id and text are one document to it and stay, each, with the same text."""
    # the columns travel as one, so that none clashes with what the operator adds
    found = dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("own")))
    emptied = (F.size("lines_gone") > 0) & (F.trim(F.translate("line_text", "\n\t\r", "   ")) == "")
    kept = found.where(~F.coalesce(emptied, F.lit(False)))
    changed = {"text": F.col("line_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("lines_gone") > 0, F.length("line_text")).otherwise(F.col("own.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[changed.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints 3 bits apart, or five-word shingles of similarity 0.8) the document
    with the least id stays; of repeated rows of one id and text one does. Different texts of one id are told apart."""
    rows = docs.select(document_key(F.col("doc_id"), F.col("text")).alias("k"), F.struct(*docs.columns).alias("own"))
    kept = joined_ids(rows, stored(simhash.near_copies(docs)), "k", "left_anti")
    twice = stored(rows.groupBy("k").count().where("count > 1").select("k"))
    if not twice.isEmpty():
        kept = joined_ids(kept, twice, "k", "left_anti").union(joined_ids(kept, twice, "k", "left_semi").dropDuplicates(["k"]))
    return kept.select(*[F.col("own")[c].alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Rows without an id stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), 10)
    return joined_ids(docs, stored(found.where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()), "doc_id", "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens. Repeated rows are packed each; null and empty texts are one separator."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontaminated", decontaminated), ("packed", packed)]
#: Suffix ranks, fingerprints' components and a genetic packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i < len(STAGES) - 1 else docs
    return docs
