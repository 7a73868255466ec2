"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import ORACLE as OP3_SQL
from .decontaminate import contamination
from .langid import predict_languages, sample_languages
from .linededup import ORACLE as OP7_SQL
from .linededup import dedup_lines
from .merkle import ORACLE as OP13_SQL
from .merkle import merkle_manifest
from .packing import best_fit_packing
from .pii import personal_data
from .quality import quality_rules
from .ranking import ORACLE as OP11_SQL
from .ranking import ranked_search
from .simhash import near_duplicates
from .substrings import repeated_passages
from .suffixes import dedup_substrings
from .tokencount import token_counts
from .toxicity import toxicity, train


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, sample_languages(docs, "doc_id", "text", "lang"))


def op2_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.col("lines_gone")
    return found.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_gone"), F.array_join(gone.cast("array<string>"), ",").alias("lines_gone"), F.sha2("line_text", 256).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n_removed = F.aggregate("cut_runs", F.lit(0).cast("long"), lambda n, r: n + r.end - r.begin)
    return found.select("doc_id", n_bytes.alias("n_bytes"), n_removed.alias("n_removed"), F.size("cut_runs").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against a copy of the table in which every other document lost its line feeds."""
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), checked={"text": altered})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_tokencount": op2_tokencount,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_substrings": op6_substrings,
    "op7_linededup": op7_linededup,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_ranking": op11_ranking,
    "op12_suffixes": op12_suffixes,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op7_linededup": OP7_SQL,
    "op11_ranking": OP11_SQL,
    "op13_merkle": OP13_SQL,
}
