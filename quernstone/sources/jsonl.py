"""Line files: byte offsets, torn tails, permissive JSON, format detection, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, value: whole files, searched below the path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, modified; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 1), text, begin, end (bytes) of every line that a line end closes; a half-written last line is
    not consumed. A carriage return before the line end is not part of the text."""
    parts = F.split("value", "\n")
    rows = files.select("path", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("at", "raw"))
    size = F.octet_length("raw") + 1
    end = F.sum(size).over(W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("text"), (end - size).alias("begin"), end.alias("end"))


def records(lines: DataFrame) -> DataFrame:
    """Adds v, the line as a variant; null if it is no JSON object."""
    return lines.withColumn("v", F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text")))


def malformed(recs: DataFrame) -> DataFrame:
    """path, n_malformed: lines with text that hold no object."""
    return recs.groupBy("path").agg(F.count_if(F.col("v").isNull() & (F.trim("text") != "")).alias("n_malformed"))


def at(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def detect_formats(recs: DataFrame) -> DataFrame:
    """path, format by the shape of the first object of each file: codex, pi, claude, cursor or null."""
    kind = at("v", "type")
    enveloped = F.try_variant_get("v", "$.payload", "variant").isNotNull() & kind.isin("session_meta", "turn_context", "response_item", "event_msg", "compacted")
    header = (kind == "session") & at("v", "cwd").isNotNull() & at("v", "id").isNotNull()
    shape = F.when(enveloped, "codex").when(header, "pi").when(kind.isNotNull(), "claude").when(at("v", "role").isNotNull(), "cursor")
    return recs.where("v IS NOT NULL").groupBy("path").agg(F.min_by(shape, "line").alias("format"))


def changed(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest doesn't have with the same size and time (to the second)."""
    key = lambda df: df.select("path", "bytes", F.date_trunc("second", "modified").alias("__m"))
    return found.withColumn("__m", F.date_trunc("second", "modified")).join(key(manifest), ["path", "bytes", "__m"], "left_anti").drop("__m")


def head_and_tail(spark: SparkSession, path: str, glob: str = "*", size: int = 65_536) -> DataFrame:
    """path, bytes, head, tail: the first and last bytes of each file, cut in the scan's projection."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    cut = lambda e: F.expr(f"decode({e}, 'UTF-8')")
    return found.select("path", F.col("length").alias("bytes"), cut(f"substr(content, 1, {size})").alias("head"), cut(f"substr(content, greatest(1, octet_length(content) - {size} + 1))").alias("tail"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """path, line, heading, text of each section under an ATX heading; before the first one the file's name heads."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "raw"))
    title = F.regexp_extract("raw", r"^#{1,6}\s+(.*\S)\s*$", 1)
    order = W.partitionBy("path").orderBy("at")
    marked = rows.withColumn("title", F.when(title != "", title)).withColumn("part", F.count("title").over(order.rowsBetween(W.unboundedPreceding, 0)))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("at", "raw")))), lambda x: x.raw)
    found = marked.groupBy("path", "part").agg((F.min("at") + 1).alias("line"), F.max("title").alias("title"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("text"))
    return found.where("text <> ''").select("path", "line", F.coalesce("title", F.element_at(F.split("path", "/"), -1)).alias("heading"), "text")
