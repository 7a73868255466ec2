"""Registered queries on what is shown, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import format as S
from quernstone.operators import fold as X
from quernstone.plans.tables import table


def c16_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("q"), "l_shipdate")
    return rows.select(
        "l_orderkey", "l_linenumber", S.shown_number(F.col("x")).alias("number"), S.shown_share(F.col("q"), F.lit(50.0)).alias("share"), S.shown_day(F.col("l_shipdate"), F.lit("1996-06-01").cast("date")).alias("day"),
        S.shown_duration(F.floor(F.col("x") * 3)).alias("duration"), S.shown_money(F.floor(F.col("y") * F.col("q") * 100) / 1000).alias("money"), S.shown_bytes(F.floor(F.col("x") * F.col("q") * F.col("q"))).alias("bytes"),
    )


def c5_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.tag_of(F.col("url")).alias("tag"))


def c20_units(spark: SparkSession, d: str) -> DataFrame:
    rows = X.fold_exchanges(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    ts = F.when(F.col("seq") % 2 == 0, F.lit("2026-08-21T09:14:03Z"))
    return rows.select("conv_id", "seq", F.md5(S.unit_text(F.col("user_text"), F.col("assistant_text"))).alias("text_md5"), S.unit_header(F.col("seq"), ts).alias("header"))


def c23_citations(spark: SparkSession, d: str) -> DataFrame:
    """Lines of citations made of order keys: groups of a full one and bare numbers, notes, and holes."""
    key = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8)
    n = F.col("o_orderkey")
    line = F.concat(F.lit("kept [see 4]  ["), key, F.lit("@"), n.cast("string"), F.when(n % 3 == 0, F.concat(F.lit(", 7, @"), (n + 1).cast("string"))).otherwise(""), F.lit("]"), F.when(n % 2 == 0, " [, ] end ").otherwise(" [a, 1]"))
    return table(spark, d, "orders").select("o_orderkey", S.tidy_citations(S.expand_citations(line)).alias("line"))


QUERIES = {f.__name__: f for f in (c16_formats, c5_tags, c20_units, c23_citations)}
_UP = lambda x, k: f"(floor(({x}) * {10**k} + 0.5) / {10**k})"
_FIX = lambda x, k: f"printf('%.{k}f', CAST({_UP(x, k)} AS DOUBLE))"
_SIZE = " ".join(f"WHEN b >= {1024**i} THEN CASE WHEN b / {1024.0**i}::DOUBLE >= 100 THEN {_FIX(f'b / {1024.0**i}::DOUBLE', 0)} ELSE {_FIX(f'b / {1024.0**i}::DOUBLE', 1)} END || ' {u}'" for i, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")))
ORACLE_SQL = {
    "c16_formats": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS x, l_quantity::DOUBLE AS q, l_shipdate AS s, CAST(floor(l_extendedprice::DOUBLE * 3) AS BIGINT) AS ms, floor(l_discount::DOUBLE * l_quantity::DOUBLE * 100) / 1000 AS m, CAST(floor(l_extendedprice::DOUBLE * l_quantity::DOUBLE * l_quantity::DOUBLE) AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, format('{{:,}}', CAST(floor(x + 0.5) AS BIGINT)) AS number, CAST(CAST(floor(q / 50.0::DOUBLE * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS share,
day(s) || ' ' || lower(strftime(s, '%b')) || CASE WHEN year(s) = 1996 THEN '' ELSE ' ' || year(s) END AS day,
CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN {_FIX('ms / 1000.0::DOUBLE', 1)} || 's' ELSE (ms // 60000) || 'm' || CASE WHEN floor(ms % 60000 / 1000.0::DOUBLE + 0.5) > 0 THEN ' ' || CAST(floor(ms % 60000 / 1000.0::DOUBLE + 0.5) AS BIGINT) || 's' ELSE '' END END AS duration,
CASE WHEN m = 0 THEN '$0' WHEN m < 0.01 THEN '$' || {_FIX('m', 4)} WHEN m < 1 THEN '$' || {_FIX('m', 3)} ELSE '$' || {_FIX('m', 2)} END AS money, CASE {_SIZE} ELSE b || ' B' END AS bytes FROM r""",
    "c5_tags": "SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 32) AS tag FROM pages",
    "c20_units": """WITH n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
f AS (SELECT conv_id, seq, trim(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant'), ''), ' ') AS u, trim(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), ''), ' ') AS a FROM n WHERE seq > 0 GROUP BY conv_id, seq)
SELECT conv_id, CAST(seq AS BIGINT) AS seq, md5(concat_ws(chr(10) || chr(10), CASE WHEN u <> '' THEN 'user: ' || u END, CASE WHEN a <> '' THEN 'assistant: ' || a END)) AS text_md5, '[seq ' || CAST(seq AS BIGINT) || CASE WHEN seq % 2 = 0 THEN ' · 2026-08-21' ELSE '' END || ']' AS header FROM f WHERE u <> '' OR a <> ''""",
    "c23_citations": """WITH k AS (SELECT o_orderkey AS n, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS k FROM orders)
SELECT n AS o_orderkey, 'kept [see 4] [' || k || '@' || n || CASE WHEN n % 3 = 0 THEN ', ' || k || '@7, ' || k || '@' || (n + 1) ELSE '' END || ']' || CASE WHEN n % 2 = 0 THEN ' end' ELSE ' [a, 1]' END AS line FROM k""",
}
