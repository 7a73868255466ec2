"""Registered queries on upkeep: missing titles, hidden projects, recovered folders, evidence, embedding, judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import upkeep as K
from quernstone.operators.stored import new_path
from quernstone.plans.tables import table
from quernstone.sources.ranges import line_ranges


def s1_line_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as JSON lines, read again by ranges of 100 kB."""
    path = new_path(spark, "lines")
    table(spark, d, "conversations").write.json(path)
    lines = line_ranges(spark, path, "*.json", 100_000).where("closed")
    row = F.from_json("text", "conv_id long, turn long, role string, text string")
    return lines.select(row.alias("r")).select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("text_md5"))


def card_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr("doc_id", "CASE WHEN quality = 1 THEN ' t ' WHEN toxic = 1 THEN ' ' END AS card_title")


def f10_untitled_sessions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 4 > 1 THEN source WHEN doc_id % 4 = 1 THEN ' ' END AS title")
    return K.untitled_sessions(docs, card_titles(spark, d), "doc_id", F.col("title"), F.col("doc_id") % 4 == 3, F.col("card_title")).select("doc_id")


def f11_untitled_ghosts(spark: SparkSession, d: str) -> DataFrame:
    ghosts = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN lang END AS title")
    prompts = table(spark, d, "pages").selectExpr("page_id * 2 AS doc_id", "CASE page_id % 3 WHEN 0 THEN '/clear everything' WHEN 1 THEN ' ok ' ELSE url END AS text")
    return K.untitled_ghosts(ghosts, card_titles(spark, d), prompts, "doc_id", F.col("title"), F.col("card_title"), F.col("text")).select("doc_id")


IGNORED = ["DE", "therha.example.com"]


def f17_without_ignored(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("path", F.when(F.col("page_id") % 10 > 0, F.regexp_replace("url", "^https?://", "")))
    return K.without_ignored(pages, "path", IGNORED).select("page_id")


def folders(spark: SparkSession, d: str) -> DataFrame:
    """host, path (/host/language/number) and home (/host/language) of every page."""
    path = F.split_part(F.split_part(F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", "")), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, d, "pages").withColumn("path", path).select("page_id", F.split_part("path", F.lit("/"), F.lit(2)).alias("host"), "path", F.regexp_replace("path", "/[^/]*$", "").alias("home"))


def x13_recovered_projects(spark: SparkSession, d: str) -> DataFrame:
    """Of each host the folder whose slug its first page's folder has."""
    rows = folders(spark, d)
    slugs = rows.groupBy("host").agg(K.path_slug(F.min_by("home", "page_id")).alias("slug"))
    return K.recover_by_slug(slugs, rows, "host", "slug", "path")


def x13_hashed_projects(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose folder is known by its digest only, among the paths of the others."""
    rows = folders(spark, d)
    hashes = rows.where("page_id % 5 = 0").select("page_id", F.upper(F.sha2("home", 256)).alias("digest"))
    return K.recover_by_hash(hashes, rows.where("page_id % 5 > 0").drop("page_id"), "page_id", "digest", "path")


def j13_first_resolving(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("session"), F.array((F.col("o_orderkey") % 7).cast("long"), F.lit(3).cast("long"), F.lit(1).cast("long")).alias("seqs"))
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_shipdate").cast("date").cast("string").alias("ts")).groupBy("session", "seq").agg(F.min("ts").alias("ts"))
    return K.first_resolving(claims, units, "o_orderkey", "session", "seqs", "ts")


def j3_card_owners(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    live = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("owner"))
    gone = table(spark, d, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("owner"))
    return K.owners(cards, live, gone, "id")


def c10_quote_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where documents hold a whole benchmark item, in the documents' own characters."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = K.holding_quotes(docs, items, "doc_id", "text", "item_id", "quote")
    return found.select("doc_id", "item_id", "span.begin", "span.end", F.md5("span.exact").alias("exact_md5"))


def g10_judged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every turn quoted: as it is but for line ends, too short, from another turn, from no session, or as never said."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    k = (F.col("session") + F.col("seq")) % 5
    quote = F.when(k == 1, F.substring("text", 1, 9)).when(k == 4, F.lit("this was certainly never said by anyone")).otherwise(F.replace("text", F.lit(" "), F.lit("\n ")))
    evidence = turns.select(F.col("session").alias("of"), F.col("seq").alias("at"), F.when(k == 3, F.col("session") + 10**9).otherwise(F.col("session")).alias("session"), F.when(k == 2, F.col("seq") + 10**6).otherwise(F.col("seq")).alias("seq"), quote.alias("quote"))
    return K.judged_evidence(evidence, turns, "session", "seq", "quote", "text").select("of", "at", "drop", "span.begin", "span.end")


def held_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A third has vectors of an older model, a third of this one, of which some are of older texts."""
    return table(spark, d, "documents").where("doc_id % 3 < 2").selectExpr("doc_id", "CASE WHEN doc_id % 9 = 1 THEN 'old' ELSE md5(coalesce(text, '')) END AS digest", "CASE WHEN doc_id % 3 = 0 THEN 'm1' ELSE 'm2' END AS version", "array(CAST(-1 AS FLOAT), CAST(0 AS FLOAT)) AS vector")


def t7_to_embed(spark: SparkSession, d: str) -> DataFrame:
    return K.to_embed(table(spark, d, "documents").select("doc_id", "text"), held_vectors(spark, d), "doc_id", "text", "m2").select("doc_id", "digest")


def v10_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a plain embedder, characters and blanks of a text, where the held ones are stale."""
    found = K.refreshed(table(spark, d, "documents").select("doc_id", "text"), held_vectors(spark, d), "doc_id", "text", lambda texts: [[len(x), x.count(" ")] for x in texts], "m2")
    return found.select("doc_id", "version", F.col("vector")[0].cast("long").alias("a"), F.col("vector")[1].cast("long").alias("b"))


def _judge(texts: list[str]) -> dict[int, bool]:
    if len(texts[0]) % 11 == 0:
        raise ValueError("no answer")
    return {i: len(x) % 2 == 0 for i, x in enumerate(texts) if len(x) % 5 > 0}


def h14_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Turns judged twelve at a time by a plain function that fails and forgets now and then."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 50).alias("card"), F.struct("conv_id", "turn").alias("claim"), "text")
    return K.confirmed(rows, "card", "claim", "text", _judge).select("claim.conv_id", "claim.turn", "verdict")


def _ask(text: str) -> str:
    if "token =" in text:
        raise ValueError("no")
    return str(len(text))


def h15_asked(spark: SparkSession, d: str) -> DataFrame:
    return K.asked(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _ask, 2000, 1000)


QUERIES = {f.__name__: f for f in (s1_line_ranges, f10_untitled_sessions, f11_untitled_ghosts, f17_without_ignored, x13_recovered_projects, x13_hashed_projects, j13_first_resolving, j3_card_owners, c10_quote_spans, g10_judged_evidence, t7_to_embed, v10_refreshed, h14_confirmed, h15_asked)}
_TITLED = "SELECT doc_id FROM labels WHERE quality = 1"
_FOLDERS = r"""f AS (SELECT page_id, split_part(path, '/', 2) AS host, path, regexp_replace(path, '/[^/]*$', '') AS home FROM (SELECT page_id, split_part(split_part('/' || regexp_replace(url, '^https?://', ''), '?', 1), '#', 1) AS path FROM pages)),
up AS (SELECT page_id, host, path, n, '/' || array_to_string(p[1:n], '/') AS dir FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM f)))"""
_SLUG = r"regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_NORM = r"trim(regexp_replace(lower(translate({0}, '‘’“”–—', '''''""--')), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')"
_PATTERN = r"""'(?i)(' || replace(replace(replace(replace(regexp_replace(q, '([\\.\[\]{}()*+?^$|])', '\\\1', 'g'), '-', '[-–—]'), '''', '[''‘’]'), '"', '["“”]'), ' ', '\s+') || ')'"""
ORACLE_SQL = {
    "s1_line_ranges": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
    "f10_untitled_sessions": f"SELECT doc_id FROM documents WHERE (doc_id % 4 <> 2 OR source IS NULL) AND doc_id NOT IN ({_TITLED})",
    "f11_untitled_ghosts": f"SELECT doc_id FROM documents WHERE (doc_id % 3 <> 0 OR lang IS NULL OR trim(lang) = '') AND doc_id NOT IN ({_TITLED}) AND doc_id NOT IN (SELECT page_id * 2 FROM pages WHERE page_id % 3 = 2 AND url NOT LIKE '/%' AND length(trim(url)) > 3)",
    "f17_without_ignored": "WITH p AS (SELECT page_id, CASE WHEN page_id % 10 > 0 THEN lower(regexp_replace(url, '^https?://', '')) END AS path FROM pages) SELECT page_id FROM p WHERE path IS NULL OR NOT (path = 'de' OR starts_with(path, 'de/') OR list_contains(string_split(path, '/'), 'de') OR path = 'therha.example.com' OR starts_with(path, 'therha.example.com/') OR list_contains(string_split(path, '/'), 'therha.example.com'))",
    "x13_recovered_projects": f"""WITH {_FOLDERS}, s AS (SELECT host, {_SLUG.format('arg_min(home, page_id)')} AS slug FROM f GROUP BY host),
m AS (SELECT up.host, page_id, arg_max(dir, n) AS dir FROM up JOIN s ON s.host = up.host AND {_SLUG.format('dir')} = slug GROUP BY up.host, page_id),
v AS (SELECT host, dir, count(*) AS votes, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, dir) AS n FROM m GROUP BY host, dir) SELECT host, dir AS project, votes FROM v WHERE n = 1""",
    "x13_hashed_projects": f"WITH {_FOLDERS}, d AS (SELECT DISTINCT dir FROM up WHERE page_id % 5 > 0 AND dir <> path) SELECT f.page_id, arg_max(dir, length(dir)) AS project FROM f JOIN d ON sha256(f.home) = sha256(d.dir) WHERE f.page_id % 5 = 0 GROUP BY f.page_id",
    "j13_first_resolving": "WITH c AS (SELECT o_orderkey, unnest([o_orderkey % 7, 3, 1]) AS seq, unnest([1, 2, 3]) AS place FROM orders), u AS (SELECT l_orderkey, l_linenumber, min(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS ts FROM lineitem GROUP BY ALL) SELECT o_orderkey, arg_min(ts, place) AS ts FROM c JOIN u ON l_orderkey = o_orderkey AND l_linenumber = seq GROUP BY o_orderkey",
    "j3_card_owners": "WITH c AS (SELECT DISTINCT l_partkey AS id FROM lineitem) SELECT id, c_mktsegment AS owner, false AS is_ghost FROM c JOIN customer ON c_custkey = id WHERE id % 2 = 0 UNION ALL SELECT id, p_type, true FROM c JOIN part ON p_partkey = id WHERE id % 2 = 1",
    "c10_quote_spans": f"""WITH i AS (SELECT item_id, {_NORM.format('text')} AS q FROM benchmark), t AS (SELECT doc_id, text, {_NORM.format('text')} AS n FROM documents),
m AS (SELECT doc_id, item_id, text, regexp_extract(text, {_PATTERN}, 1) AS exact FROM t JOIN i ON contains(n, q) AND length(q) >= 16 AND len(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+')) > 2)
SELECT doc_id, item_id, CAST(strpos(text, exact) - 1 AS INTEGER) AS begin, CAST(strpos(text, exact) - 1 + length(exact) AS INTEGER) AS "end", md5(exact) AS exact_md5 FROM m""",
    "g10_judged_evidence": f"""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, coalesce(text, '') AS x, {_NORM.format("coalesce(text, '')")} AS n FROM conversations)
SELECT conv_id AS of, turn AS at, CASE WHEN k = 3 THEN 'unknown-session' WHEN k = 2 THEN 'unresolved-seq' WHEN k = 1 OR (k = 0 AND length(n) < 16) THEN 'too-short' WHEN k = 4 THEN 'not-a-quote' END AS drop,
CAST(CASE WHEN k = 0 AND length(n) >= 16 THEN length(x) - length(ltrim(x, ' ' || chr(9) || chr(10))) END AS INTEGER) AS begin, CAST(CASE WHEN k = 0 AND length(n) >= 16 THEN length(rtrim(x, ' ' || chr(9) || chr(10))) END AS INTEGER) AS "end" FROM t""",
    "t7_to_embed": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id % 9 <> 1)",
    "v10_refreshed": "SELECT doc_id, 'm2' AS version, CAST(CASE WHEN doc_id % 3 = 1 AND doc_id % 9 <> 1 THEN -1 ELSE length(coalesce(text, '')) END AS BIGINT) AS a, CAST(CASE WHEN doc_id % 3 = 1 AND doc_id % 9 <> 1 THEN 0 ELSE length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) END AS BIGINT) AS b FROM documents",
    "h14_confirmed": """WITH r AS (SELECT conv_id, turn, conv_id % 50 AS card, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id, turn) - 1 AS i FROM conversations),
b AS (SELECT *, first_value(n) OVER (PARTITION BY card, i // 12 ORDER BY i) AS lead FROM r) SELECT conv_id, turn, CASE WHEN lead % 11 = 0 THEN 'failed' WHEN n % 5 = 0 THEN 'unjudged' WHEN n % 2 = 0 THEN 'confirmed' ELSE 'overruled' END AS verdict FROM b""",
    "h15_asked": """WITH p AS (SELECT doc_id, length(text) AS n, unnest(CASE WHEN length(text) <= 2000 THEN [1] ELSE range(1, length(text) + 1, 1000) END) AS place, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, place, CASE WHEN n <= 2000 THEN text ELSE substr(text, place, 1000) END AS part FROM p),
j AS (SELECT doc_id, count(*) AS n, bool_or(contains(part, 'token =')) AS bad, string_agg(CAST(length(part) AS VARCHAR), chr(10) || chr(10) ORDER BY place) AS told FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN NOT bad THEN CASE WHEN n > 1 THEN CAST(length(told) AS VARCHAR) ELSE told END END AS answer, CASE WHEN bad THEN 'ValueError' END AS error, CAST(n AS INTEGER) AS n_chunks FROM j""",
}
