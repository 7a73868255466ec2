"""What keeps an archive in order: who lacks a title, which projects are hidden, where a session belongs, what is to be
embedded, asked, judged or copied again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators.filters import ignored
from quernstone.sources.ranges import opened


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def untitled_sessions(sessions: DataFrame, cards: DataFrame, key: str, title: Column, derived: Column, card_title: Column) -> DataFrame:
    """Sessions that nobody named, or that were named after their first prompt (`derived`), without a titled card."""
    return sessions.where(blank(title) | derived).join(cards.where(~blank(card_title)).select(key), key, "left_anti")


def untitled_ghosts(ghosts: DataFrame, cards: DataFrame, prompts: DataFrame, key: str, title: Column, card_title: Column, text: Column) -> DataFrame:
    """Ghosts without a title, without a titled card and without a prompt that could name them: one that is no command
    and has more than three characters."""
    usable = ~text.startswith("/") & (F.char_length(F.trim(text)) > 3)
    bare = ghosts.where(blank(title)).join(cards.where(~blank(card_title)).select(key), key, "left_anti")
    return bare.join(prompts.where(usable).select(key), key, "left_anti")


def ignored_projects(rows: DataFrame, project: str, entries: list[str]) -> DataFrame:
    """project: the distinct ones that an entry of the ignore list hides."""
    return rows.where(F.col(project).isNotNull()).select(project).distinct().where(ignored(F.col(project), entries))


def without_ignored(rows: DataFrame, project: str, entries: list[str], everything: bool = False, wanted: str | None = None) -> DataFrame:
    """Rows outside the ignored projects; rows of no project stay. Asking for everything, or for a project by name,
    turns the list off."""
    if everything or wanted or not entries:
        return rows
    return rows.join(ignored_projects(rows, project, entries), project, "left_anti")


def ancestors(path: Column, deepest: int | None = 32) -> Column:
    """The path and the folders above it, from the deepest up, without the root; of an absolute path. deepest: how many
    at most; None: all."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    up = F.transform(F.sequence(F.lit(0), (n if deepest is None else F.least(n, F.lit(deepest))) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n - i), "/")))
    return F.when(n > 0, up).otherwise(F.array().cast("array<string>"))


def path_slug(path: Column) -> Column:
    """A folder's name as some harnesses write it: every run of other characters is a dash."""
    return F.regexp_replace(F.regexp_replace(path, r"[^A-Za-z0-9]+", "-"), "^-|-$", "")


def recover_by_slug(slugs: DataFrame, paths: DataFrame, key: str, slug: str, path: str) -> DataFrame:
    """key, project, votes: for each session (key, slug) the folder above its paths (key, path) that most of them lie
    below and whose slug it is; of equal votes the first by name. A path votes once, for its deepest such folder.
    Sessions without one are missing."""
    above = paths.select(key, F.col(path).alias("__p"), F.posexplode(ancestors(F.col(path))).alias("up", "dir")).withColumn("__s", path_slug(F.col("dir")))
    met = above.join(slugs.select(key, F.col(slug).alias("__s")), [key, "__s"]).groupBy(key, "__p").agg(F.min_by("dir", "up").alias("dir"), F.count("*").alias("n"))
    # equal paths vote as often as they stand there
    times = paths.groupBy(key, F.col(path).alias("__p")).agg(F.count("*").alias("times"))
    votes = met.join(times, [key, "__p"]).groupBy(key, "dir").agg(F.sum("times").alias("votes"))
    return votes.groupBy(key).agg(F.min_by(F.struct("dir", "votes"), F.struct(-F.col("votes"), F.col("dir"))).alias("x")).select(key, F.col("x.dir").alias("project"), "x.votes")


def recover_by_hash(hashes: DataFrame, paths: DataFrame, key: str, digest: str, path: str) -> DataFrame:
    """key, project: the deepest folder above any path whose SHA-256 a session was filed under. A path that ends in a
    slash is a folder itself."""
    own = F.filter(ancestors(F.col(path), None), lambda x: x != F.col(path))
    above = paths.select(F.explode(own).alias("project")).distinct().withColumn("__h", F.sha2("project", 256))
    found = hashes.select(key, F.lower(digest).alias("__h")).join(above, "__h")
    return found.groupBy(key).agg(F.max_by("project", F.char_length("project")).alias("project"))


def first_resolving(claims: DataFrame, units: DataFrame, claim: str, session: str, seqs: str, ts: str) -> DataFrame:
    """claim, ts: of the units that a claim names (session, array of seqs) the first one's time that exists."""
    named = claims.select(claim, session, F.posexplode(seqs).alias("__at", "seq"))
    return named.join(units.select(session, "seq", ts), [session, "seq"]).where(F.col(ts).isNotNull()).groupBy(claim).agg(F.min_by(ts, "__at").alias(ts))


def owners(cards: DataFrame, sessions: DataFrame, ghosts: DataFrame, key: str) -> DataFrame:
    """Cards with the columns of their session or, marked so, of their ghost; cards of neither go."""
    live = cards.join(sessions, key).withColumn("is_ghost", F.lit(False))
    return live.unionByName(cards.join(ghosts, key).withColumn("is_ghost", F.lit(True)), allowMissingColumns=True)


def quote_pattern(quote: Column) -> Column:
    """A regular expression for the quote as `quote_normalized` compares it: any white space for a blank, any quotation
    mark or dash for a plain one, any case."""
    from quernstone.functions.text import quote_normalized

    plain = F.regexp_replace(quote_normalized(quote), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    for mark, several in (("-", "[-–—]"), ("'", "['‘’]"), ('"', '["“”]'), (" ", r"\s+")):
        plain = F.replace(plain, F.lit(mark), F.lit(several))
    return F.concat(F.lit("(?iu)("), plain, F.lit(")"))


def quote_span(text: Column, quote: Column, least: int = 16) -> Column:
    """begin, end (characters of the text, from 0) and exact (those characters) of the quote's first place, or null."""
    from quernstone.functions.text import quote_normalized

    pattern = quote_pattern(quote)
    at, exact = F.call_function("regexp_instr", text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(1))
    found = (F.char_length(quote_normalized(quote)) >= least) & (at > 0)
    return F.when(found, F.struct((at - 1).alias("begin"), (at - 1 + F.char_length(exact)).alias("end"), exact.alias("exact")))


def judged_evidence(evidence: DataFrame, units: DataFrame, session: str, seq: str, quote: str, text: str, least: int = 16) -> DataFrame:
    """evidence with span (see `quote_span`) and drop, null or why the line can't be used: unknown-session,
    unresolved-seq, too-short, not-a-quote. units: session, seq, text, each once."""
    from quernstone.functions.text import quote_normalized

    known = units.select(session).distinct().withColumn("__known", F.lit(True))
    rows = evidence.join(known, session, "left").join(units.select(session, seq, F.col(text).alias("__text"), F.lit(True).alias("__unit")), [session, seq], "left")
    short = F.char_length(quote_normalized(F.coalesce(quote, F.lit("")))) < least
    rows = rows.withColumn("span", quote_span(F.col("__text"), F.col(quote), least))
    why = F.when(F.col("__known").isNull(), "unknown-session").when(F.col("__unit").isNull(), "unresolved-seq").when(short, "too-short").when(F.col("span").isNull(), "not-a-quote")
    return rows.withColumn("drop", why).drop("__known", "__unit", "__text")


def holding_quotes(rows: DataFrame, quotes: DataFrame, key: str, text: str, quote_key: str, quote: str, least: int = 16) -> DataFrame:
    """key, quote_key, span: which texts hold which quotes. They meet on the quote's longest inner word, so that a text
    is compared with few quotes; quotes with fewer than three words meet no text here."""
    from quernstone.functions.text import quote_normalized, tokens

    words = tokens(quote_normalized(F.col(quote)))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), F.lit(0)).w
    asked = quotes.select(quote_key, F.col(quote).alias("__q"), longest.alias("__w")).where("__w IS NOT NULL")
    held = rows.select(key, F.col(text).alias("__t"), F.explode(F.array_distinct(tokens(quote_normalized(F.col(text))))).alias("__w"))
    met = held.join(asked, "__w").withColumn("span", quote_span(F.col("__t"), F.col("__q"), least))
    return met.where("span IS NOT NULL").select(key, quote_key, "span")


# --- vectors that are made again only where text or model changed


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def to_embed(rows: DataFrame, held: DataFrame, key: str, text: str, version: str) -> DataFrame:
    """Rows without a vector of this version and text. held: key, digest, version."""
    current = held.where(F.col("version") == version).select(key, "digest")
    return rows.withColumn("digest", text_digest(F.col(text))).join(current, [key, "digest"], "left_anti")


def embedded(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], version: str, batch: int = 64) -> DataFrame:
    """key, digest, version, vector: the embedder is called in the tasks, with `batch` texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                vectors = [[float(v) for v in x] for x in embedder([x or "" for x in part[text]])]
                yield pd.DataFrame({key: part[key], "digest": part["digest"], "version": version, "vector": vectors})

    given = rows if "digest" in rows.columns else rows.withColumn("digest", text_digest(F.col(text)))
    return given.select(key, text, "digest").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, digest string, version string, vector array<float>")


def refreshed(rows: DataFrame, held: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], version: str) -> DataFrame:
    """held with new vectors where text or version changed; vectors of rows that are no more go."""
    new = embedded(to_embed(rows, held, key, text, version), key, text, embedder, version)
    digests = rows.select(key, text_digest(F.col(text)).alias("digest"))
    kept = held.where(F.col("version") == version).join(digests, [key, "digest"], "left_semi").select(key, "digest", "version", "vector")
    return kept.union(new)


# --- a given model function over texts of any length


def asked(rows: DataFrame, key: str, text: str, ask: Callable[[str], str], whole: int = 60_000, chunk: int = 40_000) -> DataFrame:
    """key, answer, error, n_chunks: a short text is asked about once; a longer one in chunks, and then about the
    chunks' answers, in order. Where a call fails, its text alone has an error, of which `error` is the name."""
    n = F.char_length(text)
    begins = F.when(n <= whole, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n, F.lit(chunk)))
    size = F.when(n <= whole, n).otherwise(F.lit(chunk))
    parts = rows.where(F.col(text).isNotNull()).select(key, size.alias("size"), F.col(text).alias("t"), F.posexplode(begins).alias("nth", "at")).select(key, "nth", F.substring("t", F.col("at"), F.col("size")).alias("part"))
    kind = rows.schema[key].dataType.simpleString()

    def called(frames: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for x in f[name]:
                try:
                    answers.append(None if x is None else ask(x))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  # whatever the function raises concerns its text only
                    answers.append(None)
                    errors.append(type(e).__name__)
            yield f.drop(columns=[name]).assign(answer=answers, error=errors)

    first = parts.mapInPandas(lambda fs: called(fs, "part"), f"{key} {kind}, nth int, answer string, error string")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "answer"))), lambda x: x.answer)
    joined = first.groupBy(key).agg(F.array_join(listed, "\n\n").alias("joined"), F.max("error").alias("failed"), F.count("*").cast("int").alias("n_chunks"))
    again = joined.withColumn("told", F.when(F.col("failed").isNull() & (F.col("n_chunks") > 1), F.col("joined")))
    second = again.select(key, "joined", "failed", "n_chunks", "told").mapInPandas(lambda fs: called(fs, "told"), f"{key} {kind}, joined string, failed string, n_chunks int, answer string, error string")
    error = F.coalesce("failed", "error")
    return second.select(key, F.when(error.isNull(), F.coalesce("answer", "joined")).alias("answer"), error.alias("error"), "n_chunks")


def confirmed(claims: DataFrame, group: str, claim: str, text: str, judge: Callable[[list[str]], dict[int, bool]], size: int = 12) -> DataFrame:
    """claims with verdict: confirmed, overruled, unjudged (the judge left it out) or failed (the call did). The judge
    gets `size` texts of a group at a time and answers by their place, from 0; answers for other places are dropped."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(claim)) - 1
    rows = claims.withColumn("__n", nth).withColumn("__b", F.floor(F.col("__n") / size))
    lots = rows.groupBy(group, "__b").agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.coalesce(text, F.lit("")).alias("t")))).alias("lot"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, lot in zip(f["g"], f["lot"]):
                try:
                    said = judge([x["t"] for x in lot])
                    out += [(g, int(x["n"]), {True: "confirmed", False: "overruled"}.get(said.get(i), "unjudged")) for i, x in enumerate(lot)]
                except Exception:  # noqa: BLE001
                    out += [(g, int(x["n"]), "failed") for x in lot]
            yield pd.DataFrame(out, columns=["__g", "__m", "verdict"])

    kind = claims.schema[group].dataType.simpleString()
    told = lots.select(F.col(group).alias("g"), "lot").mapInPandas(run, f"__g {kind}, __m int, verdict string")
    return rows.join(told, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__n") == F.col("__m"))).drop("__n", "__b", "__g", "__m")


# --- content-addressed copies


def copied(files: DataFrame, target: str, step: int = 1 << 20) -> DataFrame:
    """path, sha256, bytes, copied, error for each file (path): its bytes stand under `target` by their digest. Tasks
    copy in steps to a temporary name, and rename when all is written, so that a killed task leaves no half file under a
    digest, and a task that runs again finds the copy. Equal contents are kept once."""

    def one(path: str) -> tuple:
        store, at = opened(path)
        goal, base = opened(target)
        goal.create_dir(base, recursive=True)
        sha, size = hashlib.sha256(), 0
        with store.open_input_stream(at) as f:
            while data := f.read(step):
                sha.update(data)
                size += len(data)
        name = f"{base.rstrip('/')}/{sha.hexdigest()}"
        if goal.get_file_info(name).type == fs.FileType.File and goal.get_file_info(name).size == size:
            return path, sha.hexdigest(), size, False, None
        import uuid

        aside, again = f"{base.rstrip('/')}/.{uuid.uuid4().hex}.part", hashlib.sha256()
        try:
            with store.open_input_stream(at) as f, goal.open_output_stream(aside) as out:
                while data := f.read(step):
                    again.update(data)
                    out.write(data)
            if again.digest() != sha.digest():
                raise ValueError("file changed while it was copied")
            goal.move(aside, name)
        finally:
            if goal.get_file_info(aside).type == fs.FileType.File:
                goal.delete_file(aside)
        return path, sha.hexdigest(), size, True, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path in f["path"]:
                try:
                    out.append(one(path))
                except (OSError, ValueError) as e:
                    out.append((path, None, None, False, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "sha256", "bytes", "copied", "error"]).astype({"bytes": "Int64"})

    return files.select("path").mapInPandas(run, "path string, sha256 string, bytes long, copied boolean, error string")
