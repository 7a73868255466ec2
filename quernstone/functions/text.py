"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic of their own.
QUERY_STOPWORDS = ["a", "an", "the", "and", "or", "of", "to", "in", "on", "at", "for", "with", "is", "it", "this", "that", "be", "was", "are", "as", "by", "we", "i"]
#: One-word prompts that name nothing.
TITLE_STOPWORDS = ["clear", "continue", "ok", "yes", "hi", "y", "n"]
#: Words too general to be a topic, English first, then what every card holds.
TOPIC_STOPWORDS = (
    "the and for with that this from into not but was were are has have had its our their them then than when where which "
    "while you your all any can will would should must use used using via per out off over under each more most one two new "
    "old same other only also because instead rather "
    "add added fix fixed run ran set get make made keep kept code file files test tests data value values name names type "
    "types src lib index main util utils config default error errors line lines text json null true false session sessions "
    "project projects decision decisions thread threads"
).split()
#: Fixed patterns: spans of a transcript that are nobody's words.
BOILERPLATE = [
    r"(?i)\[Image:[^\]]*\]?",
    r"(?i)\[Pasted text[^\]]*\]?",
    r"(?i)\[Request interrupted[^\]]*\]?",
    r"(?i)</?(?:system-reminder|local-command-stdout|local-command-stderr|command-name|command-message|command-args|tool_use_error|user-prompt-submit-hook)>",
    r"(?i)Caveat: The messages below were generated[^\n]*",
    r"(?i)\bdata:[a-z/+.-]+;base64,[A-Za-z0-9+/=]+",
    r"(?:[A-Za-z]:)?(?:/[\w.@+-]+){2,}/?",
    r"(?i)\b[0-9a-f]{16,}\b",
]
TITLE_CHARS, LEAST_TITLE = 60, 8


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_boilerplate(text: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, " "), BOILERPLATE, text)


def mostly_boilerplate(text: Column) -> Column:
    """Fewer than four words are left without the boilerplate."""
    return F.regexp_count(strip_boilerplate(text), F.lit(r"\p{L}{2,}")) < 4


def substantive(text: Column) -> Column:
    clean = collapse(strip_boilerplate(F.coalesce(text, F.lit(""))))
    return ~clean.startswith("/") & (F.char_length(clean) >= LEAST_TITLE) & ~F.lower(clean).isin(TITLE_STOPWORDS)


def derived_title(text: Column) -> Column:
    return F.substring(collapse(strip_boilerplate(text)), 1, TITLE_CHARS)


def display_title(card: Column, own: Column, slug: Column, ident: Column) -> Column:
    """A card's title before the session's own before `slug-id8`; blanks don't count."""
    said = lambda c: F.nullif(collapse(c), F.lit(""))
    return F.coalesce(said(card), said(own), F.concat_ws("-", slug, F.substring(ident, 1, 8)))


def last_segment(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path, r"[/\\]"), lambda x: x != ""), F.lit(-1))


def normalize_tag(text: Column, most: int = 32) -> Column:
    """Lower case, runs of anything but a-z 0-9 . / - as one dash, no dash at the ends."""
    dashed = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9./-]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, most), r"-+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def content_tokens(text: Column, least: int = 3, once: bool = False) -> Column:
    """Topic words: alphanumeric runs of three or more with a letter that are no stop words, in order; each but once, if
    so asked."""
    raw = F.split(F.lower(text), r"[^a-z0-9]+")
    raw = F.array_distinct(raw) if once else raw
    kept = F.filter(raw, lambda t: (F.length(t) >= least) & t.rlike("[a-z]"))
    return F.filter(kept, lambda t: ~t.isin(TOPIC_STOPWORDS))


def normalize_path(path: Column) -> Column:
    forward = F.translate(F.trim(path), "\\", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(forward, r"^\./", ""), r"^/+", ""))


def slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[^A-Za-z0-9]", "-")


def safe_segment(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character."""

    def of(t: Column) -> Column:
        n = F.char_length(t).cast("double")
        chars = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
        shares = F.transform(chars, lambda c: (n - F.char_length(F.replace(t, c, F.lit("")))) / n)
        return F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(shares, F.lit(0.0), lambda s, x: s + x * F.log2(x)))

    # the text is made once and named, not written out in every step of the lambdas
    return F.get(F.transform(F.array(text), of), F.lit(0))


def quote_normalized(text: Column) -> Column:
    """For verbatim tests: straight quotes and dashes, one blank for white space, lower case."""
    return collapse(F.lower(F.translate(text, "‘’“”–—", "''\"\"--")))


def quotes(text: Column, quote: Column, least: int = 16) -> Column:
    """Whether text holds the quote, normalised, of at least so many characters."""
    q = quote_normalized(quote)
    return (F.char_length(q) >= least) & F.contains(quote_normalized(text), q)


def word_count(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def exchange_id(session: Column, seq: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", session.cast("string"), seq.cast("string")), 256), 1, 32)


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / F.lit(3.6).cast("double")).cast("long")


def elide_middle(text: Column, most: int, mark: str = " … ") -> Column:
    side = (most - len(mark)) // 2
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, side), F.lit(mark), F.right(text, F.lit(side))))


def clamp_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, most), " ")


def epoch_to_timestamp(n: Column) -> Column:
    """Seconds or milliseconds since 1970, told apart by size."""
    return F.when(F.abs(n) >= 100_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def sentences(text: Column) -> Column:
    """Split after . ! ? and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")


def states_decision(sentence: Column) -> Column:
    """A sentence that decides, not one that asks."""
    decides = sentence.rlike(r"(?i)\b(?:we(?:'ll| will)|let's|use|switch(?:ed)? to|decided|going with|instead of|keep|drop)\b")
    asks = sentence.rlike(r"\?\s*$") | sentence.rlike(r"(?i)^(?:should|could|can|would|what|why|how|is|are|do|does)\b")
    return decides & ~asks


def strip_tags(text: Column, blocks: list[str], unwrap: list[str]) -> Column:
    """Harness tags: those in blocks go with their content, those in unwrap leave it."""
    for t in blocks:
        text = F.regexp_replace(text, rf"(?is)<{t}>.*?</{t}>", "")
    for t in unwrap:
        text = F.regexp_replace(text, rf"(?i)</?{t}>", "")
    return F.trim(text)


def like_pattern(pattern: str) -> str:
    """A filter pattern as an ILIKE pattern with \\ as escape: * is a wildcard; without one the text may stand anywhere."""
    escaped = pattern.replace("\\", "\\\\").replace("_", "\\_")
    return escaped.replace("*", "%") if "*" in pattern or "%" in pattern else f"%{escaped}%"
