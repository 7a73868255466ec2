"""Numbers, times, sizes and units as they are shown, and citations in generated lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(value: Column, digits: int) -> Column:
    """Halves go up."""
    return F.round(value.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")


def shown_number(value: Column) -> Column:
    """1234.5 as 1,235."""
    return F.format_number(F.floor(value + 0.5), 0)


def shown_share(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, "0%").otherwise(F.concat(F.floor(part / whole * 100 + 0.5).cast("string"), F.lit("%")))


def shown_day(at: Column, now: Column | None = None) -> Column:
    """21 aug 2025; without the year if it is that of `now`. `?` for null."""
    day = F.concat(F.dayofmonth(at).cast("string"), F.lit(" "), F.lower(F.date_format(at, "MMM")))
    year = F.concat(F.lit(" "), F.year(at).cast("string"))
    year = year if now is None else F.when(F.year(at) == F.year(now), "").otherwise(year)
    return F.coalesce(F.concat(day, year), F.lit("?"))


def shown_duration(ms: Column) -> Column:
    minutes, seconds = F.floor(ms / 60_000), F.floor(ms % 60_000 / 1000 + 0.5)
    long = F.concat(minutes.cast("string"), F.lit("m"), F.when(seconds > 0, F.concat(F.lit(" "), seconds.cast("string"), F.lit("s"))).otherwise(""))
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(_fixed(ms / 1000, 1), F.lit("s"))).otherwise(long)


def shown_money(usd: Column) -> Column:
    """The smaller, the more digits."""
    digits = F.when(usd < 0.01, _fixed(usd, 4)).when(usd < 1, _fixed(usd, 3)).otherwise(_fixed(usd, 2))
    return F.when(usd == 0, "$0").otherwise(F.concat(F.lit("$"), digits))


def shown_bytes(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    shown = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        v = n / float(1024**i)
        text = F.concat(F.when(v >= 100, _fixed(v, 0)).otherwise(_fixed(v, 1)), F.lit(f" {unit}"))
        shown = F.when(n >= 1024**i, text).otherwise(shown)
    return shown


def tag_of(text: Column, most: int = 32) -> Column:
    """One spelling of a tag: small letters and digits, a dash for all else."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def unit_text(user: Column, assistant: Column) -> Column:
    """Both sides of an exchange, each after its name; a missing or blank side is left out."""
    side = lambda name, text: F.when(F.trim(text) != "", F.concat(F.lit(f"{name}: "), F.trim(text)))
    return F.concat_ws("\n\n", side("user", user), side("assistant", assistant))


def unit_header(seq: Column, ts: Column) -> Column:
    day = F.substring(ts.cast("string"), 1, 10)
    return F.concat(F.lit("[seq "), seq.cast("string"), F.when(day != "", F.concat(F.lit(" · "), day)).otherwise(""), F.lit("]"))


def expand_citations(line: Column) -> Column:
    """[abcdef@1, 2, @3] as [abcdef@1, abcdef@2, abcdef@3]: bare numbers in a group that begins with a full citation are
    given its session. Other groups and other items stay as they are."""
    group = r"\[[^\]\[\n]{0,400}\]"
    parts = F.arrays_zip(F.split(line, group).alias("gap"), F.regexp_extract_all(line, F.lit(group), F.lit(0)).alias("group"))

    def item(x: Column, ident: Column) -> Column:
        return F.when(x.rlike(r"^\s*@?\d+\s*$"), F.regexp_replace(x, r"@?(\d+)", F.concat(ident, F.lit("@$1")))).otherwise(x)

    def shown(x: Column) -> Column:
        inner = F.substring(x.group, F.lit(2), F.char_length(x.group) - 2)
        ident = F.regexp_extract(inner, r"(?i)^\s*([0-9a-f]{6,40})@\d+", 1)
        items = F.split(inner, ",")
        full = F.concat(F.slice(items, 1, 1), F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda i: item(i, ident)))
        return F.concat(x.gap, F.coalesce(F.when(ident != "", F.concat(F.lit("["), F.array_join(full, ","), F.lit("]"))).otherwise(x.group), F.lit("")))

    return F.array_join(F.transform(parts, shown), "")


def tidy_citations(line: Column) -> Column:
    """A line of which citations were taken out: no stray commas, no empty brackets, no double blanks, no blank end."""
    for pattern, put in ((r"\s*,(?:\s*,)+", ","), (r"\[\s*,\s*", "["), (r"\s*,\s*\]", "]"), (r"\[\s*\]", ""), (r"[ \t]{2,}", " "), (r"\s+\z", "")):
        line = F.regexp_replace(line, pattern, put)
    return line


def model_class(name: Column, classes: tuple[str, ...], dearest: str) -> Column:
    """The first of the classes that the name holds; a name that holds none counts as the dearest."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(c)), c) for c in classes], F.lit(dearest))
