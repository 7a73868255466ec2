"""Date phrases as closed ranges of time.

A phrase is read as a row of words. Each word is looked up in one table, which gives its kinds (a unit of time, a month,
a day of the week, ...) with a number, and the kinds in their order say what the phrase names. Absolute dates are UTC;
named periods follow the zone of `now`. Going back by months or years lands on the last day of a shorter month.
"""

from __future__ import annotations

import calendar
import re
from collections import defaultdict
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

TICK = timedelta(milliseconds=1)
#: Most units that a phrase may go back, and the years that stand alone.
MOST, YEARS = 10_000, range(1970, 3000)


def _table() -> dict[str, dict[str, int]]:
    found: dict[str, dict[str, int]] = defaultdict(dict)
    hours = {"h hr hrs hour hours": 1, "d day days": 24, "w wk wks week weeks": 168}
    months = {"m mo mon month months": 1, "y yr yrs year years": 12}
    for kind, units in (("hours", hours), ("months", months)):
        for names, n in units.items():
            for name in names.split():
                found[name][kind] = n
    for kind, names in (("month", calendar.month_name), ("weekday", calendar.day_name)):
        for i, name in enumerate(names):
            for word in {name.lower(), name.lower()[:3]} - {""}:
                found[word][kind] = i
    for kind, words in {"moment": ["now"], "day": ["today", "yesterday"], "which": ["this", "last", "past"], "before": ["the", "in", "during", "on"], "after": ["ago"]}.items():
        for i, word in enumerate(words):
            found[word][kind] = i
    for i, word in enumerate(["week", "month", "year"]):
        found[word]["period"] = i
    return found


WORDS = _table()


def months_back(at: datetime, n: int) -> datetime:
    year, month = divmod(at.year * 12 + at.month - 1 - n, 12)
    return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))


def midnight(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def days(start: datetime, n: int) -> tuple[datetime, datetime]:
    return start, start + timedelta(days=n) - TICK


def months(start: datetime, n: int) -> tuple[datetime, datetime]:
    return start, months_back(start, -n) - TICK


def _back(now: datetime, n: int, hours: int, by_month: int) -> tuple[datetime, datetime] | None:
    if not 0 < n <= MOST:
        return None
    return (months_back(now, n * by_month) if by_month else now - timedelta(hours=n * hours)), now


def _period(now: datetime, which: int, period: int) -> tuple[datetime, datetime]:
    today, ago = midnight(now), min(which, 1)
    if period == 0:
        return days(today - timedelta(days=today.weekday() + 7 * ago), 7)
    long = 1 if period == 1 else 12
    first = today.replace(day=1) if period == 1 else today.replace(month=1, day=1)
    return months(months_back(first, long * ago), long)


def _month(now: datetime, month: int, year: int | None) -> tuple[datetime, datetime]:
    """The given year's, else the latest that has begun."""
    if year is not None and not 1 < year < 9999:
        return None
    first = midnight(now).replace(day=1, month=month, year=year or now.year)
    return months(first if year or first <= now else months_back(first, 12), 1)


def _weekday(now: datetime, weekday: int, which: int) -> tuple[datetime, datetime]:
    """The latest such day, today included unless the last one is asked for."""
    ago = (now.weekday() - weekday) % 7
    return days(midnight(now) - timedelta(days=7 if ago == 0 and which else ago), 1)


#: What the kinds of a phrase's words, in order, name; n is a number.
Shapes = dict[tuple[str, ...], Callable[..., tuple[datetime, datetime] | None]]
SHAPES: Shapes = {
    ("moment",): lambda now, _: (now, now),
    ("day",): lambda now, k: days(midnight(now) - timedelta(days=k), 1),
    ("n", "hours"): lambda now, n, unit: _back(now, n, unit, 0),
    ("n", "months"): lambda now, n, unit: _back(now, n, 0, unit),
    ("which", "n", "hours"): lambda now, which, n, unit: _back(now, n, unit, 0) if which else None,
    ("which", "n", "months"): lambda now, which, n, unit: _back(now, n, 0, unit) if which else None,
    ("which", "period"): _period,
    ("month",): lambda now, month: _month(now, month, None),
    ("month", "n"): _month,
    ("weekday",): lambda now, day: _weekday(now, day, 0),
    ("which", "weekday"): lambda now, which, day: _weekday(now, day, which),
}


def _absolute(text: str) -> tuple[datetime, datetime] | None:
    """A date, a month or a year as written in ISO 8601, or a moment."""
    for form, size, whole in (("%Y-%m-%d", 10, lambda at: days(at, 1)), ("%Y-%m", 7, lambda at: months(at, 1)), ("%Y", 4, lambda at: months(at, 12))):
        if len(text) == size:
            try:
                at = datetime.strptime(text, form).replace(tzinfo=UTC)
            except ValueError:
                return None
            return whole(at) if size > 4 or at.year in YEARS else None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=UTC),) * 2


def parse_when(text: str, now: datetime | None = None) -> tuple[datetime, datetime] | None:
    """First and last moment (to the millisecond) of what a phrase names, None if it names nothing."""
    now, phrase = now or datetime.now(UTC), text.strip().lower()
    if re.match(r"\d{4}(-|$)", phrase):
        return _absolute(phrase.upper())
    words = re.findall(r"\d+|[a-z]+|[^\s]", phrase)
    if words and "before" in WORDS.get(words[0], {}):
        words.pop(0)
    if words and "after" in WORDS.get(words[-1], {}):
        words.pop()
    for shape, named in SHAPES.items():
        if len(shape) == len(words):
            values = [(int(w) if w.isdigit() else None) if kind == "n" else WORDS.get(w, {}).get(kind) for kind, w in zip(shape, words)]
            if None not in values:
                return named(now, *values)
    return None
