"""Days, calendar periods and the dates that a question asks about."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from .text import MONTHS

RESOLUTIONS = tuple("day week month quarter year".split())
_WEEKDAYS = {d: k for k, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_DAY = "|".join(_WEEKDAYS)
_PAST = "last|past|previous|prior"


def _days(year: int, month: int) -> int:
    return monthrange(year, month)[1]


def _day(year: int, month: int, day: int) -> date:
    return date(year, month, max(1, min(day, _days(year, month))))


def parse_date_range(query: str | None, as_of: date) -> tuple[date, date] | None:
    """The window of days, both ends included, that a question names; None if it names none.

    Explicit dates come before relative ones. Questions are few and short, so this is plain
    Python on the driver; it is the one text function that isn't a Column.
    """
    q = (query or "").lower()
    for find in (_iso, _numeric, _cross_month, _named_month, _weekday, _relative):
        window = find(q, as_of)
        if window is not None:
            return window
    return None


def _iso(q: str, as_of: date):
    if m := re.search(r"(\d{4})-(\d{2})-(\d{2})", q):
        try:
            one = date(*map(int, m.groups()))
        except ValueError:
            return None
        return one, one
    if (m := re.search(r"(\d{4})-(\d{2})(?!\d)", q)) and 1 <= int(m[2]) <= 12:
        y, mo = int(m[1]), int(m[2])
        return date(y, mo, 1), date(y, mo, _days(y, mo))
    return None


def _numeric(q: str, as_of: date):
    m = re.search(r"\b(1[0-2]|0?[1-9])/(3[01]|[12]\d|0?[1-9])(?:/(\d{4}))?\b", q)
    if not m:
        return None
    one = _day(int(m[3] or as_of.year), int(m[1]), int(m[2]))
    return one, one


def _cross_month(q: str, as_of: date):
    part = rf"({_MONTH})\s+(\d{{1,2}})(?:,?\s*(\d{{4}}))?"
    m = re.search(rf"\b{part}\s*(?:through|to|–|-)\s*{part}\b", q)
    if not m:
        return None
    first, last = MONTHS[m[1]], MONTHS[m[4]]
    y1 = int(m[3] or as_of.year)
    y2 = int(m[6]) if m[6] else y1 + (last < first)
    return _day(y1, first, int(m[2])), _day(y2, last, int(m[5]))


def _named_month(q: str, as_of: date):
    m = re.search(rf"(beginning of|end of|early|late|middle|mid)?\s*({_MONTH})\b(?:\s+(\d{{1,2}})(?!\d))?(?:\s*[-–to]{{1,3}}\s*(\d{{1,2}})(?!\d))?(?:,?\s*(\d{{4}}))?", q)
    if not m:
        return None
    qualifier, name, d1, d2, year = m.groups()
    if name == "may" and not (qualifier or d1 or year):
        # the verb, unless something says it is the month
        if not re.search(r"\b(?:since|from|during|in|throughout|through)\s+may\b|\bmay\s+(?:timeline|summary|records?|notes?|updates?|changes?|incidents?|events?)\b", q):
            return None
    y, mo = int(year or as_of.year), MONTHS[name]
    if d1 and d2:
        a, b = sorted((int(d1), int(d2)))
        return _day(y, mo, a), _day(y, mo, b)
    if d1:
        one = _day(y, mo, int(d1))
        return one, one
    low, high = {"late": (21, 31), "end of": (21, 31), "early": (1, 10), "beginning of": (1, 10), "mid": (11, 20), "middle": (11, 20)}.get(qualifier, (1, 31))
    return _day(y, mo, low), _day(y, mo, high)


def _weekday(q: str, as_of: date):
    latest = lambda name: as_of - timedelta((as_of.weekday() - _WEEKDAYS[name]) % 7)
    if m := re.search(rf"\b({_DAY})\s*(?:through|thru|to|–|-)\s*({_DAY})\b", q):
        end = latest(m[2])
        return end - timedelta((_WEEKDAYS[m[2]] - _WEEKDAYS[m[1]]) % 7), end
    if m := re.search(rf"\b(?:on|last|past|previous)\s+({_DAY})\b", q):
        return latest(m[1]), latest(m[1])
    return None


def _relative(q: str, as_of: date):
    for pattern, n in ((r"\bday before yesterday\b", 2), (r"\byesterday\b", 1), (r"\btoday\b", 0)):
        if re.search(pattern, q):
            one = as_of - timedelta(n)
            return one, one
    window = lambda n: (as_of - timedelta(n), as_of)
    if m := re.search(rf"\b(?:{_PAST})\s+(\d{{1,3}})\s+(day|week|month)s?\b", q):
        each, most = {"day": (1, 90), "week": (7, 26), "month": (31, 24)}[m[2]]
        return window(max(1, min(most, int(m[1]) or 1)) * each)
    if m := re.search(r"\b(?:these past|recent|past|last)\s+(?:several|few|couple(?:\s+of)?)\s+(day|week)s\b", q):
        return window(7 if m[1] == "day" else 21)
    if m := re.search(rf"\b(?:{_PAST}|this(?:\s+past)?)\s+(week|month|quarter|year)\b", q):
        return window({"week": 7, "month": 31, "quarter": 92, "year": 365}[m[1]])
    return window(10) if re.search(r"\b(?:in recent days|of late|lately|recently)\b", q) else None


def age_days(first_seen: Column, now: Column) -> Column:
    """Whole days since, 0 for the future, null if unknown."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(first_seen.cast("timestamp"))) / 86_400_000_000)).cast("long")


_AGES = ((2, "just now"), (7, "this week"), (21, "past couple weeks"), (45, "last month or so"), (90, "a couple months ago"), (150, "earlier this period"))


def age_tag(days: Column) -> Column:
    out = F.when(days.isNull(), "undated")
    for most, tag in _AGES:
        out = out.when(days <= most, tag)
    return out.otherwise("long ago")


def period_start(resolution: str | Column, day: Column) -> Column:
    """The first day of the calendar period of ``day``; weeks begin on Monday."""
    if isinstance(resolution, str):
        return day.cast("date") if resolution == "day" else F.trunc(day.cast("date"), resolution)
    out = F.when(resolution == "day", day.cast("date"))
    for r in RESOLUTIONS[1:]:
        out = out.when(resolution == r, F.trunc(day.cast("date"), r))
    return out


def period_end(resolution: str | Column, day: Column) -> Column:
    """The last day of the period, included."""
    start = period_start(resolution, day)
    ends = {"day": start, "week": F.date_add(start, 6), "month": F.last_day(start), "quarter": F.last_day(F.add_months(start, 2)), "year": F.last_day(F.add_months(start, 11))}
    if isinstance(resolution, str):
        return ends[resolution]
    out = F.when(resolution == "day", ends["day"])
    for r in RESOLUTIONS[1:]:
        out = out.when(resolution == r, ends[r])
    return out


def resolution_for_age(days: Column) -> Column:
    """The finest period that a projection still shows at this age."""
    return F.when(days <= 14, "day").when(days <= 90, "week").when(days <= 730, "month").when(days <= 1460, "quarter").otherwise("year")


_TEXT_DATE = r"\b(20[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?)\b"


def earliest_text_date(c: Column) -> Column:
    """The earliest date (and time) of this century that a text spells out in ISO form, as a timestamp."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TEXT_DATE), F.lit(1))
    return F.array_min(F.transform(found, lambda t: F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.substring(t, 1, 10)))))


def fact_day(source_day: Column, first_seen: Column) -> Column:
    return F.coalesce(source_day.cast("date"), first_seen.cast("date"))


def in_window(day: Column, low: Column | date, high: Column | date) -> Column:
    return day.between(F.lit(low), F.lit(high))
