"""Dates in free text, day and month keys, spans and overlaps as Column expressions.

Dates are ISO strings, compared as text; an open end of a range is null or empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_NAME = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
# fixed forms: Y-M-D with several separators, Month D Y, D Month Y
YMD = r"(?<!\d)(\d{4})\s*[-/.\x{5e74}]\s*(\d{1,2})\s*[-/.\x{6708}]\s*(\d{1,2})(?!\d)"
MDY = rf"(?i)\b{_NAME}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)"
DMY = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?\s+{_NAME}\.?,?\s+(\d{{4}})(?!\d)"
#: Form, groups of year, month and day, and whether the month is a name.
_ORDERS = ((YMD, (1, 2, 3), False), (MDY, (3, 1, 2), True), (DMY, (3, 2, 1), True))


def _month(c: Column) -> Column:
    """The number of a month's name, which the forms have made sure of."""
    return ((F.instr(F.lit("".join(_MONTHS)), F.substring(F.lower(c), 1, 3)) + 2) / 3).cast("int").cast("string")


def valid_date(c: Column) -> Column:
    """The ISO date c holds, or null if the calendar has no such day."""
    return c.try_cast("date").cast("string")


def _dates(c: Column, pattern: str, order: tuple[int, int, int], named: bool) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    two = lambda x: F.lpad(x, 2, "0")
    iso = lambda x: valid_date(F.concat_ws("-", part(x, order[0]), two(_month(part(x, order[1])) if named else part(x, order[1])), two(part(x, order[2]))))
    return F.filter(F.transform(found, iso), lambda x: x.isNotNull())


def date_keys(c: Column) -> Column:
    """All distinct valid dates of a text, by form, then by place."""
    found = F.array_distinct(F.concat(*[_dates(c, *form) for form in _ORDERS]))
    # every form holds a year: texts without one are not searched for forms
    return F.when(c.rlike(r"\d{4}"), found).otherwise(F.array().cast("array<string>"))


def date_key(c: Column) -> Column:
    """The first valid date of a text, or null."""
    return F.get(date_keys(c), F.lit(0))


def month_key(day: Column) -> Column:
    return F.substring(day, 1, 7)


def month_end(month: Column) -> Column:
    return F.date_format(F.last_day(F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")), "yyyy-MM-dd")


def temporal_keys(*days: Column) -> Column:
    """day: and month: keys of the given days, distinct."""
    keys = [k for d in days for k in (F.concat(F.lit("day:"), d), F.concat(F.lit("month:"), month_key(d)))]
    return F.array_distinct(F.filter(F.array(*keys), lambda x: x.isNotNull()))


def key_span(key: Column) -> Column:
    """struct(start, end): a day's own date, or a month's first and last."""
    month = F.substring(key, 7, 7)
    is_day = F.startswith(key, F.lit("day:"))
    start = F.when(is_day, F.substring(key, 5, 10)).otherwise(F.concat(month, F.lit("-01")))
    return F.struct(start.alias("start"), F.when(is_day, F.substring(key, 5, 10)).otherwise(month_end(month)).alias("end"))


def _open(c: Column) -> Column:
    return c.isNull() | (c == "")


def in_range(day: Column, since: Column, until: Column) -> Column:
    return (_open(since) | (day >= since)) & (_open(until) | (day <= until))


def overlaps(start: Column, end: Column, since: Column, until: Column) -> Column:
    """Closed ranges with open ends."""
    return (_open(since) | (F.coalesce(end, start) >= since)) & (_open(until) | (F.coalesce(start, end) <= until))


def time_label(c: Column) -> Column:
    """The date in a time text, else the text without fractions of a second."""
    return F.coalesce(date_key(c), F.regexp_replace(F.trim(c), r"\.\d+(?=(?:Z|[+-]\d{2}:?\d{2})?$)", ""))


def query_label(since: Column, until: Column) -> Column:
    """How a date range reads as a query (G26); null without ends."""
    s, u = F.nullif(since, F.lit("")), F.nullif(until, F.lit(""))
    return (
        F.when(s == u, F.concat(F.lit("time = "), s)).when(s.isNotNull() & u.isNotNull(), F.concat(F.lit("time between "), s, F.lit(" and "), u))
        .when(s.isNotNull(), F.concat(F.lit("time >= "), s)).when(u.isNotNull(), F.concat(F.lit("time <= "), u))
    )


def time_basis(now: Column) -> Column:
    """What relative dates in a text are reckoned from: the day, and the time of a UTC timestamp."""
    day, time = F.date_format(now, "yyyy-MM-dd"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.lit("Current time basis (for resolving relative time expressions):\n- Current local date: "), day, F.lit("\n- Current UTC time: "), time, F.lit("+00:00\n"))


def reference_time(c: Column) -> Column:
    """A timestamp from ISO text or one of three common forms."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in forms])
