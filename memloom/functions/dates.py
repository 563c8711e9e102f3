"""Anchor dates and relative time expressions, resolved in one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months by name (full, three letters, sept), weekdays from Monday = 0, small numbers in words.
MONTHS = {name: i + 1 for i, name in enumerate("january february march april may june july august september october november december".split())}
MONTHS |= {name[:3]: i for name, i in list(MONTHS.items())} | {"sept": 9}
WEEKDAYS = {name: i for i, name in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
NUMBERS = {name: i + 1 for i, name in enumerate("one two three four five six seven".split())}

_NUMBER = r"(\d+|one|two|three|four|five|six|seven)"
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def _lookup(values: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(key))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has no such day."""
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_anchor(anchor: Column) -> Column:
    """First ISO date, else day month year, else month day year; null if there is none or no such day.

    A month name that is unknown lets the next form try. Days that the calendar lacks give null rather than an error.
    """
    iso = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    dmy = r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s*,?\s*(\d{4})\b"
    mdy = r"\b([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s*(\d{4})\b"
    g = lambda p, i: F.regexp_extract(anchor, p, i)
    by_dmy, by_mdy = _lookup(MONTHS, g(dmy, 2)), _lookup(MONTHS, g(mdy, 1))
    return (
        F.when(anchor.rlike(iso), _date(g(iso, 1), g(iso, 2), g(iso, 3)))
        .when(anchor.rlike(dmy) & by_dmy.isNotNull(), _date(g(dmy, 3), by_dmy, g(dmy, 1)))
        .when(anchor.rlike(mdy) & by_mdy.isNotNull(), _date(g(mdy, 3), by_mdy, g(mdy, 2)))
    )


def resolve_relative(text: Column, anchor: Column) -> Column:
    """struct(value, kind, start_date, end_date) of the first rule that matches; null if none does or there is no anchor.

    Rules in order: yesterday, today, tomorrow; N days ago; last week; last weekend, N weekends ago; last or next
    weekday (never the anchor itself); last or next month; this month.
    """
    # bound once in a lambda: generated code for all rules would be too long for one method
    bound = F.array(F.struct(F.trim(F.coalesce(text, F.lit(""))).alias("t"), anchor.alias("a")))
    return F.get(F.transform(bound, lambda x: _resolve(x["t"], x["a"])), F.lit(0))


def _resolve(t: Column, anchor: Column) -> Column:
    simple, ago = r"(?i)\b(yesterday|today|tomorrow)\b", rf"(?i)\b{_NUMBER}\s+days?\s+ago\b"
    week, weekend = r"(?i)\blast\s+week\b", rf"(?i)\b(?:last\s+weekend|{_NUMBER}\s+weekends?\s+ago)\b"
    day, month, this = rf"(?i)\b(last|next)\s+({_DAYS})\b", r"(?i)\b(last|next)\s+month\b", r"(?i)\bthis\s+month\b"
    word = lambda p, i: F.lower(F.regexp_extract(t, p, i))
    number = lambda p: F.coalesce(_lookup(NUMBERS, word(p, 1)), word(p, 1).try_cast("int"))
    monday = F.date_sub(anchor, F.weekday(anchor))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")

    def one(d):
        return F.struct(iso(d).alias("value"), F.lit("date").alias("kind"), d.alias("start_date"), d.alias("end_date"))

    def span(a, b):
        return F.struct(F.concat(iso(a), F.lit(" to "), iso(b)).alias("value"), F.lit("date_range").alias("kind"), a.alias("start_date"), b.alias("end_date"))

    def whole_month(d):
        return F.struct(F.date_format(d, "yyyy-MM").alias("value"), F.lit("month").alias("kind"), F.trunc(d, "MM").alias("start_date"), F.last_day(d).alias("end_date"))

    shift = F.when(word(simple, 1) == "yesterday", -1).when(word(simple, 1) == "tomorrow", 1).otherwise(0)
    back = F.coalesce(F.nullif(number(weekend), F.lit(0)), F.lit(1))
    saturday = F.date_sub(monday, 2 + 7 * (back - 1))
    target = _lookup(WEEKDAYS, word(day, 2))
    gap = lambda n: F.when(F.pmod(n, F.lit(7)) == 0, 7).otherwise(F.pmod(n, F.lit(7)))
    weekday = F.when(word(day, 1) == "last", F.date_sub(anchor, gap(F.weekday(anchor) - target))).otherwise(F.date_add(anchor, gap(target - F.weekday(anchor))))
    turn = F.add_months(anchor, F.when(word(month, 1) == "next", 1).otherwise(-1))
    return (
        F.when(anchor.isNull(), None)
        .when(t.rlike(simple), one(F.date_add(anchor, shift)))
        .when(t.rlike(ago), one(F.date_sub(anchor, number(ago))))
        .when(t.rlike(week), span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(t.rlike(weekend), span(saturday, F.date_add(saturday, 1)))
        .when(t.rlike(day), one(weekday))
        .when(t.rlike(month), whole_month(turn))
        .when(t.rlike(this), whole_month(anchor))
    )


def resolved_value(text: Column, anchor_text: Column) -> Column:
    return F.coalesce(resolve_relative(text, parse_anchor(anchor_text))["value"], F.lit(""))
