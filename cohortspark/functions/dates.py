"""Dates of clinical records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: What may stand beside a date: a time of day, a day of the week, words and the ends of ordinals.
_TIME = r"(?:^|[\s,t]+)(?:at\s+)?\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\.?)?(?:z|utc)?\s*$"
_AROUND = r"\b(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|sday|nesday|rsday|urday)?\b\.?|\b(?:of|on)\b|(?<=\d)(?:st|nd|rd|th)\b|,"


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date of its parts as text; null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _year(text: Column, today: Column) -> Column:
    """A year of four digits; one of two is put within fifty years of today."""
    near = text.cast("int") + F.floor(F.year(today) / 100).cast("int") * 100
    full = F.when(near >= F.year(today) + 50, near - 100).when(near < F.year(today) - 50, near + 100).otherwise(near)
    return F.when(F.length(text) == 2, full.cast("string")).otherwise(text)


def _by_pattern(text: Column, pattern: str, made) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), made(part(1), part(2), part(3)))


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3)).cast("string")


def free_date(text: Column, today: Column | None = None) -> Column:
    """A date in words or figures: 8 Oct 2025, October 8th, 2025, 08.10.25, 2025/10/18, 20251008, a time or a weekday beside it.

    The day comes first in figures, but where that gives a thirteenth month.
    Two-digit years are put within fifty years of ``today``.  Texts with parts
    missing, which would have to be filled in from the present day, and those
    with other words in them give null.
    """
    now = F.current_date() if today is None else today
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), _TIME, ""), _AROUND, " ")
    clean = F.trim(F.regexp_replace(bare, r"\s+", " "))

    def forms(t: Column) -> Column:
        def figures(d: Column, m: Column, y: Column) -> Column:
            swap = m.cast("int") > 12
            return _made(_year(y, now), F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d))

        # the day comes first after a year as well, if it can
        year_first = lambda y, a, b: F.when(b.cast("int") <= 12, _made(y, b, a)).otherwise(_made(y, a, b))
        named = lambda d, m, y: _made(_year(y, now), _month_number(m), d)
        return F.coalesce(
            _by_pattern(t, r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})$", figures),
            _by_pattern(t, r"^(\d{4})[/. ](\d{1,2})[/. ](\d{1,2})$", year_first),
            _by_pattern(t, rf"^(\d{{1,2}})[-/. ]?({_MONTH})\.?[-/. ]?(\d{{4}}|\d{{2}})$", named),
            _by_pattern(t, rf"^({_MONTH})\.?[-/. ]?(\d{{1,2}})[-/. ](\d{{4}})$", lambda m, d, y: named(d, m, y)),
            _by_pattern(t, rf"^(\d{{4}})[-/. ]?({_MONTH})\.?[-/. ]?(\d{{1,2}})$", lambda y, m, d: named(d, m, y)),
            _by_pattern(t, r"^(\d{4})(\d{2})(\d{2})$", year_first),
        )

    return F.transform(F.array(clean), forms)[0]


def clinical_date(value: Column, today: Column | None = None) -> Column:
    """Day-first d/M/yyyy or ISO y-M-d at the head of a text, or else a free form; null for what is no date."""
    text = F.trim(value.cast("string"))
    head = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/\d{4}", 0)
    day_first = F.coalesce(F.try_to_date(head, "d/M/yyyy"), F.try_to_date(head, "M/d/yyyy"))
    iso = F.try_to_date(F.regexp_extract(text, r"^\d{4}-\d{1,2}-\d{1,2}", 0), "yyyy-M-d")
    return F.coalesce(day_first, F.when(~text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}|^\d{1,2}/\d{1,2}/\d{4}"), free_date(text, today)), iso)


def relative_time(past: Column, now: Column, raw: Column | None = None) -> Column:
    """How long ago ``past`` was at ``now`` (dates): today, yesterday, days, weeks, months or years; the raw text for the future and the unreadable."""
    days = F.datediff(now, past)
    raw = past.cast("string") if raw is None else raw

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(past.isNull() | (days < 0), F.coalesce(raw, F.lit("")))
        .when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(F.floor(days / 7) < 5, ago(F.floor(days / 7), "week"))
        .when(F.floor(days / 30) < 12, ago(F.floor(days / 30), "month"))
        .otherwise(ago(F.floor(days / 365), "year"))
    )
