"""Dates that are written as text: Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import MONTH_NAMES, MONTH_WORDS, SHORT_MONTHS


def normalised(raw: Column) -> Column:
    """YYYY-MM-DD from the first ten characters in year-first or day-first order with - or /; anything else stays as it is."""
    s = F.substring(F.trim(raw), 1, 10)
    year_first, day_first = r"^([^/-]{4})[/-]([^/-]*)[/-]([^/-]*)$", r"^([^/-]{2})[/-]([^/-]*)[/-]([^/-]{4})$"
    return (
        F.when((F.length(s) == 10) & s.rlike(year_first), F.regexp_replace(s, year_first, "$1-$2-$3"))
        .when((F.length(s) == 10) & s.rlike(day_first), F.regexp_replace(s, day_first, "$3-$2-$1"))
        .otherwise(s)
    )


def in_month(date: Column, saved_at: Column, month: str) -> Column:
    """Whether a record belongs to month YYYY-MM: by its date, or by when it was saved if it has none."""
    blank = F.trim(F.coalesce(date, F.lit(""))) == ""
    return F.substring(F.when(blank, F.coalesce(saved_at, F.lit(""))).otherwise(normalised(date)), 1, 7) == month


def month_label(prefix: Column) -> Column:
    """'2026-06' as 'Juni 2026'; other text unchanged."""
    number = F.substring(prefix, 6, 2).try_cast("int")
    ok = prefix.rlike(r"^\d{4}.\d{2}") & number.between(1, 12)
    name = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.when(ok, number).otherwise(1))
    return F.when(ok, F.concat(name, F.lit(" "), F.substring(prefix, 1, 4))).otherwise(prefix)


def from_ymd(ymd: Column) -> Column:
    """The date of text that begins YYYY-MM-DD, days and months beyond their end counting on; null if it is shorter or has a zero."""
    part = lambda k: F.regexp_extract(F.substring(ymd, 1, 10), r"^(\d+)-(\d+)-(\d+)$", k).try_cast("int")
    first = F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1)
    return F.when((F.length(ymd) >= 10) & (part(1) > 0) & (part(2) > 0) & (part(3) > 0), F.date_add(first, part(3) - 1))


def tick_label(ymd: Column) -> Column:
    """'5 Jan' of a day, as charts show it; other text unchanged."""
    day = from_ymd(ymd)
    return F.coalesce(F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, SHORT_MONTHS)), F.month(day))), ymd)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def expanded_year(year: Column) -> Column:
    """Two digits up to 35 are of this century, others of the last."""
    n = year.try_cast("int")
    return F.when(F.length(year) != 2, n).when(n <= 35, n + 2000).otherwise(n + 1900)


def month_number(word: Column) -> Column:
    """The month of a word by its longest known prefix among whole word, four and three letters; null if none."""
    known = F.create_map(*[F.lit(x) for n, words in MONTH_WORDS.items() for w in words for x in (w, n)])
    return let(F.substring(F.lower(word), 1, 9), lambda key: F.coalesce(*[F.try_element_at(known, k) for k in (key, F.substring(key, 1, 4), F.substring(key, 1, 3))]))


def valid_day(day: Column, month: Column, year: Column) -> Column:
    """DD/MM/YYYY of a date that exists between 2010 and 2035, else null."""

    def written(p: Column) -> Column:
        # Of these years every fourth is a leap year.
        last = F.when(p["m"] == 2, F.when(p["y"] % 4 == 0, 29).otherwise(28)).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        ok = p["y"].between(2010, 2035) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= last)
        return F.when(ok, F.concat(two(p["d"]), F.lit("/"), two(p["m"]), F.lit("/"), p["y"].cast("string")))

    return let(F.struct(day.alias("d"), month.alias("m"), year.alias("y")), written)


#: What a text has where ``fixed_digits`` changes it: a letter read for a digit beside one, or an O behind a separator.
_MISREAD = r"[0-9OoIl.,](?:(?<=\d)[OoIlSBb]|(?<=[OoIl])\d|(?<=[.,])[Oo])"


def fixed_digits(text: Column) -> Column:
    """Letters that a scanner read for digits, in numeric surroundings: O 0, I and l 1, S 5, B 8."""
    return fixed_digits_and(text, ())


def fixed_digits_and(text: Column, more: tuple[tuple[str, str], ...]) -> Column:
    """``fixed_digits``, then ``more`` rules, for such letters behind a digit.

    Most texts have none, and then no rule is tried. The long look back stands behind its letter, so that it is tried at such letters only.
    """
    # What is repaired, in order.
    rules = [
        (r"(?<=\d)[Oo]", "0"), (r"[Oo](?=\d)", "0"), (r"[Oo](?<=[.,][Oo0]{0,40}[Oo])", "0"), (r"(?<=\d)[Il](?=\d)", "1"), (r"(?<=[a-zA-Z])[Il](?=\d)", "1"),
        (r"(?<=\d)S(?=\d)", "5"), (r"(?<=\d)S(?=[.,]\d)", "5"), (r"(?<=\d)[Bb](?=[\d.,])", "8"),
    ]
    def fixed(x: Column) -> Column:
        out = x
        for pattern, to in (*rules, *more):
            out = F.regexp_replace(out, pattern, to)
        return F.when(x.rlike(_MISREAD), out).otherwise(x)

    return let(text, fixed)


def parsed(raw: Column) -> Column:
    """DD/MM/YYYY from text that starts with a date in one of five forms, or ''."""
    s = F.regexp_replace(fixed_digits(F.coalesce(raw, F.lit(""))), r"(?<=\d)\s*([/.\-_|])\s*(?=\d)", "$1")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    # Times after a date.
    clock = r"\d{1,2}[:.]\d{2}(?:[:.]\d{2})?\s*(?:\w{2,4})?\s*$"
    s = F.trim(F.regexp_replace(s, r"\s*[-–]\s*\d{1,2}:\d{2}(?::\d{2})?(?:\s*\w{2,4})?\s*$", ""))
    s = F.trim(F.regexp_replace(s, r",\s*" + clock, ""))
    s = F.trim(F.regexp_replace(s, r"(?i)\s+\d{1,2}[:.]\d{2}(?::\d{2})?\s*(?:wib|wita|wit|am|pm)?\s*$", ""))

    sep = r"[/.\-_|]"
    # Forms of dates, in order.
    forms = [
        (r"^(\d{1,2})\s+([A-Za-z]{3,})\.?\s+(\d{2,4})", 1, 2, 3, "named"), (r"^([A-Za-z]{3,})\.?\s+(\d{1,2}),?\s+(\d{2,4})", 2, 1, 3, "named"),
        (rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})", 3, 2, 1, ""), (rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{2,4}})", 1, 2, 3, "swaps"), (r"^(\d{2})(\d{2})(\d{4})$", 1, 2, 3, ""),
    ]

    def form(s: Column, pattern: str, day: int, month: int, year: int, kind: str) -> Column:
        part = lambda k: F.regexp_extract(s, pattern, k)
        d, m = part(day).try_cast("int"), month_number(part(month)) if kind == "named" else part(month).try_cast("int")
        of = lambda p: valid_day(p["d"], p["m"], p["y"])
        if kind == "swaps":
            turned = lambda p: (p["m"] > 12) & p["d"].between(1, 12)
            of = lambda p: valid_day(F.when(turned(p), p["m"]).otherwise(p["d"]), F.when(turned(p), p["d"]).otherwise(p["m"]), p["y"])
        return F.when(s.rlike(pattern), let(F.struct(d.alias("d"), m.alias("m"), let(part(year), expanded_year).alias("y")), of))

    return let(s, lambda s: F.coalesce(*[form(s, *f) for f in forms], F.lit("")))
