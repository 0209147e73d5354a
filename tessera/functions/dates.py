"""Year-less date ranges in Russian free text, as Columns. Months count from 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, clean, let, text

#: Month stems in the order in which they are tried, and how a month may be written.
STEMS = [
    ("январ", 0), ("янв", 0), ("феврал", 1), ("фев", 1), ("март", 2), ("мар", 2), ("апрел", 3), ("май", 4), ("мая", 4), ("мае", 4),
    ("июн", 5), ("июл", 6), ("август", 7), ("авг", 7), ("сентябр", 8), ("сен", 8), ("октябр", 9), ("окт", 9),
    ("ноябр", 10), ("ноя", 10), ("декабр", 11), ("дек", 11),
]
MONTH = (
    r"(?:январ\S*|феврал\S*|марта?\S*|апрел\S*|мая?|июн\S*|июл\S*|августа?\S*|сентябр\S*|октябр\S*|ноябр\S*|декабр\S*"
    r"|янв|фев|мар|авг|сен|окт|ноя|дек)"
)
SUMMER_MONTHS, WINTER_MONTHS = [2, 3, 4, 5, 6, 7, 8, 9], [10, 11, 0, 1, 2, 3]
WINTER_WORDS, SUMMER_WORDS = ["янв", "фев", "дек", "зим"], ["май", "июн", "июл", "авг", "лет"]
RANGE = "struct<start_month: int, start_day: int, end_month: int, end_day: int, approx: boolean, alt_month: int, alt_start_day: int, alt_end_day: int>"


def month_index(c: Column | str) -> Column:
    """0 to 11 by the first stem that the text begins with, else -1."""
    t = F.translate(F.lower(text(c)), "ё", "е")
    number = F.create_map(*(F.lit(x) for pair in STEMS for x in pair))
    stem = F.regexp_extract(t, "^(" + "|".join(s for s, _ in STEMS) + ")", 1)
    return F.coalesce(F.try_element_at(number, stem), F.lit(-1))


def parse_range(c: Column | str) -> Column:
    """The first of eight forms that is found; null where none is."""
    return let(clean(c), _first_form)


#: How years and dashes are written, and the eight forms of a range, in the order in which they are tried.
YEAR, DASH, FLAGS = r"(?:\s+\d{4})?", r"\s*[–—\-]\s*", "(?iu)"
FORMS = [
    r"(\d{1,2})\.(\d{2})" + DASH + r"(\d{1,2})\.(\d{2})",
    rf"(\d{{1,2}})\s+({MONTH}){YEAR}{DASH}(\d{{1,2}})\s+({MONTH}){YEAR}",
    rf"(\d{{1,2}}){DASH}(\d{{1,2}})\s+({MONTH}){YEAR}",
    rf"(?:до|не\s+позднее)\s+(\d{{1,2}})\s+({MONTH}){YEAR}",
    rf"1-я\s+(?:неделя|декада)\s+({MONTH})",
    rf"({MONTH}){DASH}({MONTH})",
    rf"(?:^|[(\s])({MONTH})(?=[\s);,.]|$)",
    rf"({MONTH})\s+и\s+({MONTH})\s*\((\d{{1,2}})[–—\-](\d{{1,2}})",
]


def _first_form(t: Column) -> Column:
    def found(k: int, make, months: list[int], also=None) -> Column:
        def fields(g: Column) -> Column:
            number = lambda k: g[k - 1].try_cast("int")
            month = lambda k: month_index(g[k - 1])
            good = F.lit(True)
            for k in months:
                good = good & (month(k) >= 0)
            if also is not None:
                good = good & also(month)
            values = [x if isinstance(x, Column) else F.lit(x) for x in make(number, month)]
            return F.when(good, F.struct(*values, *[F.lit(None)] * (8 - len(values))).cast(RANGE))

        pattern = FORMS[k]
        n = re.compile(pattern).groups
        groups = F.array(*(F.regexp_extract(t, FLAGS + pattern, g + 1) for g in range(n)))
        return F.when(t.rlike(FLAGS + pattern), let(groups, fields))

    first_day = lambda n: F.when(n(1) > 21, F.lit(1)).otherwise(F.lit(15))
    first_month = lambda n, m: F.when(n(1) > 21, m(2)).otherwise((m(2) + 11) % 12)
    return F.coalesce(
        found(0, lambda n, m: (n(2) - 1, n(1), n(4) - 1, n(3), False), []),
        found(1, lambda n, m: (m(2), n(1), m(4), n(3), False), [2, 4]),
        found(2, lambda n, m: (m(3), n(1), m(3), n(2), False), [3]),
        found(3, lambda n, m: (first_month(n, m), first_day(n), m(2), n(1), True), [2]),
        found(4, lambda n, m: (m(1), 1, m(1), 10, True), [1]),
        found(5, lambda n, m: (m(1), 1, m(2), 28, True), [1, 2], lambda m: m(1) != m(2)),
        found(6, lambda n, m: (m(1), 1, m(1), 28, True), [1]),
        found(7, lambda n, m: (m(2), n(3), m(2), n(4), False, m(1), n(3), n(4)), [1, 2]),
    )


def for_wave(parsed: Column, months: list[int]) -> Column:
    """The range if it starts in one of the wave's months, else its alternate month's, else null."""
    return let(parsed, lambda p: _in_wave(p, months))


def _in_wave(parsed: Column, months: list[int]) -> Column:
    alt = F.struct(parsed["alt_month"], parsed["alt_start_day"], parsed["alt_month"], parsed["alt_end_day"], parsed["approx"], *[F.lit(None)] * 3).cast(RANGE)
    return F.when(parsed["start_month"].isin(months), parsed).when(parsed["alt_month"].isin(months), alt)


def range_texts(c: Column | str) -> Column:
    """What may hold a wave's range, in the order in which it counts: the whole text, then its chunks between semicolons."""
    chunks = F.filter(F.split(F.replace(text(c), F.lit("\u00a0"), F.lit(" ")), ";"), lambda x: F.trim(x) != "")
    return let(chunks, lambda x: F.when(F.size(x) > 1, F.concat(F.array(text(c)), x)).otherwise(F.array(text(c))))  # one chunk is the text


def parse_for_wave(c: Column | str, months: list[int]) -> Column:
    """The whole text's range, else that of its first chunk that fits the wave."""
    return F.get(F.filter(F.transform(range_texts(c), lambda x: for_wave(parse_range(x), months)), lambda r: r.isNotNull()), F.lit(0))


def is_current(start_month: Column, start_day: Column, end_month: Column, end_day: Column, month: Column, day: Column) -> Column:
    """Whether a day lies in a range that may wrap around the year's end."""
    linear = lambda m: F.when((end_month < start_month) & (m <= end_month), m + 12).otherwise(m) * 31
    now = linear(month) + day
    return (now >= linear(start_month) + F.coalesce(start_day, F.lit(1))) & (now <= linear(end_month) + F.coalesce(end_day, F.lit(28)))


def wave_order(month: Column, day: Column, months: list[int]) -> Column:
    """Sort key within a wave; months outside it come last."""
    place = F.array_position(F.array(*map(F.lit, months)), month) - 1
    return F.when(place < 0, F.lit(99)).otherwise(place) * 31 + F.coalesce(F.nullif(day, F.lit(0)), F.lit(1))


def track_position(month: Column, day: Column, months: list[int], width: float) -> Column:
    """Linear place on a track; null for months outside the wave."""
    place = F.array_position(F.array(*map(F.lit, months)), month) - 1
    step = width / len(months)
    return F.when(place >= 0, place * step + (F.coalesce(F.nullif(day, F.lit(0)), F.lit(1)) - 1) / 30 * step)


def midpoint(start_day: Column, end_day: Column) -> Column:
    return F.floor((F.coalesce(start_day, F.lit(1)) + F.coalesce(end_day, F.lit(28))) / 2 + 0.5).cast("int")


def season_split(c: Column | str) -> Column:
    """struct(winter, summer, other): chunks between semicolons; one that names both seasons goes to both."""
    t = clean(c)
    chunks = F.filter(F.transform(F.split(t, ";"), lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", "")), lambda x: x != "")
    chunks = F.when(F.lower(t).isin("", "нет данных", "не применимо"), F.array().cast("array<string>")).otherwise(chunks)
    winter, summer = (lambda x: any_of(F.lower(x), WINTER_WORDS)), (lambda x: any_of(F.lower(x), SUMMER_WORDS))
    return F.struct(
        F.filter(chunks, winter).alias("winter"),
        F.filter(chunks, summer).alias("summer"),
        F.filter(chunks, lambda x: ~winter(x) & ~summer(x)).alias("other"),
    )
