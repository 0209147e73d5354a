"""Numbers in free text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DASHES, clean, text

NUMBER = r"\d+(?:[.,]\d+)?"


def digits_sum(c: Column | str) -> Column:
    """The sum of all digit runs; one of them where all are equal; 0 where there is none (``1.5`` is 6)."""
    found = F.transform(F.regexp_extract_all(text(c), F.lit(r"\d+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(found)) == 1, F.get(found, F.lit(0))).otherwise(total)


def int_token(c: Column | str) -> Column:
    """A text that is one number, decimals cut off; else null."""
    t = F.replace(clean(c), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), F.floor(t.try_cast("double")).cast("long"))


def _tokens(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(clean(c), F.lit(pattern), F.lit(0))


def course_tokens(c: Column | str) -> Column:
    """Numbers as texts, dashes left out."""
    t = clean(c)
    found = F.transform(_tokens(c, NUMBER), lambda x: int_token(x).cast("string"))
    return F.when(t.isin("", *DASHES), F.array().cast("array<string>")).otherwise(found)


def amount_tokens(c: Column | str) -> Column:
    """Numbers, dashes as 0; none for empty texts and "нет"."""
    t = F.lower(clean(c))
    found = F.transform(_tokens(c, NUMBER + "|[-—–]"), lambda x: F.coalesce(int_token(x), F.lit(0)))
    return F.when(t.isin("", "нет", "нет данных"), F.array().cast("array<long>")).otherwise(found)


def course(c: Column | str) -> Column:
    """The first number, else the text; empty for dashes and "all courses"."""
    t = clean(c)
    low = F.lower(t)
    first = F.regexp_extract(t, r"\d+", 0)
    every = F.contains(low, F.lit("все")) & F.contains(low, F.lit("курс"))
    return F.when(t.isin(DASHES) | every, F.lit("")).when(first != "", first).otherwise(t)


def to_number(c: Column | str) -> Column:
    """A finite double, else 0."""
    x = text(c).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
