"""Standardisation of a table into eight fields: code, direction, program, level, course, form, budget, paid.

Field extraction, repairs and number parsing are Column expressions per row. Two steps depend on the order of a
table's rows: merging continuation rows and carrying fields forward. They go over a table's sorted rows one by one, in
Arrow batches, and look one row ahead at most, so a table may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numbers import amount_tokens, course, course_tokens, digits_sum
from ..functions.text import CODE, any_of, clean, is_code, is_numeric_cell, is_summary, level_from_code, split_code
from .tables import MENU_WORDS, with_roles

FIELDS = ["code", "direction", "program", "level", "course", "form", "budget", "paid"]
TEXT = ["code", "direction", "program"]


def stream(df: DataFrame, key: str, step: Callable[[Iterator[dict]], Iterator[dict]], reads: list[str], writes: list[str]) -> DataFrame:
    """``step`` over each table's rows in order; it may change the columns ``writes`` and leave rows out.

    Only the columns ``reads`` become Python values; the others pass as they are. A task holds a batch, and those of the
    rows that ``step`` has not handed on.
    """
    arrow = to_arrow_schema(df.schema)
    reads = list(dict.fromkeys([key, *reads, *writes]))

    def run(batches):
        def rows() -> Iterator[dict]:
            for n, b in enumerate(batches):
                for i, r in enumerate(b.select(reads).to_pylist()):
                    yield r | {"_batch": b, "_n": n, "_at": i}

        kept = (r for _, table in groupby(rows(), itemgetter(key)) for r in step(table))
        for _, group in groupby(kept, itemgetter("_n")):
            out = list(group)
            b = out[0]["_batch"]
            b = b.take(pa.array([r["_at"] for r in out])) if len(out) < b.num_rows else b
            for c in writes:
                b = b.set_column(b.schema.get_field_index(c), arrow.field(c), pa.array([r[c] for r in out], arrow.field(c).type))
            yield b.cast(arrow)

    return df.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(run, df.schema)


def fold(df: DataFrame, key: str, step: Callable[[list[dict]], list[dict]], reads: list[str], writes: list[str]) -> DataFrame:
    """As ``stream``, for steps that take a table's rows as a whole."""
    return stream(df, key, lambda rows: iter(step(list(rows))), reads, writes)


def merge_continuations(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows with text but neither code nor other cells go into the next row if that lacks text, else the one before."""
    before, r = None, next(rows, None)
    while r is not None:
        following = next(rows, None)
        if r["code"] or not (r["direction"] or r["program"]) or r["has_other"]:
            if before:
                yield before
            before = r
        else:
            ahead = following and following["code"] and not (following["direction"] or following["program"]) and following["has_other"]
            target = following if ahead else before
            for f in ("direction", "program") if target else ():
                if r[f]:
                    target[f] = " ".join(x for x in ((r[f], target[f]) if ahead else (target[f], r[f])) if x)
        r = following
    if before:
        yield before


def carry(rows: Iterator[dict]) -> Iterator[dict]:
    """Fill fields from the last accepted row, and the course within one code and direction.

    A row takes them only if it has a payload. Rows that turn out to be noise leave what is carried as it was, but
    for tables with course groups and rows with several courses, where it always follows.
    """
    context = dict.fromkeys(["code", "direction", "program", "level", "course"], "")
    for r in rows:
        if r["payload"] and context["direction"]:
            some = r["code"] or r["direction"] or r["program"] or r["level"]
            for f in ("code", "direction", "level") if some else ("code", "direction", "program", "level"):
                r[f] = r[f] or context[f]
        if r["program"] == r["direction"]:
            r["program"] = ""
        own = {f: r[f] for f in ("code", "direction", "program", "level")}
        if r["many"]:
            last = r["last_course"] or context["course"]
            context = own | {"course": last} if any(own.values()) else context
            yield r
            continue
        if not r["course"] and r["payload"] and context["course"] and (r["code"], r["direction"]) == (context["code"], context["direction"]):
            r["course"] = context["course"]
        kept = any(own.values()) or r["course"] or r["form"] or r["amount"]
        if kept and any(own.values()) and not noisy(r):
            context = own | {"course": r["course"]}
        yield r


#: What a text over 200 characters holds if it is a page's menu, and headings that fill whole rows.
PAGE_WORDS = ["университет:", "погода", "liveinternet", "togglehelp"]
HEADINGS = ["программы высшего образования", "программы среднего профессионального образования", "филиал "]
HEADING_STARTS = ["высшее образование", "среднее профессиональное образование"]


def noise(code: Column, direction: Column, program: Column, level: Column, course: Column, form: Column) -> Column:
    """Totals, repeated values, page menus and the like."""
    full = F.filter(F.array(code, direction, program, level, course, form), lambda x: x != "")
    low = F.transform(full, F.lower)
    same = (F.size(full) >= 2) & (F.size(F.array_distinct(low)) == 1) & ~is_code(F.get(full, F.lit(0)))
    numeric = (F.size(F.filter(full, is_numeric_cell)) >= 3) & ~is_code(code)
    odd_course = (course != "") & ~course.rlike(r"^\d+$") & (F.contains(F.lower(course), F.lit("курс")) | is_summary(course))
    text = F.lower(direction)
    hits = sum((F.contains(text, F.lit(w)).cast("int") for w in MENU_WORDS), F.lit(0))
    menu = (code == "") & (program == "") & (level == "") & (form == "") & (course == "") & (F.length(direction) > 200) & ((hits >= 3) | any_of(text, PAGE_WORDS))
    others = F.transform(F.filter(F.array(direction, program, level, form, course), lambda x: x != ""), F.lower)
    heading = lambda x: any_of(x, HEADINGS) | x.startswith(HEADING_STARTS[0]) | x.startswith(HEADING_STARTS[1])
    filled = F.exists(others, lambda x: (F.size(F.filter(others, lambda y: y == x)) >= 3) & heading(x))
    return F.exists(full, is_summary) | same | numeric | odd_course | menu | filled


def noisy(r: dict) -> bool:
    """``noise`` for one row of the carry step, on the values that are left after it."""
    import re

    full = [r[f] for f in ("code", "direction", "program", "level", "course", "form") if r[f]]
    low = [x.lower() for x in full]
    summary = lambda x: x in ("-", "—", "–") or x.startswith(("итог", "всего")) or ("все" in x and "курс" in x)
    code = lambda x: bool(re.fullmatch(CODE, x, re.ASCII))
    if any(map(summary, low)) or (len(full) >= 2 and len(set(low)) == 1 and not code(full[0])):
        return True
    if sum(bool(re.fullmatch(r"\d+(\.\d+)?", x, re.ASCII)) for x in full) >= 3 and not code(r["code"]):
        return True
    if r["course"] and not re.fullmatch(r"\d+", r["course"], re.ASCII) and "курс" in r["course"].lower():
        return True
    text = r["direction"].lower()
    if full == [r["direction"]] and len(text) > 200 and (sum(w in text for w in MENU_WORDS) >= 3 or any(w in text for w in PAGE_WORDS)):
        return True
    others = [r[f].lower() for f in ("direction", "program", "level", "form", "course") if r[f]]
    return any(others.count(x) >= 3 and (any(h in x for h in HEADINGS) or x.startswith(tuple(HEADING_STARTS))) for x in others)


def cut_rows(tables: DataFrame, cap: int | None = None) -> DataFrame:
    """The tables with ``row_count`` and ``truncated``; with at most ``cap`` rows each where the caller asks for it."""
    n = F.coalesce(F.size("rows"), F.lit(0))
    if cap is None:
        return tables.withColumn("row_count", n).withColumn("truncated", F.lit(False))
    return tables.withColumn("row_count", n).withColumn("truncated", n > cap).withColumn("rows", F.slice("rows", 1, cap))


def standardize(tables: DataFrame, key: str = "table_id") -> DataFrame:
    """key, pos, sub (place within an expanded row) and the eight fields of every kept row. tables: key, columns, rows."""
    rows = with_roles(tables.select(key, "columns", "rows")).select(key, "roles", F.posexplode("rows").alias("pos", "cells"))
    at = lambda f: clean(F.get("cells", F.col(f"roles.{f}")))
    key_places = F.array(*(F.col(f"roles.{f}") for f in TEXT))
    other = F.exists(F.transform("cells", lambda c, i: (clean(c) != "") & ~F.coalesce(F.array_contains(F.array_compact(key_places), i), F.lit(False))), lambda x: x)
    rows = rows.select(key, "pos", "roles", "cells", *(at(f).alias(f) for f in TEXT), other.alias("has_other"))
    rows = stream(rows, key, merge_continuations, ["code", "has_other"], ["direction", "program"]).drop("has_other")

    # Repairs.
    swap = (F.col("direction") == "") & (F.col("program") != "")
    rows = rows.withColumns({"direction": F.when(swap, F.col("program")).otherwise(F.col("direction")), "program": F.when(swap, F.lit("")).otherwise(F.col("program"))})
    split = split_code("code")
    rows = rows.withColumn("_split", split).withColumns(
        {
            "direction": F.when(F.col("_split").isNotNull() & ((F.col("direction") == "") | (F.col("direction") == F.col("code"))), F.col("_split.direction")).otherwise(F.col("direction")),
            "code": F.coalesce("_split.code", "code"),
        }
    )
    rows = rows.withColumn("code", F.when(is_code("code"), F.col("code")).otherwise(F.lit("")))
    for f in ("direction", "program"):
        found = F.when(F.col("code") == "", split_code(f))
        rows = rows.withColumn("_split", found).withColumns({"code": F.coalesce("_split.code", "code"), f: F.coalesce("_split.direction", f)})
    level, form, raw_course = at("level"), at("form"), F.get("cells", F.col("roles.course"))
    rows = rows.withColumn("level", F.when(level == "", level_from_code("code")).otherwise(level))
    rows = rows.withColumn("form", F.when(form == "", F.col("roles.default_form")).otherwise(form)).withColumn("course", course(raw_course))

    # Amounts, and what a row expands to.
    cell = lambda i: F.get("cells", i)
    total = lambda places: F.aggregate(F.transform(places, lambda i: digits_sum(cell(i))), F.lit(0).cast("long"), lambda a, x: a + x)
    groups = F.col("roles.groups")
    names = F.array_sort(F.array_distinct(F.transform(groups, lambda g: F.lpad(g["course"], 2, "0"))))
    of = lambda name, paid: F.transform(F.filter(groups, lambda g: (F.lpad(g["course"], 2, "0") == name) & (g["paid"] == F.lit(paid))), lambda g: g["place"])
    unpadded = lambda name: F.coalesce(F.nullif(F.regexp_replace(name, "^0", ""), F.lit("")), F.lit("0"))
    wide = F.transform(names, lambda n: F.struct(unpadded(n).alias("course"), total(of(n, False)).alias("budget"), total(of(n, True)).alias("paid")))
    tokens = course_tokens(raw_course)
    both = F.concat(F.col("roles.budget"), F.col("roles.paid"))
    sizes = F.transform(both, lambda i: F.size(amount_tokens(cell(i))))
    n = F.size(tokens)
    expand = (n >= 2) & F.exists(sizes, lambda s: s == n) & ~F.exists(sizes, lambda s: (s > 1) & (s != n))

    def share(places: Column, i: Column) -> Column:
        def value(p: Column) -> Column:
            t = amount_tokens(cell(p))
            return F.when(F.size(t) == n, F.get(t, i)).when((F.size(t) == 1) & (i == 0), F.get(t, F.lit(0))).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.transform(places, value), F.lit(0).cast("long"), lambda a, x: a + x)

    several = F.transform(tokens, lambda t, i: F.struct(t.alias("course"), share(F.col("roles.budget"), i).alias("budget"), share(F.col("roles.paid"), i).alias("paid")))
    single = F.array(F.struct(F.lit(None).cast("string").alias("course"), total(F.col("roles.budget")).alias("budget"), total(F.col("roles.paid")).alias("paid")))
    grouped = F.size(groups) > 0
    rows = rows.withColumn("parts", F.when(grouped, wide).when(expand, several).otherwise(single))
    rows = rows.withColumn("many", grouped | expand).withColumn("last_course", F.when(~grouped & expand, F.element_at(tokens, -1)).otherwise(F.lit("")))
    amount = F.exists(F.when(grouped, F.transform(groups, lambda g: digits_sum(cell(g["place"])))).otherwise(F.transform(both, lambda i: digits_sum(cell(i)))), lambda x: x > 0)
    rows = rows.withColumn("amount", amount).withColumn("payload", (F.col("course") != "") | (F.col("form") != "") | F.col("amount"))

    columns = [key, "pos", "code", "direction", "program", "level", "course", "form", "payload", "amount", "many", "last_course"]
    rows = rows.select(*columns, "parts")
    carried = stream(rows, key, carry, ["form", "payload", "amount", "many", "last_course"], ["code", "direction", "program", "level", "course"])
    out = carried.select(key, "pos", "code", "direction", "program", "level", F.col("course").alias("_own"), "form", F.posexplode("parts").alias("sub", "part"))
    out = out.withColumn("course", F.coalesce("part.course", "_own"))
    out = out.filter((F.concat("code", "direction", "program", "level", "course", "form") != "") | (F.col("part.budget") > 0) | (F.col("part.paid") > 0))
    out = out.filter(~noise(*(F.col(c) for c in ("code", "direction", "program", "level", "course", "form"))))
    return out.select(key, "pos", "sub", "code", "direction", "program", "level", "course", "form", F.col("part.budget").cast("string").alias("budget"), F.col("part.paid").cast("string").alias("paid"))
