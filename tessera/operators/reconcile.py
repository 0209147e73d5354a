"""Multiset reconciliation of parsed against expected rows, with a taxonomy of mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import comparable, qa_course, qa_form, qa_level
from ..functions.numbers import digits_sum
from ..shared import cut
from .enrich import last_wins

BASE = ["code", "dir", "program", "level", "course", "form"]
FIELDS = [*BASE, "budget", "paid"]


def fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The canonical eight fields of each row."""
    return rows.select(
        *keys,
        *(comparable(c).alias(c) for c in ("code", "dir", "program")),
        qa_level("level").alias("level"),
        qa_course("course").alias("course"),
        qa_form("form").alias("form"),
        digits_sum(comparable("budget")).alias("budget"),
        digits_sum(comparable("paid")).alias("paid"),
    )


def multiset(df: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose counts differ: the columns, n_left, n_right. Empty where the multisets are equal.

    Both sides are tagged and counted in one aggregation: one shuffle, and partial counts before it.
    """
    tagged = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return tagged.groupBy(*columns).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).filter("n_left <> n_right")


def weighted(counts: DataFrame, keys: list[str], sums: list[str], weight: str = "n") -> DataFrame:
    """Sums of value times count over fewer keys."""
    return counts.groupBy(*keys).agg(*(F.sum(F.col(c) * F.col(weight)).alias(c) for c in sums))


def differing_sums(left: DataFrame, right: DataFrame, keys: list[str], column: str, left_name: str, right_name: str) -> DataFrame:
    """Keys that both sides have, with their sums, where those differ.

    Equal rows of a side are counted first (``multiset``), then weighted; both sides go through one shuffle.
    """
    tagged = multiset(left.select(*keys, column, F.lit(True).alias("_left")).unionAll(right.select(*keys, column, F.lit(False).alias("_left"))), [*keys, column, "_left"])
    sides = tagged.select(*keys, "n", F.when(F.col("_left"), F.col(column)).alias(left_name), F.when(~F.col("_left"), F.col(column)).alias(right_name))
    sums = weighted(sides, keys, [left_name, right_name])
    return sums.filter(F.col(left_name) != F.col(right_name))


def latest(register: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key in an append-only register."""
    return last_wins(register, keys, order)


def classify(parsed: DataFrame, expected: DataFrame, sources: DataFrame, key: str = "uni_id") -> DataFrame:
    """key, mismatches (sorted names; empty where the multisets are equal). sources: key, source_type."""
    empty = " and ".join(f"{c} = ''" for c in BASE) + " and budget = 0 and paid = 0"
    raw = fields(parsed, [key])
    shift = raw.groupBy(key).agg(F.avg(F.when((F.col("code") == "") & (F.col("dir") == "") & ((F.col("budget") > 0) | (F.col("paid") > 0)), 1.0).otherwise(0.0)).alias("shifted"))
    p = raw.filter(f"not ({empty})").withColumn("_p", F.lit(1)).withColumn("_e", F.lit(0))
    e = fields(expected, [key]).filter(f"not ({empty})").withColumn("_p", F.lit(0)).withColumn("_e", F.lit(1))
    full = p.unionByName(e).groupBy(key, *FIELDS).agg(F.sum("_p").alias("p"), F.sum("_e").alias("e"))
    base = full.groupBy(key, *BASE).agg(
        F.sum("p").alias("p"), F.sum("e").alias("e"), F.max("p").alias("most"), F.count_if(F.col("p") != F.col("e")).alias("unequal"),
        *(F.sum(F.col(c) * F.col(s)).alias(f"{c}_{s}") for c in ("budget", "paid") for s in ("p", "e")),
    )
    shared = (F.col("p") > 0) & (F.col("e") > 0)
    per = base.groupBy(key).agg(
        F.sum("p").alias("p"), F.sum("e").alias("e"), F.max("most").alias("most"), F.sum("unequal").alias("unequal"),
        F.count_if(F.col("p") != F.col("e")).alias("keys_differ"),
        F.count_if(shared & ((F.col("budget_p") != F.col("budget_e")) | (F.col("paid_p") != F.col("paid_e")))).alias("sums_differ"),
    )
    all_ = sources.select(key, "source_type").join(per, key, "left").join(shift, key, "left")
    test = [
        (F.col("e") > F.col("p"), "MISS_ROWS"),
        ((F.col("e") > F.col("p")) & (F.col("source_type") == "pdf"), "MISS_PAGE"),
        (F.col("p") > F.col("e"), "NOISE_ROWS"),
        (F.col("most") > 1, "DUP_ROWS"),
        (F.col("keys_differ") > 0, "WRONG_CODE_FORM_COURSE"),
        (F.col("sums_differ") > 0, "NUMERIC_MISMATCH"),
        (F.col("shifted") > 0.05, "HEADER_SHIFT"),
    ]
    names = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in test))))
    return all_.select(key, F.when(F.coalesce("unequal", F.lit(0)) > 0, names).otherwise(F.array().cast("array<string>")).alias("mismatches"))


def verdict(classified: DataFrame, sources: DataFrame, key: str = "uni_id", policy: tuple[str, ...] = ()) -> DataFrame:
    """PASS, FAIL or ERROR. sources: key, status, expected_rows. Policy ids whose source is not ok are ERROR."""
    joined = classified.join(sources.select(key, "status", "expected_rows"), key)
    broken = (F.col("status") != "ok") | (F.col("expected_rows") == 0)
    error = F.col(key).isin(*policy) & (F.col("status") != "ok") if policy else F.lit(False)
    return joined.select(
        key,
        F.when(error, F.lit("ERROR")).when(broken | (F.size("mismatches") > 0), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("verdict"),
        F.when(error, F.array(F.lit("SOURCE_UNAVAILABLE"))).when(broken, F.array(F.lit("SOURCE_PARSE_ERROR"))).otherwise(F.col("mismatches")).alias("mismatches"),
    )


def repair(parsed: DataFrame, expected: DataFrame, sources: DataFrame, checked_at: str, key: str = "uni_id", policy: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(register, rows): what fails is taken anew from its source where that could be read, and checked again.

    parsed, expected: key and the eight fields, stored and read anew. sources: key, source_type, status, expected_rows.
    The register has a row per source: both verdicts' rows, ``mismatches`` and ``verdict`` after the fix, and
    ``fix_strategy`` (empty: none). ``rows`` are the stored ones with those of fixed entities replaced whole.
    """
    first = cut(verdict(classify(parsed, expected, sources, key), sources, key, policy), "checked")
    fixed = cut(first.filter("verdict = 'FAIL'").join(sources.filter("status = 'ok'"), key, "left_semi").select(key), "fixed")
    of_fixed = lambda df: df.join(fixed, key, "left_semi")
    anew = of_fixed(expected)
    rows = parsed.join(fixed, key, "left_anti").unionByName(anew, allowMissingColumns=True)
    again = classify(anew, of_fixed(expected), of_fixed(sources), key).select(key, F.col("mismatches").alias("_again"))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    register = first.join(sources.select(key, "source_type", "expected_rows"), key).join(again, key, "left")
    for df, name in ((parsed, "parsed_rows_before"), (rows, "parsed_rows_after")):
        register = register.join(count(df, name), key, "left").fillna(0, [name])
    hit = F.col("_again").isNotNull()
    return register.select(
        key, "source_type", "parsed_rows_before", "expected_rows",
        F.when(hit, F.col("_again")).otherwise(F.col("mismatches")).alias("mismatches"),
        F.when(hit, "refresh_from_source").otherwise("").alias("fix_strategy"),
        "parsed_rows_after",
        F.when(hit & (F.size("_again") == 0), "PASS").otherwise(F.col("verdict")).alias("verdict"),
        F.lit(checked_at).alias("checked_at"),
    ), rows
