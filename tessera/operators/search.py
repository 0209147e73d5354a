"""Faceted search: join, text match, filters, totals, facets, collated order, limit. Every result is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import collation_key

ALL = "all"


def flatten(entities: DataFrame, rows_by_entity: DataFrame, key: str = "id", rows: str = "rows") -> DataFrame:
    """Entities with each of their rows; entities without rows vanish. ``row_ref``: a row's own, else ``row-<place>``."""
    exploded = rows_by_entity.select(F.col(key), F.posexplode(rows).alias("row_ord", "row"))
    joined = entities.join(exploded, key)
    ref = F.concat(F.lit("row-"), F.col("row_ord").cast("string"))
    names = exploded.schema["row"].dataType.names
    own = F.coalesce(F.nullif(F.trim(F.col("row.rowRef")), F.lit("")), ref) if "rowRef" in names else ref
    return joined.withColumn("row_ref", own).select(*entities.columns, "row_ord", "row_ref", *(F.col(f"row.{n}").alias(n) for n in names if n != "rowRef"))


def text_match(query: str, columns: list[Column], trim: bool = False) -> Column:
    """Case-blind substring in any of the columns. The query is trimmed only on demand; an empty one matches all."""
    needle = (query.strip() if trim else query).lower()
    if not needle:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle)) for c in columns])


def equals(column: Column, value: str | None) -> Column:
    """Equality, or everything for the sentinel ``all`` and for None."""
    return F.lit(True) if value in (None, ALL) else column == F.lit(value)


def seats(kind: str, budget: Column, paid: Column) -> Column:
    return {"budget": budget > 0, "paid": paid > 0, "any": (budget > 0) | (paid > 0)}.get(kind, F.lit(True))


def totals(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sums over all filtered rows, whatever limit is shown."""
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in columns.items()))


def facet(df: DataFrame, column: str, ordinal: str | None = None) -> DataFrame:
    """Distinct values, in first-seen order where an ordinal is given."""
    if ordinal is None:
        return df.select(F.col(column).alias("value")).distinct().orderBy(collation_key("value"), "value")
    return df.groupBy(F.col(column).alias("value")).agg(F.min(ordinal).alias("first_seen")).orderBy("first_seen")


def facet_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """facet, value, n of several facets (name -> column), in one pass over the table."""
    pairs = F.array(*(F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in columns.items()))
    return df.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def facets_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and ``values``: each group's distinct values, numbers first by value, then texts as people expect."""
    number = F.col(column).try_cast("double")
    entry = F.struct(number.isNull().alias("a"), F.coalesce(number, F.lit(0.0)).alias("b"), F.when(number.isNull(), collation_key(column)).otherwise("").alias("c"), F.col(column).alias("v"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["v"]).alias("values"))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of an id."""
    return df.filter(F.col(key) == value).limit(1)


def keep_selection(options: Column, previous: Column) -> Column:
    """The previous choice while it is still offered, else null."""
    return F.when(F.array_contains(options, previous), previous)


def active_table(columns: Column, rows: Column, standard_columns: Column, standard_rows: Column) -> Column:
    """struct(columns, rows, standardized): the standardised table unless it is empty, else the raw one."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    use = some(standard_rows) & some(standard_columns)
    return F.struct(F.when(use, standard_columns).otherwise(columns).alias("columns"), F.when(use, standard_rows).otherwise(rows).alias("rows"), use.alias("standardized"))


def max_number(row: Column) -> Column:
    """The largest number in a row's cells, 0 where there is none: a sign of places where no column is known."""
    runs = F.flatten(F.transform(row, lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))))
    return F.coalesce(F.array_max(F.transform(runs, lambda x: x.try_cast("long"))), F.lit(0))


def stored_or(stored: Column, computed: Column) -> Column:
    """A stored statistic unless it is missing or 0, else the computed one."""
    return F.coalesce(F.nullif(stored, F.lit(0)), computed)


def only(df: DataFrame, key: str, ids: list[str] | DataFrame | None) -> DataFrame:
    """Rows whose key is in an allow-list: a few ids, or a table of them (column ``key``); all where there is none."""
    if ids is None:
        return df
    return df.filter(F.col(key).isin(ids)) if isinstance(ids, list) else df.join(ids.select(key), key, "left_semi")


def batch(df: DataFrame, order: str, number: int, size: int = 3) -> DataFrame:
    """The rows of one batch (from 1) of ``size`` rows by order, found as the nth smallest keys."""
    first = df.orderBy(order).limit(number * size).select(F.col(order).alias("_first"))
    return df.join(F.broadcast(first.orderBy(F.desc("_first")).limit(size)), df[order] == F.col("_first"), "left_semi") if number > 1 else df.orderBy(order).limit(size)


def enum_rank(column: Column, order: list[str]) -> Column:
    """Place in a given order; unknown values come last."""
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def ordered(df: DataFrame, by: str, ties: list[str], numeric: bool = False, descending: bool = False) -> DataFrame:
    """Sort by value (numeric, or as people expect texts), with ordinals as ties so that the order is stable."""
    key = F.coalesce(F.col(by).try_cast("double"), F.lit(0.0)) if numeric else collation_key(by)
    return df.orderBy(key.desc() if descending else key.asc(), *ties)


def mixed_order(column: str) -> list[Column]:
    """Sort keys of a column that holds numbers and texts: numbers first, by value, then texts as people expect."""
    number = F.col(column).try_cast("double")
    return [number.asc_nulls_last(), F.when(number.isNull(), collation_key(column)).asc_nulls_first()]


def capped(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first rows of each group, with ``truncated`` and the count before the cap (``row_count``)."""
    w = W.partitionBy(*keys)
    out = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("row_count", F.count("*").over(w))
    return out.filter(F.col("rn") <= cap).withColumn("truncated", F.col("row_count") > cap)


@dataclass(frozen=True)
class Search:
    """What is asked for. ``text_columns`` are searched as they are shown, so pass label columns for coded fields."""

    text_columns: list[Column]
    query: str = ""
    filters: tuple[tuple[str, str | None], ...] = ()
    where: tuple[Column, ...] = ()
    sort: str | None = None
    numeric: bool = False
    descending: bool = False
    ties: tuple[str, ...] = ()
    limit: int | None = 1200
    trim: bool = False

    def rows(self, df: DataFrame) -> DataFrame:
        """All matching rows, in no order."""
        out = df.filter(text_match(self.query, self.text_columns, self.trim))
        for column, value in self.filters:
            out = out.filter(equals(F.col(column), value))
        for condition in self.where:
            out = out.filter(condition)
        return out

    def shown(self, df: DataFrame) -> DataFrame:
        """Matching rows in order, up to the limit (None: all)."""
        out = self.rows(df)
        if self.sort:
            out = ordered(out, self.sort, list(self.ties), self.numeric, self.descending)
        elif self.ties:
            out = out.orderBy(*self.ties)
        return out if self.limit is None else out.limit(self.limit)
