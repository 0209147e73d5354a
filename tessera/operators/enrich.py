"""Enrichment joins: precedence, overrides, upserts, patches, fallbacks, misses. All are equi-joins on the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import season_split
from ..functions.numbers import digits_sum
from ..functions.text import append_text, clean, flag


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in columns), F.lit(""))


def look_up(base: DataFrame, other: DataFrame, key: str, other_key: str, values: dict[str, tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Left join that adds columns (name -> the other side's column and its default), and ``keep`` as they are.

    The other side's key should be unique; a default stands for missing and for empty values.
    """
    keep = keep or []
    names = {c: f"_{i}" for i, c in enumerate(dict.fromkeys([c for c, _ in values.values()] + keep))}
    side = other.select(F.col(other_key).alias("_key"), *(F.col(c).alias(n) for c, n in names.items()))
    joined = base.join(side, base[key] == side["_key"], "left")
    return joined.select(*base.columns, *(first_text(F.col(names[c]), F.lit(default)).alias(n) for n, (c, default) in values.items()), *(F.col(names[c]).alias(c) for c in keep))


def last_known(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """The column's gaps filled with the last value before them."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def argmax_first(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """One row per key: the highest score, the first of equals."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), *order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` replaced whole where ``changes`` has their key; rows of new keys come in."""
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def update(base: DataFrame, changes: DataFrame, key: str, columns: list[str], ignore_empty: bool = False) -> DataFrame:
    """Columns updated where the key matches, with ``changed`` (how many differ). Unmatched rows stay as they are."""
    new = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(new, base[key] == new["_key"], "left")
    value = {}
    for c in columns:
        given = F.col("_hit") & (first_text(F.col(f"_{c}")) != "" if ignore_empty else F.lit(True))
        value[c] = F.when(F.coalesce(given, F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c))
    changed = sum((F.when(~value[c].eqNullSafe(F.col(c)), 1).otherwise(0) for c in columns), F.lit(0))
    return joined.select(*(value.get(c, F.col(c)).alias(c) for c in base.columns), changed.alias("changed"))


#: Up to so many overridden keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def override(base: DataFrame, overrides: DataFrame, fields: list[str], id_key: str = "id", name_key: str = "name") -> DataFrame:
    """Overrides (key, field, value) by id or else, as a whole, by name; only known fields, only non-empty values.

    The overrides are gathered once; a row may have two keys, so it joins the same side by each of them.
    """
    good = F.when(F.col("field").isin(fields) & (clean("value") != ""), F.struct("field", clean("value").alias("value")))
    sides = overrides.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(good)).alias("_values"))
    if sides.count() <= BROADCAST_ROWS:
        sides = F.broadcast(sides)
    out = base
    for name, key in (("_by_id", id_key), ("_by_name", name_key)):
        side = sides.select(F.col("_key").alias(f"{name}_key"), F.col("_values").alias(name))
        out = out.join(side, out[key].cast("string") == side[f"{name}_key"], "left").drop(f"{name}_key")
    values = F.coalesce("_by_id", "_by_name")
    columns = []
    for c in base.columns:
        given = F.try_element_at(values, F.lit(c))
        given = flag(given) if c == "dorm" else given
        columns.append(F.coalesce(given, F.col(c)).alias(c) if c in fields else F.col(c))
    return out.select(*columns)


def with_fallback(base: DataFrame, fallback: DataFrame, key: str, needs: Column, columns: list[str]) -> DataFrame:
    """Columns from the fallback where ``needs`` holds and the fallback has the key; ``is_manual_fallback`` says so."""
    other = fallback.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(other, base[key] == other["_key"], "left")
    use = F.coalesce(needs & F.col("_hit"), F.lit(False))
    return joined.select(*(F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns), use.alias("is_manual_fallback"))


def misses(targets: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return targets.join(known, key, "left_anti")


def status(reported: Column, n_rows: Column) -> Column:
    """The reported status, else ok where there are rows; ok without rows is an error."""
    s = F.coalesce(F.nullif(clean(reported), F.lit("")), F.when(n_rows > 0, F.lit("ok")).otherwise(F.lit("error")))
    return F.when((s == "ok") & (n_rows == 0), F.lit("error")).otherwise(s)


def status_counts(df: DataFrame, column: str = "status", rows: str | None = None) -> DataFrame:
    s = F.col(column)
    loaded = (s == "ok") & (F.col(rows) > 0) if rows else s == "ok"
    out = [F.count("*").alias("total"), F.count_if(loaded).alias("loaded"), F.count_if(s == "partial").alias("partial"), F.count_if(s == "error").alias("errors")]
    return df.agg(*out, *([F.coalesce(F.sum(rows), F.lit(0)).alias("total_rows")] if rows else []))


def portal_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """The rows with eight typed fields in place of their cells; short rows are padded, empty ones go."""
    padded = F.slice(F.concat(F.transform(cells, clean), F.array_repeat(F.lit(""), 8)), 1, 8)
    names = ["code", "dir", "program", "level", "course", "form", "budget", "paid"]
    at = {n: F.get(padded, F.lit(i)) for i, n in enumerate(names)}
    digits = F.regexp_extract(at["course"], r"\d+", 0)
    at["course"] = F.when(digits != "", digits.try_cast("long").cast("string")).otherwise(at["course"])
    at |= {n: digits_sum(at[n]) for n in ("budget", "paid")}
    out = rows.select(*(c for c in rows.columns if c != cells), *(c.alias(n) for n, c in at.items()))
    return out.filter((F.concat(*names[:6]) != "") | (F.col("budget") != 0) | (F.col("paid") != 0))


def sources_by_id(base: DataFrame, replaced: DataFrame, key: str, column: str) -> DataFrame:
    """A source's address replaced where a list of corrections (key, column) has the id."""
    return update(base, replaced.select(key, column), key, [column], ignore_empty=True).drop("changed")


#: Fixed value: what is said of a source that reports rows but has none.
NO_ROWS = "Таблица извлечена без пригодных строк."


def refresh(unis: DataFrame, rows: DataFrame, fresh: DataFrame, fresh_rows: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, their rows, stats) after a refresh: entities that the fresh results name take status, message, source, rows.

    unis: id, abbr, vacancyStatus, vacancyMessage, vacancySource, vacancyRowCount, vacPubSummer, vacPubWinter and more.
    rows: id and eight fields. fresh: name, status, message, source. fresh_rows: name, cells. overrides: key, field, value.
    Stats count all entities and all rows, refreshed or not; only the two publication fields are overridden, by id.
    """
    new = last_wins(fresh.withColumn("name", clean("name")), ["name"], ["ord"])
    typed = portal_rows(fresh_rows.withColumn("name", clean("name")))
    counts = typed.groupBy("name").agg(F.count("*").alias("_n"))
    new = new.join(counts, "name", "left").select(F.col("name").alias("_name"), first_text(F.col("status"), F.lit("error")).alias("_status"), clean("message").alias("_message"), clean("source").alias("_source"), F.coalesce("_n", F.lit(0)).alias("_n"))
    joined = unis.join(new, unis["abbr"] == new["_name"], "left")
    hit, empty = F.col("_name").isNotNull(), (F.col("_status") == "ok") & (F.col("_n") == 0)
    value = {
        "vacancyStatus": F.when(empty, F.lit("error")).otherwise(F.col("_status")),
        "vacancyMessage": F.when(empty, F.lit(NO_ROWS)).otherwise(F.col("_message")),
        "vacancySource": F.col("_source"),
        "vacancyRowCount": F.col("_n").cast("int"),
    }
    done = joined.select(*(F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in unis.columns), hit.alias("_hit"))
    kept = rows.join(done.filter("_hit").select("id"), "id", "left_anti")
    moved = typed.join(done.filter("_hit").select("id", F.col("abbr").alias("name")), "name").drop("name")
    all_rows = kept.unionByName(moved)
    stats = status_counts(done, "vacancyStatus", "vacancyRowCount").drop("partial", "total_rows").crossJoin(all_rows.agg(F.count("*").alias("total_rows")))  # one row by one row
    return override(done.drop("_hit"), overrides, ["vacPubSummer", "vacPubWinter"], name_key="id"), all_rows, stats


#: What stands where a source gives no dates.
ASK, TABLE_NOTICE = "Уточнять на официальном сайте", "Официальная таблица вакантных мест обновляется на странице вуза; отдельная дата летней публикации не указана"


def portal(dates: DataFrame, profiles: DataFrame, vacancies: DataFrame, types: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """The portal's entities from four sources by exact cleaned name, with precedence rules and overrides.

    dates: id, name, dates_raw, dates_note, source, dorm_mark, dorm_comment, ord. profiles: name, deadlines, dorm_mark,
    dorm_comment, procedure, special, documents, ord. vacancies: name, status, message, source, dorm_flag,
    dorm_details, row_count, ord. types: name, type. overrides: key, field, value.
    """
    own = lambda df, p: last_wins(df, ["name"], ["ord"]).drop("ord").select(*(F.col(c).alias(c if c == "name" else f"{p}_{c}") for c in df.columns if c != "ord"))
    base = dates.withColumn("name", clean("name"))
    joined = base.join(own(profiles, "p"), "name", "left").join(own(vacancies, "v"), "name", "left").join(types.dropDuplicates(["name"]), "name", "left")
    raw = first_text(F.col("p_deadlines"), F.col("dates_raw"))
    joined = joined.withColumn("_raw", raw).withColumn("_seasons", season_split("_raw"))
    part = lambda n: F.array_join(F.col(f"_seasons.{n}"), "; ")
    count = F.coalesce("v_row_count", F.lit(0))
    src = first_text(F.col("source"), F.col("v_source"))
    out = joined.select(
        F.coalesce(F.col("id").cast("int"), F.col("ord").cast("int")).alias("id"),
        F.col("name").alias("abbr"),
        "name",
        src.alias("src"),
        F.coalesce("type", F.lit("federal")).alias("type"),
        first_text(part("summer"), F.col("_raw"), F.lit(ASK)).alias("summer"),
        first_text(part("winter"), F.lit(ASK)).alias("winter"),
        append_text(F.col("dates_note"), part("other")).alias("notes"),
        F.coalesce(flag("p_dorm_mark"), flag("dorm_mark"), F.col("v_dorm_flag"), F.lit(False)).alias("dorm"),
        first_text(F.col("p_dorm_comment"), F.col("dorm_comment"), F.col("v_dorm_details")).alias("dormInfo"),
        clean("p_special").alias("special"),
        clean("p_procedure").alias("proc"),
        clean("p_documents").alias("docs"),
        status(F.col("v_status"), count).alias("vacancyStatus"),
        clean("v_message").alias("vacancyMessage"),
        first_text(F.col("v_source"), src).alias("vacancySource"),
        count.cast("int").alias("vacancyRowCount"),
        F.lit("").alias("vacPubSummer"),
        F.lit("").alias("vacPubWinter"),
    )
    done = override(out, overrides, fields)
    notice = (F.col("vacPubSummer") == "") & (first_text(F.col("vacancySource"), F.col("src")) != "")
    return done.withColumn("vacPubSummer", F.when(notice, F.lit(TABLE_NOTICE)).otherwise(F.col("vacPubSummer")))


def written_with_counts(df: DataFrame, write: Callable[[DataFrame], None], counts: dict[str, Column]) -> dict:
    """Write the rows and count them on the way: aggregates (name -> column) of what was written, without a second pass."""
    seen = Observation()
    write(df.observe(seen, *(c.alias(n) for n, c in counts.items())))
    return seen.get
