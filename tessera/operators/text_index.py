"""Substring search by trigrams: an index in slots of keys, kept as tables that Spark prunes and pushes filters into.

``rows``     slot, key, texts (lower-cased, an array in the order of the fields): the indexed texts, partitioned by slot
``grams``    slot, gram, key: every trigram of every row once, partitioned by slot, sorted by gram within its files

A search takes the needle's trigrams, reads their counts, and intersects the rarest few by one aggregation. Candidates
meet their texts by (slot, key), where dynamic partition pruning leaves out slots without candidates, and are verified:
trigrams need not stand side by side, nor in one field. Needles under three characters are in no trigram: they scan.

A refresh replaces the slots of the keys that changed and no others; each version of the index is a set of slot folders
named by a manifest that is switched last (``sources.versions``), so searches go on while it runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

SLOTS = 64
#: Trigrams of a needle that are intersected: the rarest.
RAREST = 4


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    at = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) > 2, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, 3)))).otherwise(F.array().cast("array<string>"))


def _rows(df: DataFrame, key: str, fields: list[Column | str], slots: int) -> DataFrame:
    texts = F.array(*(F.lower(F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit(""))) for f in fields))
    return df.select(F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"), F.col(key).alias("key"), texts.alias("texts"))


def _write(rows: DataFrame, path: str) -> None:
    """The two tables of these rows, a task per slot or some of them, so that each slot has few files.

    The rows are worked out and dealt out once: trigrams are those of the table that was written, slot by slot.
    """
    schema = f"key {rows.schema['key'].dataType.simpleString()}, texts array<string>, slot int"  # the folder may be empty
    rows.repartition("slot").sortWithinPartitions("slot", "key").write.partitionBy("slot").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    grams = written.select("slot", "key", F.explode(F.array_distinct(F.flatten(F.transform("texts", _grams)))).alias("gram"))
    grams.sortWithinPartitions("slot", "gram", "key").write.partitionBy("slot").parquet(f"{path}/grams")


def build(df: DataFrame, key: str, fields: list[Column | str], path: str, slots: int = SLOTS) -> None:
    """Index the fields of every row under its key (unique, not null). Texts compare in lower case; null is empty."""
    spark = df.sparkSession
    with versions.publishing(spark, path) as new:
        _write(_rows(df, key, fields, slots), new.folder)
        new.parts, new.about = {str(s): new.folder for s in range(slots)}, {"key": df.schema[key].dataType.simpleString()}


def refresh(changed: DataFrame, key: str, fields: list[Column | str], path: str, gone: DataFrame | None = None) -> None:
    """Replace the rows of ``changed`` by key, add those with new keys, and drop the keys of ``gone``.

    Slots without a changed key stay where they are; the others are written anew beside them.
    """
    spark = changed.sparkSession
    before = versions.current(spark, path)
    slots = len(before.parts)
    rows = _rows(changed, key, fields, slots)
    out = rows.select("slot", "key")
    if gone is not None:
        out = out.unionByName(gone.select(F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"), F.col(key).alias("key"))).distinct()
    touched = sorted(r["slot"] for r in out.select("slot").distinct().collect())  # numbers of slots
    if not touched:
        return
    kept = _read(spark, before, "rows", touched).join(out, ["slot", "key"], "left_anti")
    with versions.publishing(spark, path) as new:
        _write(kept.select("slot", "key", "texts").unionByName(rows), new.folder)
        new.parts, new.about = before.parts | {str(s): new.folder for s in touched}, before.about


def _read(spark: SparkSession, version: versions.Version, name: str, slots: list[int] | None = None) -> DataFrame:
    """A table of the index: of each folder that the version names, the slots that count from there."""
    by_folder: dict[str, list[int]] = {}
    for slot, folder in version.parts.items():
        if slots is None or int(slot) in slots:
            by_folder.setdefault(folder, []).append(int(slot))
    schema = f"key {version.about['key']}, {'texts array<string>' if name == 'rows' else 'gram string'}, slot int"  # a folder may be empty
    found = [spark.read.schema(schema).parquet(f"{folder}/{name}").filter(F.col("slot").isin(own)) for folder, own in sorted(by_folder.items())]
    return reduce(DataFrame.unionByName, found)


def search(spark: SparkSession, path: str, needle: str, rarest: int = RAREST) -> DataFrame:
    """key of the rows of which a field holds the needle, in any case."""
    version = versions.current(spark, path)
    needle = needle.lower()
    rows = _read(spark, version, "rows")
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    holds = F.exists("texts", lambda t: F.contains(t, F.lit(needle)))
    if not wanted:
        return rows.filter(holds).select("key")
    grams = _read(spark, version, "grams")
    counts = {r["gram"]: r["n"] for r in grams.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row per trigram of the needle
    if len(counts) < len(wanted):
        return rows.filter(F.lit(False)).select("key")
    few = sorted(wanted, key=lambda g: (counts[g], g))[:rarest]
    met = grams.filter(F.col("gram").isin(few)).groupBy("slot", "key").agg(F.count("*").alias("n")).filter(F.col("n") == len(few)).select("slot", "key")
    return rows.join(met, ["slot", "key"], "left_semi").filter(holds).select("key")
