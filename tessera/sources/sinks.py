"""Writers: one JSON document, a JavaScript envelope, JSON lines, an append-only register.

A document of one object is one file, so its lines are written by one task; they are computed by as many tasks as the
rows have (a shuffle lies between), and sorted on disk where they are many. Results that outgrow one file belong into
JSON lines. Where readers are at work, publish a document as a version: ``versions.publish(spark, path, writer)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.crawl import dataset_stats
from . import versions


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _document(stats: DataFrame, rows: DataFrame, name: str, before: str, after: str, order: list[str]) -> DataFrame:
    """Text lines, in order, that together are ``before``, an object of the stats and the rows, and ``after``."""
    keys = [f"_k{i}" for i in range(len(order))]
    body = rows.select(F.lit(1).alias("_part"), F.to_json(F.struct("*")).alias("value"), *(F.col(o).alias(k) for o, k in zip(order, keys, strict=True)))
    none = [F.lit(None).cast(body.schema[k].dataType).alias(k) for k in keys]
    fields = F.regexp_replace(F.to_json(F.struct("*")), r"\}$", "")
    open_ = F.concat(F.lit(before), fields, F.when(F.length(fields) > 1, ",").otherwise(""), F.lit(f'"{name}":['))
    head = stats.select(F.lit(0).alias("_part"), open_.alias("value"), *none)
    foot = stats.select(F.lit(2).alias("_part"), F.lit(f"]}}{after}").alias("value"), *none)
    lines = body.union(head).union(foot).repartition(1).sortWithinPartitions("_part", *keys, "value").withColumn("_line", F.monotonically_increasing_id())
    later = (F.col("_part") == 1) & (F.col("_line") > 1)  # line 0 is the head, line 1 the first row
    return lines.select(F.when(later, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))


def document(stats: DataFrame, rows: DataFrame, name: str, path: str, order: list[str] | None = None) -> None:
    """One JSON object: the fields of ``stats`` (one row) and the rows as an array, by ``order``, then by their JSON."""
    _document(stats, rows, name, "", "", order or []).write.mode("overwrite").text(path)


def save_dataset(entities: DataFrame, path: str, fetched_at: str, order: list[str] | None = None) -> versions.Version:
    """The data set's document, its statistics counted anew, as a new version: ``entities`` may come from the current one."""
    return versions.publish(entities.sparkSession, path, lambda folder: document(dataset_stats(entities, fetched_at), entities, "universities", folder, order))


def js_envelope(stats: DataFrame, rows: DataFrame, name: str, path: str, variable: str = "window.PORTAL_DATA", order: list[str] | None = None) -> None:
    """The same object as the value of a script's global."""
    _document(stats, rows, name, f"{variable} = ", ";", order or []).write.mode("overwrite").text(path)


def append_register(df: DataFrame, path: str) -> None:
    df.select(*(F.col(c).cast("string") for c in df.columns)).write.mode("append").option("header", True).csv(path)
