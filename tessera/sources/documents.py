"""JSON documents, JavaScript envelopes, override files, sectioned sheets and CSV matrices."""

from __future__ import annotations

import csv
import io
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.text import clean, source_type
from ..operators.tables import best_by_base, normalized
from .charsets import decoded
from .html_tables import best_html_table
from .pdf import pdf_tables
from .workbooks import best_sheet, cells_of_files


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def js_envelope(spark: SparkSession, path: str, schema: str, name: str = "window.PORTAL_DATA") -> DataFrame:
    """The JSON document that a script assigns to a global."""
    body = F.regexp_replace(F.regexp_replace("value", rf"(?s)^\s*{name.replace('.', '[.]')}\s*=\s*", ""), r";\s*$", "")
    return whole_text(spark, path).select(F.from_json(body, schema).alias("doc")).select("doc.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_fields(column: str, schema: str) -> Column:
    """A JSON text's fields, as a struct."""
    return F.from_json(column, schema)


def listed(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not blank."""
    return rows.withColumn(key, clean(key)).filter(F.col(key) != "")


def overrides(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """key, field, value; the document may wrap its map in ``overrides``. Unknown fields are dropped."""
    kind = "map<string,map<string,string>>"
    text = whole_text(spark, path)
    wrapped = F.from_json("value", f"overrides {kind}")["overrides"]
    doc = text.select(F.coalesce(wrapped, F.from_json("value", kind)).alias("doc"))
    return doc.select(F.explode("doc").alias("key", "values")).select("key", F.explode("values").alias("field", "value")).filter(F.col("field").isin(fields))


def template_types(spark: SparkSession, path: str) -> DataFrame:
    """name, type pairs written as ``abbr: "..." ... type: "..."`` in a page's script."""
    found = F.regexp_extract_all("value", F.lit(r"""(?s)\b(?:abbr|name)\s*:\s*["']([^"']+)["'][^{}]*?\btype\s*:\s*["']([^"']+)["']"""), F.lit(1))
    kinds = F.regexp_extract_all("value", F.lit(r"""(?s)\b(?:abbr|name)\s*:\s*["']([^"']+)["'][^{}]*?\btype\s*:\s*["']([^"']+)["']"""), F.lit(2))
    return whole_text(spark, path).select(F.explode(F.arrays_zip(found.alias("name"), kinds.alias("type"))).alias("x")).select("x.name", "x.type")


def sections(rows: DataFrame, labels: dict[str, str], scalars: dict[str, str], key: str = "sheet", order: str = "row_idx", named: bool = False) -> DataFrame:
    """key, field, value from two-column sheets (left, right): labels open a section, scalar labels close it.

    A section's texts join in order, each once. ``named``: sheets stand for entities by name, and of repeated names
    the last sheet (by ``sheet_idx``) counts.
    """
    if named:
        last = rows.groupBy(clean(key).alias(key)).agg(F.max("sheet_idx").alias("sheet_idx"))
        rows = rows.withColumn(key, clean(key)).join(last, [key, "sheet_idx"], "left_semi")
    left, right = clean("left"), clean("right")
    field = lambda names: F.coalesce(*(F.when(left == k, F.lit(v)) for k, v in names.items()), F.lit(None).cast("string"))
    marked = rows.withColumn("_open", field(labels)).withColumn("_scalar", field(scalars))
    mark = F.when(F.col("_open").isNotNull(), F.col("_open")).when(F.col("_scalar").isNotNull(), F.lit(""))
    w = W.partitionBy(key).orderBy(order)
    marked = marked.withColumn("_section", F.last(mark, ignorenulls=True).over(w))
    scalar = marked.filter("_scalar is not null").select(key, F.col("_scalar").alias("field"), right.alias("value"))
    body = marked.filter("_open is null and _scalar is null and coalesce(_section, '') <> ''")
    texts = body.select(key, F.col("_section").alias("field"), order, F.coalesce(F.nullif(left, F.lit("")), right).alias("value")).filter("value <> ''")
    first = texts.groupBy(key, "field", "value").agg(F.min(order).alias("at"))
    joined = first.groupBy(key, "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "; ").alias("value"))
    return scalar.unionByName(joined)


def csv_rows(content: Column, encoding: Column) -> Column:
    """A CSV file's rows as texts; its delimiter is the commonest of ``;``, tab and comma in its first line."""

    def rows(t: str) -> list[list[str]]:
        first = t.lstrip("\r\n").split("\n", 1)[0]
        return list(csv.reader(io.StringIO(t), delimiter=max(";\t,", key=first.count)))

    @F.arrow_udf("array<array<string>>")
    def run(files: pa.Array) -> pa.Array:
        return mapped(rows, pa.list_(pa.list_(pa.string())), files)

    return run(decoded(content, encoding))


def csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """path, row_idx, cells of every CSV file below the path; a task holds one file, and each has its own delimiter."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(csv_rows(F.col("content"), F.lit("utf-8"))).alias("row_idx", "cells"))


def landed_tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, source_type, columns, rows of the best table of every landed source. pages: key, url, content_type, encoding, content.

    HTML pages, workbooks, CSV and PDF files go their own ways and meet again; other types have no table.
    """
    typed = pages.withColumn("source_type", source_type(F.col("url"), F.col("content_type")))
    of = lambda kind: typed.filter(F.col("source_type") == kind)
    html = best_html_table(of("html").select(key, decoded(F.col("content"), F.col("encoding")).alias("html")), key)
    excel = best_sheet(cells_of_files(of("excel").select(F.col(key).cast("string").alias("path"), "content")))
    excel = excel.select(F.col("path").cast(pages.schema[key].dataType).alias(key), "columns", "rows")
    matrices = of("csv").select(key, F.lit(0).alias("table_idx"), csv_rows(F.col("content"), F.col("encoding")).alias("matrix"))
    csvs = best_by_base(normalized(matrices), [key], ["table_idx"])
    ways = (("html", html), ("excel", excel), ("csv", csvs), ("pdf", pdf_tables(of("pdf"), key)))
    return reduce(DataFrame.unionByName, [df.select(key, F.lit(kind).alias("source_type"), "columns", "rows") for kind, df in ways])
