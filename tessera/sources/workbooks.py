"""XLSX workbooks as cells, with the standard library (zip and XML), and the entities that they list."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of, cell_link, clean, header
from ..operators.tables import best_by_base, normalized

CELLS = "path string, sheet string, sheet_idx int, row_idx int, col_idx int, value string, link string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, int, str, str | None]]:
    """sheet, sheet_idx, row, column, value, link of every cell that holds something."""
    book = zipfile.ZipFile(io.BytesIO(content))
    xml = lambda name: ElementTree.fromstring(book.read(name)) if name in book.namelist() else None
    joined = lambda e: "".join(t.text or "" for t in e.iter(MAIN + "t"))
    strings = xml("xl/sharedStrings.xml")
    shared = [joined(s) for s in strings.iter(MAIN + "si")] if strings is not None else []
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    for i, sheet in enumerate(xml("xl/workbook.xml").iter(MAIN + "sheet")):
        part = "xl/" + targets[sheet.get(REL + "id")].removeprefix("/xl/")
        rels = xml(part.replace("worksheets/", "worksheets/_rels/") + ".rels")
        urls = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
        root = xml(part)
        links = {h.get("ref"): urls.get(h.get(REL + "id")) for h in root.iter(MAIN + "hyperlink")}
        for c in root.iter(MAIN + "c"):
            ref, kind, v = c.get("r"), c.get("t"), c.find(MAIN + "v")
            text = joined(c) if kind == "inlineStr" else "" if v is None else shared[int(v.text)] if kind == "s" else v.text or ""
            if text or links.get(ref):
                yield sheet.get("name"), i, int(re.search(r"\d+", ref)[0]), column_number(ref), text, links.get(ref)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of every workbook below the path; a task holds one file."""

    return cells_of_files(spark.read.format("binaryFile").load(path))


def cells_of_files(files: DataFrame) -> DataFrame:
    """Every cell of landed workbooks (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in cells_of(content)], columns=[c.split()[0] for c in CELLS.split(", ")])

    return files.select("path", "content").mapInPandas(run, CELLS)


def best_sheet(cells: DataFrame, first: int = 8) -> DataFrame:
    """path, table_idx, columns, rows, score: of each workbook's first sheets the one of the highest base score."""
    matrices = sheet_matrices(cells, first).withColumnRenamed("rows", "matrix")
    return best_by_base(normalized(matrices), ["path"], ["table_idx"])


def sheet_matrices(cells: DataFrame, first: int = 8) -> DataFrame:
    """path, table_idx, rows of the first sheets, for the table operators; empty rows and cells are kept in place."""
    row = F.map_from_entries(F.collect_list(F.struct("col_idx", clean("value"))))
    by_row = cells.filter(F.col("sheet_idx") < first).groupBy("path", "sheet_idx", "row_idx").agg(row.alias("cells"), F.max("col_idx").alias("width"))
    width = F.max("width").over(W.partitionBy("path", "sheet_idx"))
    wide = by_row.withColumn("all", width).withColumn("row", F.transform(F.sequence(F.lit(1), F.col("all")), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(""))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "row"))), lambda r: r["row"])
    return wide.groupBy("path", F.col("sheet_idx").alias("table_idx")).agg(rows.alias("rows"))


#: Columns of the sheet of dates, and the words that name a column elsewhere.
DATES_SHEET = "Даты"
DATES_COLUMNS = {
    "university": 1, "years": 2, "vacancy_publication_dates": 3, "application_start_dates_raw": 4, "transfer_waves_description": 5,
    "transfer_conditions": 6, "source_reference": 7, "contacts": 8, "notes": 9, "official_vacancies_link": 10, "marker": 14,
}
LINKED = "official_vacancies_link"


def dated_entities(cells: DataFrame) -> DataFrame:
    """Entities of the sheet of dates: id is u and the row's number; unnamed and excluded (``-``) ones go."""
    c = cells.filter(F.col("sheet") == DATES_SHEET)
    at = lambda n, what: F.max(F.when(F.col("col_idx") == n, what))
    columns = [at(n, cell_link(F.col("link"), F.col("value")) if name == LINKED else clean("value")).alias(name) for name, n in DATES_COLUMNS.items()]
    out = c.filter("row_idx > 1").groupBy("path", F.col("row_idx").alias("excel_row")).agg(*columns).fillna("")
    out = out.filter("university <> '' and marker <> '-'")
    return out.select("path", F.format_string("u%03d", "excel_row").alias("id"), "excel_row", *DATES_COLUMNS)


def keyword_entities(cells: DataFrame, fields: dict[str, list[str]], name: str = "name", number: str | None = None) -> DataFrame:
    """Entities of the first sheet, whose columns are found by header words (the first that holds any).

    ``number``: the field that holds ids; where it holds none, and without it, rows with a name count from 1.
    """
    c = cells.filter("sheet_idx = 0")
    heads = c.filter("row_idx = 1").select("path", F.col("col_idx").alias("col"), header("value").alias("head"))
    found = heads.select("path", "col", F.explode(F.array_compact(F.array(*(F.when(any_of(F.col("head"), words), F.lit(f)) for f, words in fields.items())))).alias("field"))
    found = found.groupBy("path", "field").agg(F.min("col").alias("col"))
    body = c.filter("row_idx > 1").withColumn("text", F.coalesce(F.nullif(clean("value"), F.lit("")), F.col("link")))
    joined = body.join(found, (body["path"] == found["path"]) & (body["col_idx"] == found["col"])).select(body["path"], "row_idx", "field", "text")
    wide = joined.groupBy("path", "row_idx").pivot("field", list(fields)).agg(F.first("text")).fillna("", list(fields)).filter(f"`{name}` <> ''")
    order = F.row_number().over(W.partitionBy("path").orderBy("row_idx"))
    own: Column = F.coalesce(F.col(number).try_cast("int"), order) if number else order
    return wide.select("path", own.alias("id"), F.format_string("u%03d", order).alias("seq_id"), "row_idx", *fields)
