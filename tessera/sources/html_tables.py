"""Tables and links of landed HTML pages, as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import batches as batching
from ..functions.text import recover
from ..operators.tables import best_table, normalized

#: What marks a cell as hidden, a link as a download; tables and links of a page at most.
HIDDEN = {"hide", "sr-only", "visually-hidden"}
HIDDEN_INSIDE = HIDDEN | {"element-invisible"}
DOWNLOAD_WORDS = ["вакант", "vacant", "vakant", "budget", "перевод"]
MAX_TABLES, MAX_LINKS = 40, 10


def clean(t: str | None) -> str:
    return " ".join((t or "").replace("\xa0", " ").split())


class Tables(HTMLParser):
    """Collects each table's own rows; a nested table is a table of its own, and its text counts in the outer cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
            self.open.append({"table": len(self.tables) - 1, "cell": None, "hidden": 0})
            return
        if not self.open:
            return
        top = self.open[-1]
        if tag == "tr":
            top["cell"] = None
            self.tables[top["table"]].append([])
        elif tag in ("td", "th") and self.tables[top["table"]]:
            style = (a.get("style") or "").lower().replace(" ", "")
            gone = bool(HIDDEN & set((a.get("class") or "").split())) or "display:none" in style or "visibility:hidden" in style
            span = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1
            top["cell"] = {"text": [], "hidden": [], "alt": "", "label": a.get("aria-label") or "", "gone": gone, "cols": span("colspan"), "rows": span("rowspan")}
            top["hidden"] = 0
            self.tables[top["table"]][-1].append(top["cell"])
        elif top["cell"] is not None:
            if tag == "img":
                top["cell"]["alt"] = top["cell"]["alt"] or a.get("alt") or a.get("title") or ""
            elif top["hidden"] or HIDDEN_INSIDE & set((a.get("class") or "").split()):
                top["hidden"] += tag not in ("br", "img", "input", "hr", "wbr")

    def handle_endtag(self, tag):
        if not self.open:
            return
        top = self.open[-1]
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "th", "tr"):
            top["cell"] = None
        elif top["hidden"]:
            top["hidden"] -= 1

    def handle_data(self, data):
        for level in self.open:
            if level["cell"] is not None:
                level["cell"]["hidden" if level["hidden"] else "text"].append(data)


def cell_text(cell: dict) -> str:
    return clean(" ".join(cell["text"])) or clean(cell["alt"]) or clean(cell["label"]) or clean(" ".join(cell["hidden"]))


def grid(rows: list[list[dict]]) -> list[list[str]]:
    """Cells placed on a grid: each takes the first free place of its row and fills its span downwards and sideways."""
    taken: dict[tuple[int, int], str] = {}
    width = [0] * len(rows)
    for y, cells in enumerate(rows):
        x = 0
        for c in cells:
            if c["gone"]:
                continue
            while (y, x) in taken:
                x += 1
            text = recover(cell_text(c))
            for down in range(y, min(y + c["rows"], len(rows))):
                for across in range(x, x + c["cols"]):
                    taken.setdefault((down, across), text)
                width[down] = max(width[down], x + c["cols"])
            x += c["cols"]
    return [[taken.get((y, x), "") for x in range(w)] for y, w in enumerate(width) if rows[y]]


def page_matrices(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = MAX_TABLES) -> DataFrame:
    """key, table_idx, n_tables (on the page), matrix of the first ``most`` tables of each page. Python parses tags only."""

    kind = T.StructType([pages.schema[key], *T.StructType.fromDDL("table_idx int, n_tables int, matrix array<array<string>>")])
    arrow = to_arrow_schema(kind)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, text in batching.rows_of(batches):
            parser = Tables()
            parser.feed(text or "")
            parser.close()
            for i, rows in enumerate(parser.tables[:most]):
                yield k, i, len(parser.tables), grid(rows)

    cells = lambda row: sum(map(len, row[3])) + 1
    some = pages.filter(F.contains(F.lower(html), F.lit("<table")))
    return some.select(key, html).mapInArrow(lambda batches: batching.batches_of(found(batches), arrow, cells), kind)


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = MAX_TABLES) -> DataFrame:
    """key, table_idx, n_tables, columns, rows of the first ``most`` tables of each page that have two rows or more."""
    return normalized(page_matrices(pages, key, html, most))


def best_html_table(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = MAX_TABLES) -> DataFrame:
    """Each page's table of the highest score that is no layout, the first of equals."""
    return best_table(html_tables(pages, key, html, most), [key], ["table_idx"])


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, place, href (as written), text of every anchor."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(0))
    rows = pages.select(key, url, F.posexplode(found).alias("place", "tag"))
    href = F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("tag", r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    return rows.select(key, url, "place", href.alias("href"), text.alias("text"))


def absolute(base, href):
    """Links resolved against their page's address (vectorised; Spark has no such function)."""

    @F.pandas_udf("string")
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([urljoin(x or "", y or "") for x, y in zip(b, h, strict=True)])

    return run(base, href)


def with_absolute(rows: DataFrame, base: str, href: str, name: str) -> DataFrame:
    """The rows with resolved links. Only relative paths go to Python: whole links, paths from the root and fragments don't.

    Root paths with dot segments are relative ones too.
    """
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    whole = F.col(href).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col(href).rlike(r"^https?:(?!//)")
    rooted = F.col(href).rlike(r"^/(?!/)") & ~F.col(href).rlike(r"(^|/)\.\.?(/|[?#]|$)") & (root != "")
    easy = F.when(F.col(href) == "", F.col(base)).when(whole, F.col(href)).when(rooted, F.concat(root, href)).when(F.col(href).rlike("^#."), F.concat(F.regexp_replace(base, "#.*$", ""), href))
    return rows.withColumn("_easy", easy).withColumn(name, F.coalesce("_easy", absolute(F.when(F.col("_easy").isNull(), F.col(base)), F.when(F.col("_easy").isNull(), F.col(href))))).drop("_easy")


def download_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", words: list[str] = DOWNLOAD_WORDS) -> DataFrame:
    """key, link, score of each page's 10 best downloads: +2 for a file's suffix, +4 for each word; first seen wins ties."""
    rows = with_absolute(links(pages, key, url, html), url, "href", "link")
    blob = F.lower(F.concat_ws(" ", "text", "link"))
    file = F.regexp_replace("link", r"[?#].*$", "").rlike(r"(?i)\.(pdf|xlsx?|csv)$")
    points = F.when(file, 2.0).otherwise(0.0)
    for w in words:
        points = points + F.when(F.contains(blob, F.lit(w)), 4.0).otherwise(0.0)
    best = rows.withColumn("score", points).filter("score > 0").groupBy(key, "link").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "place"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= MAX_LINKS).select(key, "link", "score", "rank")
