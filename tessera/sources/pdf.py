"""Tables of PDF files: text runs with their places are read in Python, rows and columns are found by windows.

The reader knows what text needs: objects and object streams, deflated streams, the page tree, text operators under the
current matrix, and fonts' maps to Unicode (else Windows-1252). Encrypted files, images of text and other filters give no
runs. A page is one table: runs at one height are a line, runs that touch are a cell, and cells that overlap sideways
over all lines of several cells are a column.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import batches as batching
from ..operators.tables import is_layout, merge_similar, normalized, score, settled

#: What text runs are given as, after their file's key.
RUNS = "page int, n int, x double, y double, size double, width double, text string"
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+\d?", re.S)
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|.))", re.S)
NO_FONT: tuple = (1, {}, {-1: 0.5})
PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Document:
    """The objects of a file: number -> (dictionary, stream)."""

    def __init__(self, raw: bytes) -> None:
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        for m in OBJECT.finditer(raw):
            self.objects[int(m[1])] = self._split(m[2])
        for head, body in list(self.objects.values()):
            if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
                places = [int(x) for x in body[: int(first[1])].split()]
                ends = [*places[3::2], len(body) - int(first[1])]
                for number, begin, end in zip(places[::2], places[1::2], ends, strict=False):
                    self.objects.setdefault(number, (body[int(first[1]) + begin : int(first[1]) + end], b""))

    @staticmethod
    def _split(body: bytes) -> tuple[bytes, bytes]:
        m = STREAM.search(body)
        if not m:
            return body, b""
        head, data = body[: m.start()], m[1]
        if b"/FlateDecode" in head:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                data = b""
        return head, data

    def reach(self, head: bytes, name: bytes) -> bytes:
        """What stands at a name of a dictionary: its own text, or the object's that it refers to."""
        if m := re.search(rb"/%s\s*(\d+)\s+\d+\s+R" % name, head):
            return self.objects.get(int(m[1]), (b"", b""))[0]
        m = re.search(rb"/%s\s*(<<.*)" % name, head, re.S)
        return m[1] if m else b""

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """(resources, content) of each page in order."""
        roots = [self.reach(h, b"Pages") for h, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog", h)]

        waiting, seen = [(root, b"") for root in roots[:1]], set()
        while waiting:
            head, resources = waiting.pop()
            own = self.reach(head, b"Resources") or resources
            if kids := re.search(rb"/Kids\s*\[(.*?)\]", head, re.S):
                if head not in seen:  # a node that holds itself
                    seen.add(head)
                    waiting += [(self.objects.get(int(k), (b"", b""))[0], own) for k in reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids[1]))]
            elif m := re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", head, re.S):
                yield own, b"\n".join(self.objects.get(int(n), (b"", b""))[1] for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1] or m[2]))

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str], dict[int, float]]]:
        """Bytes a code, what codes mean and how wide they are (in em, -1: all others), by the font's name."""
        out = {}
        for name, number in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", self.reach(resources, b"Font").split(b">>")[0]):
            head = self.objects.get(int(number), (b"", b""))[0]
            m = re.search(rb"/ToUnicode\s+(\d+)", head)
            out[name] = (2 if b"/Type0" in head else 1, _unicode(self.objects.get(int(m[1]), (b"", b""))[1]) if m else {}, self._widths(head))
        return out

    def _widths(self, head: bytes) -> dict[int, float]:
        if m := re.search(rb"/DescendantFonts\s*\[\s*(\d+)", head):
            head = self.objects.get(int(m[1]), (b"", b""))[0]
        number = lambda name, other: float(m[1]) if (m := re.search(rb"/%s\s+([\d.]+)" % name, head)) else other
        out = {-1: number(b"DW", 500.0) / 1000}
        if m := re.search(rb"/Widths\s*\[([^\]]*)\]", head):
            out |= {int(number(b"FirstChar", 0)) + i: float(w) / 1000 for i, w in enumerate(m[1].split())}
        if m := re.search(rb"/W\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", head):
            for first, several, last, one in re.findall(rb"(\d+)\s*(?:\[([^\]]*)\]|(\d+)\s+([\d.]+))", m[1]):
                codes = enumerate(several.split(), int(first)) if not last else ((c, one) for c in range(int(first), int(last) + 1))
                out |= {c: float(w) / 1000 for c, w in codes}
        return out


def _unicode(cmap: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out |= {int(a, 16) + i: chr(int(c, 16) + i) for i in range(int(b, 16) - int(a, 16) + 1)}
    return out


def _shown(token: bytes, font: tuple) -> tuple[str, float]:
    """A string's text and width."""
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        raw = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else PLAIN.get(m[2], m[2]), token[1:-1])
    size, names, widths = font
    codes = [int.from_bytes(raw[i : i + size], "big") for i in range(0, len(raw), size)]
    text = raw.decode("cp1252", "replace") if not names and size == 1 else "".join(names.get(c, "") for c in codes)
    return text, sum(widths.get(c, widths[-1]) for c in codes)


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def runs(content: bytes, fonts: dict) -> Iterator[tuple[float, float, float, float, str]]:
    """(x, y, size, width, text) of each run; characters of unknown width count half an em."""
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    outer, saved, line, at, font, size, leading, stack = one, [], one, one, NO_FONT, 1.0, 0.0, []
    for token in TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+\d?", token):
            stack.append(token)
            continue
        n = [float(x) for x in stack if re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", x)]
        if token == b"q":
            saved.append(outer)
        elif token == b"Q" and saved:
            outer = saved.pop()
        elif token == b"cm" and len(n) == 6:
            outer = _times(tuple(n), outer)
        elif token == b"BT":
            line = at = one
        elif token == b"Tf" and n:
            names = [x for x in stack if x[:1] == b"/"]
            font, size = fonts.get(names[-1][1:] if names else b"", NO_FONT), n[-1]
        elif token == b"TL" and n:
            leading = n[-1]
        elif token in (b"Td", b"TD") and len(n) == 2:
            leading = -n[1] if token == b"TD" else leading
            line = at = _times((1, 0, 0, 1, *n), line)
        elif token == b"Tm" and len(n) == 6:
            line = at = tuple(n)
        elif token in (b"T*", b"'", b'"'):
            line = at = _times((1, 0, 0, 1, 0, -leading), line)
        if token in (b"Tj", b"TJ", b"'", b'"'):
            text, width = "", 0.0
            for x in stack:
                if x[:1] in b"(<" and x != b"<":
                    part, wide = _shown(x, font)
                    text, width = text + part, width + wide * size
                elif token == b"TJ" and x not in (b"[", b"]") and x[:1] != b"/":
                    text, width = text + (" " if float(x) < -250 else ""), width - float(x) / 1000 * size
            scale = _times(at, outer)
            if text.strip():
                yield scale[4], scale[5], abs(size * (scale[3] or scale[0])), width * abs(scale[0] or 1), text
            at = _times((1, 0, 0, 1, width, 0), at)
        stack = []


def text_runs(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, page (from 1), n, x, y, size, width, text of all pages. A file that can't be read gives none.

    A task holds a batch of files as they are, one of them taken apart, and a batch of runs.
    """

    kind = T.StructType([files.schema[key], *T.StructType.fromDDL(RUNS)])
    arrow = to_arrow_schema(kind)

    def found(batches):
        for k, raw in batching.rows_of(batches):
            document = Document(bytes(raw or b""))
            for page, (resources, data) in enumerate(document.pages(), 1):
                for n, r in enumerate(runs(data, document.fonts(resources))):
                    yield k, page, n, *r

    return files.select(key, content).mapInArrow(lambda batches: batching.batches_of(found(batches), arrow), kind)


def page_matrices(found: DataFrame, key: str = "path") -> DataFrame:
    """key, table_idx (page * 1000), matrix: each page's lines and columns. ``found``: as from ``text_runs``."""
    page = [key, "page"]
    down = W.partitionBy(*page).orderBy(F.desc("y"), "x", "n")
    rows = found.withColumn("_new", F.when(F.lag("y").over(down) - F.col("y") <= 0.5 * F.col("size"), 0).otherwise(1)).withColumn("line", F.sum("_new").over(down))
    across = W.partitionBy(*page, "line").orderBy("x", "n")
    gap = F.col("x") - F.max(F.col("x") + F.col("width")).over(across.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", gap).withColumn("cell", F.sum(F.when(F.col("_gap") <= 0.45 * F.col("size"), 0).otherwise(1)).over(across))
    part = F.struct("x", "n", F.when(F.col("_gap") > 0.2 * F.col("size"), F.concat(F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))
    cells = rows.groupBy(*page, "line", "cell").agg(
        F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("end"), F.max("size").alias("size"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "")).alias("text"),
    )
    alone = F.count("*").over(W.partitionBy(*page, "line")) == 1
    sideways = W.partitionBy(*page).orderBy("x", "line")
    cells = cells.withColumn("_end", F.when(~alone, F.col("end")))  # a line of one cell, as a title, holds no columns together
    ahead = F.max("_end").over(sideways.rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("column", F.sum(F.when(F.col("_end").isNotNull() & (ahead.isNull() | (F.col("x") > ahead)), 1).otherwise(0)).over(sideways))
    cells = cells.withColumn("column", F.greatest(F.col("column"), F.lit(1)))
    texts = cells.groupBy(*page, "line", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"]), " ").alias("text"))
    lines = texts.groupBy(*page, "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("by"), F.max("column").alias("width"))
    wide = F.max("width").over(W.partitionBy(*page))
    lines = lines.withColumn("_wide", wide).withColumn("row", F.transform(F.sequence(F.lit(1), F.col("_wide")), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(""))))
    return lines.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda r: r["row"]).alias("matrix")).select(key, (F.col("page") * 1000).alias("table_idx"), "matrix")


def pdf_tables(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, columns, rows: each file's tables that are like the best one, as one; rows that repeat go."""
    found = normalized(page_matrices(text_runs(files, key, content), key))
    found = found.filter(~is_layout(F.col("columns"), F.col("rows")))
    found = settled(found.withColumn("score", score(F.col("columns"), F.col("rows"))), "score")
    return merge_similar(found, [key], "table_idx").select(key, "columns", "rows")
