"""Queries of the table operators: events laid out as the lines of tables, and the fields that standardisation gives back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import form_literal
from ..operators import standardize as std
from ..operators import tables
from ..sources import html_tables
from .registry import golden, pick, query, spread, table

#: Every event as a line of its user's table, with its place there, and the cells that are made of it.
LINES = """SELECT user_id AS l_orderkey, CAST(event_id % 7 + 1 AS INTEGER) AS l_linenumber, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, user_id % 4 AS v, event_id % 40 AS l_partkey,
event_id % 50 AS q, event_id % 5 AS p, CAST(event_id % 4 + 2 AS INTEGER) AS m,
concat(CAST(event_id % 30 + 10 AS VARCHAR(9)), '.0', CAST(event_id % 4 + 2 AS VARCHAR(9)), '.', CAST(event_id % 80 + 10 AS VARCHAR(9))) AS code, concat('Направление ', CAST(event_id % 40 AS VARCHAR(19))) AS name FROM events"""
LEVEL = """CASE m WHEN 2 THEN 'Среднее профессиональное образование' WHEN 3 THEN 'Высшее образование - бакалавриат' WHEN 4 THEN 'Высшее образование - магистратура' ELSE 'Высшее образование - специалитет' END"""
PLAIN = ["№", "Код", "Наименование специальности", "Курс", "Форма обучения", "Бюджетные места", "Платные места"]
GROUPED = ["Код", "Наименование направления подготовки", "1 курс бюджет", "1 курс плат", "2 курс бюджет", "3 курс договор"]
SEVERAL = ["Код", "Направление", "Курс", "Бюджет", "Договор"]


def lines(spark, d):
    """The same rows as LINES."""
    return spark.sql(LINES.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))


def text(*cells):
    return F.array(*(c.cast("string") if not isinstance(c, str) else F.lit(c) for c in cells))


def gathered(rows, columns):
    """One table per user. rows: l_orderkey, pos, row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"])
    return rows.groupBy(F.col("l_orderkey").alias("table_id")).agg(ordered.alias("rows"), F.first(columns).alias("columns"))


def laid_out(spark, d):
    c = F.col
    names = lambda xs: F.array(*map(F.lit, xs))
    form = F.when(c("pos") % 2 == 0, "очная").otherwise("заочная")
    course = (c("pos") % 6 + 1).cast("string")
    first = c("pos") % 3 == 0
    blank = lambda x, when: F.when(when, F.lit("")).otherwise(x)
    plain = text(c("pos") + 1, c("code"), c("name"), course, form, c("q"), c("p"))
    carried = text("", blank(c("code"), ~first), blank(c("name"), ~first), blank(course, c("pos") % 3 == 1), form, c("q"), c("p"))
    grouped = text(c("code"), c("name"), c("q"), c("p"), c("pos") + 1, c("l_linenumber"))
    even = c("pos") % 2 == 0
    several = text(c("code"), c("name"), F.when(even, F.lit("1 3")).otherwise("2"), F.when(even, F.concat_ws(" ", "q", c("q") + 1)).otherwise(c("q").cast("string")), c("p"))
    at = lambda *v: F.element_at(F.array(*v), (c("v") + 1).cast("int"))
    columns = at(names(PLAIN), names(PLAIN), names(GROUPED), names(SEVERAL))
    rows = lines(spark, d).select("l_orderkey", "pos", at(plain, carried, grouped, several).alias("row"), columns.alias("columns"))
    total = rows.filter("l_orderkey % 4 = 0").select("l_orderkey", F.lit(1 << 40).alias("pos"), text("", "", "Итого по вузу", "", "", "99", "").alias("row"), "columns").distinct()
    return gathered(rows.union(total), "columns")


@query(f"""WITH l AS ({LINES}), f AS (SELECT l.*, first_value(code) OVER w AS code0, first_value(name) OVER w AS name0, first_value(m) OVER w AS m0 FROM l WINDOW w AS (PARTITION BY l_orderkey, pos // 3 ORDER BY pos)),
form AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'очная' ELSE 'заочная' END AS form FROM f),
o AS (SELECT l_orderkey, pos, 0 AS sub, code, name, {LEVEL} AS level, (pos % 6 + 1)::VARCHAR AS course, form, q AS budget, p AS paid FROM form WHERE v = 0
UNION ALL SELECT l_orderkey, pos, 0, code0, name0, {LEVEL.replace("CASE m", "CASE m0")}, ((CASE WHEN pos % 3 = 1 THEN pos - 1 ELSE pos END) % 6 + 1)::VARCHAR, form, q, p FROM form WHERE v = 1
UNION ALL SELECT l_orderkey, pos, s, code, name, {LEVEL}, (s + 1)::VARCHAR, '', ([q, pos + 1, 0])[s + 1], ([p, 0, l_linenumber])[s + 1] FROM form, (VALUES (0), (1), (2)) AS x(s) WHERE v = 2
UNION ALL SELECT l_orderkey, pos, s, code, name, {LEVEL}, ([1, 3])[s + 1]::VARCHAR, '', q + s, CASE WHEN s = 0 THEN p ELSE 0 END FROM form, (VALUES (0), (1)) AS x(s) WHERE v = 3 AND pos % 2 = 0
UNION ALL SELECT l_orderkey, pos, 0, code, name, {LEVEL}, '2', '', q, p FROM form WHERE v = 3 AND pos % 2 = 1)
SELECT l_orderkey AS table_id, pos::INTEGER AS pos, sub::INTEGER AS sub, code, name AS direction, '' AS program, level, course, form, budget::VARCHAR AS budget, paid::VARCHAR AS paid FROM o""")
def standardize(spark, d):
    """Every user's events as a table in one of four layouts, standardised into eight fields."""
    return std.standardize(laid_out(spark, d))


@query(f"""SELECT l_orderkey AS table_id, (count(*) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END)::INTEGER AS row_count, count(*) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END > 3 AS truncated, least(count(*) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END, 3)::INTEGER AS kept FROM ({LINES}) GROUP BY l_orderkey""")
def table_cap(spark, d):
    """Rows of a table beyond a cap, reported."""
    return std.cut_rows(laid_out(spark, d), 3).select("table_id", "row_count", "truncated", F.size("rows").alias("kept"))


@query(f"""WITH l AS ({LINES}), n AS (SELECT *, lead(l_partkey) OVER w AS after, lag(l_partkey) OVER w AS before FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos))
SELECT l_orderkey AS table_id, pos::INTEGER AS pos, code, CASE WHEN pos % 3 = 2 AND l_orderkey % 2 = 1 THEN 'ч. ' || before WHEN pos % 3 = 0 AND after IS NOT NULL AND (l_orderkey % 2 = 0 OR ahead = 0) THEN name || ' ч. ' || after ELSE name END AS direction
FROM (SELECT *, (lead(pos, 2) OVER (PARTITION BY l_orderkey ORDER BY pos) IS NOT NULL)::INTEGER AS ahead FROM n) WHERE pos % 3 <> 1""")
def continuation_rows(spark, d):
    """Rows of text alone go into the row before them, or into the next one where that lacks text."""
    c = F.col
    alone, lacks = c("pos") % 3 == 1, (c("pos") % 3 == 2) & (c("l_orderkey") % 2 == 1)
    name = F.when(alone, F.concat_ws(" ", F.lit("ч."), "l_partkey")).when(lacks, "").otherwise(c("name"))
    other = lambda x: F.when(alone, "").otherwise(x.cast("string"))
    row = text("", other(c("code")), name, other(c("pos") % 6 + 1), other(F.lit("очная")), other(c("q")), other(c("p")))
    rows = lines(spark, d).select("l_orderkey", "pos", row.alias("row"), F.array(*map(F.lit, PLAIN)).alias("columns"))
    return std.standardize(gathered(rows, "columns")).select("table_id", "pos", "code", "direction")


#: Headers, and by the rules: kind, paid, budget, form that they name, points as code, direction, form.
HEADS = [
    ("№ п/п", "ordinal", False, False, "", 0, 0, 0),
    ("Код", "code", False, False, "", 2, -2, 0),
    ("Шифр специальности", "unknown", False, False, "", 2, 2, 0),
    ("Наименование  специальности", "direction", False, False, "", 2, 7, 0),
    ("Наименование", "direction", False, False, "", 0, 4, 0),
    ("Направление подготовки", "unknown", False, False, "", 2, 5, 0),
    ("Образовательная программа", "program", False, False, "", 0, -2, 0),
    ("Уровень образования", "level", False, False, "", 0, 0, 0),
    ("Курс", "course", False, False, "", 0, 0, 0),
    ("Форма обучения", "form", False, False, "", 0, 0, 5),
    ("Формат", "unknown", False, False, "", 0, 0, 3),
    ("Платное обучение", "paid", True, False, "", 0, 0, 0),
    ("Договор, бюджет", "paid", True, False, "", 0, 0, 0),
    ("Бюджет субъекта РФ", "budget_subject", False, True, "", 0, 0, 0),
    ("Местный бюджет", "budget_local", False, True, "", 0, 0, 0),
    ("Федеральный бюджет", "budget_federal", False, True, "", 0, 0, 0),
    ("Бюджетные места (очно-заочная)", "budget_other", False, True, "очно-заочная", 0, 0, 0),
    ("", "unknown", False, False, "", 0, 0, 0),
]


@query(f"""SELECT p_partkey, g.* EXCLUDE (i) FROM part JOIN {golden("g", "kind, paid, budget, form_literal, code_points, direction_points, form_points", [h[1:] for h in HEADS])} ON p_partkey % {len(HEADS)} = g.i""")
def header_kinds(spark, d):
    """What a header stands for, and its points for each role."""
    raw = pick([h[0] for h in HEADS], "p_partkey")
    h = tables.header(raw)
    return table(spark, d, "part").select("p_partkey", tables.header_kind(raw).alias("kind"), tables.is_paid(h).alias("paid"), tables.is_budget(h).alias("budget"), form_literal(raw).alias("form_literal"), tables.code_score(h).alias("code_points"), tables.direction_score(h).alias("direction_points"), tables.form_score(h).alias("form_points"))


#: Headers of tables, and by the rules the places of code, direction, program, level, course and form, amounts, default form.
ROLES = [
    (PLAIN, 1, 2, None, None, 3, 4, [5], [6], ""),
    (["Наименование", "Шифр", "Профиль", "Уровень образования", "Форма"], 1, 0, 2, None, None, None, [], [], ""),
    (["Уровень образования", "Специальность (очная)", "Курс", "Фед. бюджет", "Местный бюджет", "Договор"], 1, 1, None, 0, 2, None, [3, 4], [5], "очная"),
    (["Прочее"], None, None, None, None, None, None, [], [], ""),
]
_VALUES = [["1", "01.03.02", "x", "2", "очная", "3", "4"], ["Математика", "01.03.02", "y", "10", "12"], ["бакалавриат", "Физика", "1", "2", "0", "5"], ["z"]]


@query(f"""SELECT c_custkey, g.* EXCLUDE (i) FROM customer JOIN {golden("g", "code, direction, program, level, course, form, budget, paid, default_form", [r[1:] for r in ROLES])} ON c_custkey % {len(ROLES)} = g.i""")
def header_roles(spark, d):
    """The column of each role: the first of the most points, dropped where its values do not look like it."""
    nth = lambda xs: F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in xs)), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    t = spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", nth([r[0] for r in ROLES]).alias("columns"), F.array(nth(_VALUES)).alias("rows"))
    names = ("code", "direction", "program", "level", "course", "form", "budget", "paid", "default_form")
    return tables.with_roles(t).select("c_custkey", *(F.col(f"roles.{n}").alias(n) for n in names))


#: A menu's words do not make a table; these headers have four words of tables (6 points each).
SCORED = ["Код", "Бюджет", "Курс", "Колонка 4"]


def _scored(spark, d):
    rows = lines(spark, d)
    rows = rows.withColumn("row", text(F.col("code"), F.col("q"), F.col("l_linenumber"), F.concat(F.lit("отдел "), F.col("l_partkey").cast("string"))))
    return gathered(rows.withColumn("columns", F.array(*map(F.lit, SCORED))), "columns")


_SAMPLE = f"""l AS ({LINES}), r AS (SELECT l_orderkey, pos, code || ' ' || q || ' ' || l_linenumber || ' отдел ' || l_partkey AS line FROM l),
t AS (SELECT l_orderkey, count(*) AS n, string_agg(line, ' ' ORDER BY pos) FILTER (WHERE pos < 12) AS sample, least(count(*), 12) AS menu FROM r GROUP BY l_orderkey),
m AS (SELECT l_orderkey, n, len(regexp_extract_all(sample, '[0-9]')) / length(sample)::DOUBLE AS digit_ratio, menu FROM t)"""


@query(f"""WITH {_SAMPLE} SELECT l_orderkey AS table_id, round(digit_ratio, 6) AS digit_ratio, menu::DOUBLE AS menu_hits, 1.0::DOUBLE AS generic_cols, 0.0::DOUBLE AS unnamed_cols, 9.0::DOUBLE AS max_col_len, 3.0::DOUBLE AS header_hits,
round(12 + least(n, 400) / 20.0 + 4 / 3.0, 6)::DOUBLE AS base, round(12 + least(n, 400) / 20.0 + 4 / 3.0 + digit_ratio * 40 + 7.5 - menu * 3 - 5 - 10, 6)::DOUBLE AS score, n < 2 AS layout FROM m""")
def table_scores(spark, d):
    """Metrics and scores of tables, and which are no more than a page's layout."""
    c, r = F.col("columns"), F.col("rows")
    m = tables.metrics(c, r)
    out = [F.round(m[n], 6).alias(n) for n in ("digit_ratio", "menu_hits", "generic_cols", "unnamed_cols", "max_col_len", "header_hits")]
    return _scored(spark, d).select("table_id", *out, F.round(tables.base_score(c, r), 6).alias("base"), F.round(tables.score(c, r), 6).alias("score"), tables.is_layout(c, r).alias("layout"))


@query(f"""WITH {_SAMPLE} SELECT entity, l_orderkey AS table_id FROM (SELECT l_orderkey // 3 AS entity, l_orderkey, row_number() OVER (PARTITION BY l_orderkey // 3 ORDER BY 12 + least(n, 400) / 20.0 + 4 / 3.0 + digit_ratio * 40 + 7.5 - menu * 3 - 5 - 10 DESC, l_orderkey) AS rn FROM m WHERE n >= 2) WHERE rn = 1""")
def best_tables(spark, d):
    """The table of the highest score of each three."""
    t = _scored(spark, d).withColumn("entity", F.floor(F.col("table_id") / 3))
    return tables.best_table(t, ["entity"], ["table_id"]).select("entity", "table_id")


@query("""WITH t AS (SELECT p_partkey, [p_name, lower(p_type), ''] AS a, [upper(p_name), p_type, '', p_brand] AS b, [p_type, p_name] AS c FROM part)
SELECT p_partkey, 0.5::DOUBLE AS same_places, round(CASE WHEN lower(a[1]) = a[2] THEN 1.0 ELSE 1.0 END, 6)::DOUBLE AS headers, round(len(list_intersect([p, q], [r, s])) / len(list_distinct([p, q, r, s]))::DOUBLE, 6) AS sets FROM
(SELECT p_partkey, a, split_part(a[1], ' ', 1) AS p, a[2] AS q, a[2] AS r, split_part(a[1], ' ', 2) AS s FROM t)""")
def row_similarity(spark, d):
    """Rows and headers compared by place and as sets."""
    n, t = F.col("p_name"), F.col("p_type")
    first, second = F.split_part(n, F.lit(" "), F.lit(1)), F.split_part(n, F.lit(" "), F.lit(2))
    return table(spark, d, "part").select(
        "p_partkey",
        tables.row_similarity(F.array(n, F.lower(t), F.lit("")), F.array(F.upper(n), t, F.lit(""), F.col("p_brand"))).alias("same_places"),
        tables.header_similarity(F.array(n, t), F.array(F.concat(F.lit(" "), t), F.upper(n))).alias("headers"),
        F.round(tables.jaccard(F.array_distinct(F.array(first, F.lower(t))), F.array_distinct(F.array(F.lower(t), second))), 6).alias("sets"),
    )


@query(f"""WITH l AS ({LINES}), t AS (SELECT l_orderkey // 2 AS entity, l_orderkey % 2 AS side, pos, CASE WHEN min(l_orderkey % 2) OVER (PARTITION BY l_orderkey // 2) = 0 THEN [code, name, q::VARCHAR] ELSE [q::VARCHAR, code, name, ''] END AS row FROM l),
f AS (SELECT entity, row, min(side * 1000000 + pos) AS first FROM t GROUP BY entity, row)
SELECT entity, len(list(row))::INTEGER AS n, sha256(string_agg(array_to_string(row, ';'), '|' ORDER BY first)) AS rows FROM f GROUP BY entity""")
def merged_tables(spark, d):
    """Two tables of one entity, whose columns stand in another order, as one without repeated rows."""
    swap = F.col("l_orderkey") % 2 == 1
    c = F.col
    rows = lines(spark, d).withColumn("row", F.when(swap, text(c("q"), c("code"), c("name"))).otherwise(text(c("code"), c("name"), c("q"))))
    heads = F.when(swap, F.array(*map(F.lit, ["Бюджетные места", "Код", "Наименование специальности", "Прочее"]))).otherwise(F.array(*map(F.lit, ["Код", "Наименование специальности", "Бюджетные места"])))
    rows = rows.withColumn("row", F.when(swap, F.concat("row", F.array(F.lit("")))).otherwise(c("row")))
    t = gathered(rows.withColumn("columns", heads), "columns").select(F.floor(c("table_id") / 2).alias("entity"), F.when(c("table_id") % 2 == 1, 1.0).otherwise(2.0).alias("score"), c("table_id").alias("at"), "columns", "rows")
    out = tables.merge_similar(t, ["entity"], "at", 0.5)
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "|")
    return out.select("entity", F.size("rows").alias("n"), F.sha2(joined.cast("binary"), 256).alias("rows"))


#: Columns' values, and the names that their shares give by the rules.
INFERRED = [
    (["1 курс", "2 курс", ""], "Курс"),
    (["очная", "заочная", "x"], "Форма"),
    (["01.03.02", "02.03.02 Математика", "y"], "Код"),
    (["бакалавриат", "магистр", "z", "w"], "Уровень"),
    (["Прикладная математика и физика", "Юриспруденция и право"], "Направление"),
    (["ИМИТ", "ФИЗ", "мех"], "Подразделение"),
    (["a", "b"], "Колонка 1"),
    (["", ""], "Колонка 1"),
]


@query(f"""SELECT s_suppkey, g.* EXCLUDE (i), 'Ещё' AS named, 24 AS wide, '5 курс — Платное обучение' AS last_wide FROM supplier JOIN {golden("g", "name", [(x[1],) for x in INFERRED])} ON s_suppkey % {len(INFERRED)} = g.i""")
def inferred_names(spark, d):
    """Generic headers named after what their columns hold, and the layout of 24 columns."""
    s = table(spark, d, "supplier")
    rows = F.element_at(F.array(*(F.array(*(F.array(F.lit(v), F.lit("1 курс")) for v in x[0])) for x in INFERRED)), (F.col("s_suppkey") % len(INFERRED) + 1).cast("int"))
    named = tables.with_inferred_names(s.select("s_suppkey", F.array(F.lit("Колонка 1"), F.lit("Ещё")).alias("columns"), rows.alias("rows")))
    cells = F.array(F.lit("ИМИТ"), F.lit("очная"), F.lit("01.03.02"), F.lit("Математика"), *[F.lit("1")] * 20)
    wide = tables.with_inferred_names(s.select("s_suppkey", F.array(*(F.lit(f"Колонка {i}") for i in range(1, 25))).alias("columns"), F.array(cells).alias("rows")))
    wide = wide.select("s_suppkey", F.size("columns").alias("wide"), F.element_at("columns", -1).alias("last_wide"))
    return named.select("s_suppkey", F.get("columns", F.lit(0)).alias("name"), F.get("columns", F.lit(1)).alias("named")).join(wide, "s_suppkey")


def html_of_orders(spark, d):
    """A page per user: a hidden cell, a spanning cell, a nested table, a picture's text, and a layout table first."""
    c = F.col
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    head = "<tr><th rowspan=2>Код</th><th rowspan=2>Наименование специальности</th><th colspan=2>Места</th></tr><tr><th>Бюджет</th><th>Договор</th></tr>"
    shown = F.when(c("pos") % 2 == 0, cell(c("q").cast("string"))).otherwise(F.concat(F.lit("<td><img alt='"), c("q").cast("string"), F.lit("'></td>")))
    line = F.concat(F.lit("<tr><td class='hide'>no</td>"), cell(c("code")), cell(F.concat(F.lit(" <b>"), c("name"), F.lit("</b>\n "))), shown, cell(c("p").cast("string")), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "")
    pages = lines(spark, d).groupBy(c("l_orderkey").alias("page_id")).agg(body.alias("body"))
    html = F.concat(F.lit(f"<html><body><TABLE><tr><td>Факультет<td>Институт</table><p><table>{head}"), "body", F.lit("</table></body></html>"))
    return pages.select("page_id", html.alias("html"))


@query(f"""WITH l AS ({LINES}) SELECT l_orderkey AS page_id, 1 AS table_idx, 2 AS n_tables, ['Код', 'Наименование специальности', 'Места / Бюджет', 'Места / Договор'] AS columns,
sha256(string_agg(code || ';' || name || ';' || q || ';' || p, '|' ORDER BY pos)) AS rows FROM l GROUP BY l_orderkey""")
def page_tables(spark, d):
    """Tables of pages: spans, hidden cells, pictures' texts, headers of two rows. One-row tables are none."""
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "|")
    return html_tables.html_tables(html_of_orders(spark, d)).select("page_id", "table_idx", "n_tables", "columns", F.sha2(rows.cast("binary"), 256).alias("rows"))


#: Matrices, and by the rules their headers and how many rows are left.
MATRICES = [
    ([["Код", "Курс", "Курс"], ["x", "1", "2"]], ["Код", "Курс", "Курс (2)"], 1),
    ([["Код", "Курс", "Форма"], ["код", " Курс", "Форма"], ["x", "1", "2"]], ["Код", "Курс", "Форма"], 1),
    ([["01.03.02", "Математика", ""], ["01.03.03", "Механика", ""]], ["Код", "Колонка 2"], 2),
    ([["Документ подписан", "кем"], ["Код направления", "Форма"], ["a", "b"], ["c", "d"]], ["Код направления", "Форма"], 2),
    ([["Вуз", "Вуз"], ["Мест", "Мест"], ["", ""], ["1 a", "2"]], ["Вуз", "Вуз (2)"], 2),
    ([["№ №", "Ещё"], ["7", "8"]], ["№", "Ещё"], 1),
]


@query(f"""SELECT n_nationkey, g.* EXCLUDE (i) FROM nation JOIN {golden("g", "columns, n_rows", [m[1:] for m in MATRICES])} ON n_nationkey % {len(MATRICES)} = g.i""")
def normalized_matrices(spark, d):
    """Headers told from data, repeated names numbered, echoes and empty columns dropped."""
    of = lambda m: F.array(*(F.array(*map(F.lit, r)) for r in m))
    t = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*(of(m[0]) for m in MATRICES)), (F.col("n_nationkey") % len(MATRICES) + 1).cast("int")).alias("matrix"))
    return tables.normalized(t).select("n_nationkey", "columns", F.size("rows").alias("n_rows"))


@query(f"""SELECT source, digits / n AS digits, round(long / n, 6) AS long FROM (SELECT source, count(*)::DOUBLE AS n, sum((n_chars % 10 < 3)::INTEGER) AS digits, sum((n_chars > 1000)::INTEGER)::DOUBLE AS long FROM documents WHERE n_chars IS NOT NULL GROUP BY source)""".replace("digits / n AS digits", "round(digits / n, 6) AS digits"))
def column_shares(spark, d):
    """Shares of a column's values that pass a test."""
    tests = {"digits": lambda v: v.cast("long") % 10 < 3, "long": lambda v: v.cast("long") > 1000}
    found = tables.column_shares(table(spark, d, "documents").filter("n_chars is not null"), ["source"], "n_chars", tests)
    return found.select("source", *(F.round(n, 6).alias(n) for n in tests))
