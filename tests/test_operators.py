"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrich, reconcile, search, tables, timeline
from tessera.operators.standardize import standardize
from tessera.sources import documents, html_tables, sinks
from tessera.streaming import refresh

FIELDS = "uni_id string, code string, dir string, program string, level string, course string, form string, budget string, paid string"
TABLE = "table_id string, columns array<string>, rows array<array<string>>"


def test_flatten_and_search(spark):
    e = spark.createDataFrame([("1", "Alpha"), ("2", "Beta")], "id string, name string")
    r = spark.createDataFrame([("1", [("2.1.11", 0), ("2.1.9", 3)])], "id string, rows array<struct<code: string, budget: int>>")
    flat = search.flatten(e, r)
    assert flat.count() == 2
    found = search.Search([F.col("name")], query="ALP", sort="code", ties=("row_ord",), limit=None).shown(flat).collect()
    assert [x["code"] for x in found] == ["2.1.9", "2.1.11"] and found[0]["row_ref"] == "row-1"
    assert search.Search([F.col("name")], query=" alp").rows(flat).count() == 0
    assert flat.filter(search.seats("budget", F.col("budget"), F.lit(0))).count() == 1
    assert search.totals(flat, {"b": "budget"}).collect()[0]["b"] == 3


def test_capped(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    got = search.capped(df, ["k"], ["id"], 3).collect()
    assert len(got) == 6 and all(r["truncated"] and r["row_count"] == 5 for r in got)


def test_upsert_update_override_fallback(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, v string")
    assert sorted(r["v"] for r in enrich.upsert(base, spark.createDataFrame([(2, "b", "z"), (3, "c", "w")], base.schema), "id").collect()) == ["w", "x", "z"]
    got = enrich.update(base, spark.createDataFrame([(1, "q"), (2, "")], "id int, v string"), "id", ["v"], ignore_empty=True)
    assert [(r["v"], r["changed"]) for r in got.orderBy("id").collect()] == [("q", 1), ("y", 0)]
    over = spark.createDataFrame([("1", "v", "id"), ("a", "v", "name"), ("b", "v", "name"), ("b", "z", "no")], "key string, field string, value string")
    assert [r["v"] for r in enrich.override(base, over, ["v"]).orderBy("id").collect()] == ["id", "name"]
    fall = enrich.with_fallback(base, spark.createDataFrame([(1, "f")], "id int, v string"), "id", F.col("v") == "x", ["v"])
    assert [(r["v"], r["is_manual_fallback"]) for r in fall.orderBy("id").collect()] == [("f", True), ("y", False)]


def test_portal_precedence(spark):
    dates = spark.createDataFrame([(None, " A ", "1–14 июня; март", "", "http://a", "", "", 1), (7, "B", "", "note", "", "нет", "", 2)], "id int, name string, dates_raw string, dates_note string, source string, dorm_mark string, dorm_comment string, ord int")
    profiles = spark.createDataFrame([("A", "old", "", "", "", "", "", 1), ("A", "8 декабря", "да", "c", "p", "s", "d", 2)], "name string, deadlines string, dorm_mark string, dorm_comment string, procedure string, special string, documents string, ord int")
    vac = spark.createDataFrame([("A", "ok", "", "http://v", None, "", 0, 1)], "name string, status string, message string, source string, dorm_flag boolean, dorm_details string, row_count int, ord int")
    types = spark.createDataFrame([("B", "art")], "name string, type string")
    over = spark.createDataFrame([("7", "dorm", "да"), ("7", "notes", "fixed")], "key string, field string, value string")
    a, b = enrich.portal(dates, profiles, vac, types, over, ["dorm", "notes", "vacPubSummer"]).orderBy("name").collect()
    assert (a["id"], a["winter"], a["summer"], a["dorm"], a["vacancyStatus"], a["type"]) == (1, "8 декабря", "8 декабря", True, "error", "federal")
    assert a["vacPubSummer"] == enrich.TABLE_NOTICE and b["vacPubSummer"] == ""
    assert (b["id"], b["type"], b["dorm"], b["notes"], b["summer"]) == (7, "art", True, "fixed", enrich.ASK)


def row(uni, code="01.03.01", budget="1", paid="0", course="1"):
    return (uni, code, "dir", "", "бакалавриат", course, "очная", budget, paid)


@pytest.mark.parametrize(
    "parsed,expected,kind,names",
    [
        ([row("u")], [row("u")], "html", []),
        ([row("u")], [row("u"), row("u", "02.03.01")], "pdf", ["MISS_PAGE", "MISS_ROWS", "WRONG_CODE_FORM_COURSE"]),
        ([row("u"), row("u")], [row("u")], "html", ["DUP_ROWS", "NOISE_ROWS", "NUMERIC_MISMATCH", "WRONG_CODE_FORM_COURSE"]),
        ([row("u", budget="2")], [row("u")], "html", ["NUMERIC_MISMATCH"]),
        ([("u", "", "", "", "", "", "", "3", "0")], [row("u")], "html", ["HEADER_SHIFT", "WRONG_CODE_FORM_COURSE"]),
    ],
)
def test_mismatches(spark, parsed, expected, kind, names):
    sources = spark.createDataFrame([("u", kind, "ok", len(expected))], "uni_id string, source_type string, status string, expected_rows int")
    got = reconcile.classify(spark.createDataFrame(parsed, FIELDS), spark.createDataFrame(expected, FIELDS), sources)
    assert got.collect()[0]["mismatches"] == names
    assert reconcile.verdict(got, sources).collect()[0]["verdict"] == ("FAIL" if names else "PASS")


def test_multiset_diff_is_empty_against_itself(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert reconcile.multiset_diff(df, df, ["a", "b"]).count() == 0


def test_wide_table_gives_390_rows(spark):
    names = ["Подразделение", "Код и наименование направления", *(f"{k} курс" for k in range(1, 7))]
    cells = [["Ф", f"01.03.{i % 9 + 1:02d} Направление {i}", "1", "0", "", "2", "-", "0"] for i in range(65)]
    assert standardize(spark.createDataFrame([("t", names, cells)], TABLE)).count() == 390


def test_standardize_rows(spark):
    a = ("a", ["Код, наименование специальности", "Уровень образования", "Курс", "Форма обучения", "За счет бюджетных ассигнований федерального бюджета", "За счет бюджетов субъектов", "Местного бюджета", "По договорам"], [["20.05.01 Пожарная безопасность", "Высшее образование - специалитет", "2", "очная", "0", "0", "0", "13"]])
    b = ("b", ["Код", "Наименование специальности", "Курс", "Форма обучения", "Бюджет", "Платные"], [["01.03.02", "Математика", "1 2 3", "очная", "4 - 5", "7"], ["", "", "1", "очная", "3", "0"], ["", "Прикладная", "", "", "", ""], ["01.03.03", "", "2", "очная", "1", "2"]])
    got = [tuple(r)[3:] for r in standardize(spark.createDataFrame([a, b], TABLE)).orderBy("table_id", "pos", "sub").collect()]
    bak = "Высшее образование - бакалавриат"
    assert got == [
        ("20.05.01", "Пожарная безопасность", "", "Высшее образование - специалитет", "2", "очная", "0", "13"),
        ("01.03.02", "Математика", "", bak, "1", "очная", "4", "7"),
        ("01.03.02", "Математика", "", bak, "2", "очная", "0", "0"),
        ("01.03.02", "Математика", "", bak, "3", "очная", "5", "0"),
        ("01.03.02", "Математика", "", bak, "1", "очная", "3", "0"),
        ("01.03.03", "Прикладная", "", bak, "2", "очная", "1", "2"),
    ]


def test_status_table_gives_no_rows(spark):
    df = spark.createDataFrame([("t", ["Статус"], [["-"]])], TABLE)
    assert standardize(df).count() == 0


def test_scores_and_kinds(spark):
    good = (["Код", "Наименование направления", "Курс", "Бюджет"], [["01.03.01", "Математика", "1", "5"]] * 5)
    menu = (["Колонка 1", "Колонка 2"], [["факультет", "институт"], ["библиотека", "журнал"]])
    df = spark.createDataFrame([("a", *good), ("b", *menu)], TABLE)
    r = df.select(tables.score(F.col("columns"), F.col("rows")).alias("s"), tables.is_layout(F.col("columns"), F.col("rows")).alias("l")).collect()
    assert r[0]["s"] > r[1]["s"] and not r[0]["l"] and r[1]["l"]
    kinds = spark.createDataFrame([("№",), ("По договорам",), ("Местный бюджет",), ("Курс",), ("Форма обучения",), ("x",)], "h string")
    assert [x["k"] for x in kinds.select(tables.header_kind(F.col("h")).alias("k")).collect()] == ["ordinal", "paid", "budget_local", "course", "form", "unknown"]


def test_merge_similar(spark):
    cols = ["Код", "Направление", "Курс"]
    rows = [("p", 0, 9.0, cols, [["1", "a", "1"], ["2", "b", "2"]]), ("p", 1, 5.0, cols, [["2", "b", "2"], ["Код", "направление", "Курс"], ["3", "c", "1"]]), ("p", 2, 1.0, ["x", "y"], [["q", "w"]])]
    df = spark.createDataFrame(rows, "page string, ord int, score double, columns array<string>, rows array<array<string>>")
    got = tables.merge_similar(df, ["page"], "ord").collect()[0]
    assert got["rows"] == [["1", "a", "1"], ["2", "b", "2"], ["3", "c", "1"]]


def test_html_tables(spark):
    html = """<table><tr><th rowspan=2>Код</th><th colspan=2>Места</th></tr><tr><td>Бюджет</td><td>Платные</td></tr>
    <tr><td>01.03.01</td><td>5 <span class=hide>h</span></td><td class="sr-only">x</td><td><img alt="7"></td></tr>
    <tr><td>01.03.02</td><td>6</td><td><table><tr><td>in</td></tr><tr><td>ner</td></tr></table></td></tr></table>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none")], "page_id long, html string")
    got = {r["table_idx"]: r for r in html_tables.html_tables(pages).collect()}
    assert got[0]["columns"] == ["Код", "Места / Бюджет", "Места / Платные"]
    assert got[0]["rows"] == [["01.03.01", "5", "7"], ["01.03.02", "6", "in ner"]]
    assert got[1]["columns"] == ["in"] and got[1]["rows"] == [["ner"]]


def test_download_links(spark):
    html = '<a href="/a.pdf">Вакантные места</a><a href="b.html">перевод</a><a href="/a.pdf">x</a><a href="c">y</a>'
    pages = spark.createDataFrame([(1, "http://h/x/", html)], "page_id long, url string, html string")
    got = html_tables.download_links(pages).orderBy("rank").collect()
    assert [(r["link"], r["score"]) for r in got] == [("http://h/a.pdf", 6.0), ("http://h/x/b.html", 4.0)]


def test_sections(spark):
    rows = [("s", 1, "Сроки", "июнь"), ("s", 2, "Порядок", ""), ("s", 3, "one", ""), ("s", 4, "", "two"), ("s", 5, "one", ""), ("s", 6, "Общежитие", "да"), ("s", 7, "lost", "")]
    df = spark.createDataFrame(rows, "sheet string, row_idx int, left string, right string")
    got = {r["field"]: r["value"] for r in documents.sections(df, {"Порядок": "procedure"}, {"Сроки": "deadlines", "Общежитие": "dorm_mark"}).collect()}
    assert got == {"deadlines": "июнь", "procedure": "one; two", "dorm_mark": "да"}


def test_documents_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ё")], "id int, name string")
    sinks.js_envelope(rows.agg(F.count("*").alias("total")), rows, "unis", str(tmp_path / "js"))
    back = documents.js_envelope(spark, str(tmp_path / "js"), "total long, unis array<struct<id: int, name: string>>").filter("total is not null").collect()
    assert back[0]["total"] == 1 and [r["name"] for r in back[0]["unis"]] == ["ё"]
    sinks.document(rows.agg(F.count("*").alias("total")), rows.filter("false"), "unis", str(tmp_path / "none"))
    assert documents.json_document(spark, str(tmp_path / "none"), "total long, unis array<struct<id: int>>").first()["unis"] == []
    for _ in range(2):
        sinks.append_register(rows, str(tmp_path / "reg"))
    assert spark.read.csv(str(tmp_path / "reg"), header=True).count() == 2
    (tmp_path / "o.json").write_text('{"overrides": {"1": {"dorm": "да", "bad": "x"}}}')
    assert [tuple(r) for r in documents.overrides(spark, str(tmp_path / "o.json"), ["dorm"]).collect()] == [("1", "dorm", "да")]
    (tmp_path / "t.html").write_text("var x=[{abbr: 'A', type: 'art'}, {name: \"B\", type: \"private\"}]")
    assert [tuple(r) for r in documents.template_types(spark, str(tmp_path / "t.html")).collect()] == [("A", "art"), ("B", "private")]
    (tmp_path / "m.csv").write_text("a;b\n1;2\n")
    assert documents.csv_matrix(spark, str(tmp_path / "m.csv")).count() == 2


def test_timeline(spark):
    df = spark.createDataFrame([("a", "20.06 – 29.08", "", "1–5 июля", ""), ("b", "1–3 июня", "8 декабря – 25 января", "", "")], "id string, summer string, winter string, vacPubSummer string, vacPubWinter string")
    rows = timeline.timeline(df)
    got = timeline.ordered(rows).collect()
    assert [(r["id"], r["wave"]) for r in got if r["is_dated"]] == [("b", "summer"), ("a", "summer"), ("b", "winter")]
    assert [(r["id"], r["wave"], r["parsed"]) for r in got if not r["is_dated"]] == [("a", "winter", None)]


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int").write.parquet(src)
    store = {"rows": [(1, "old", 0), (3, "keep", 0)]}
    read = lambda: spark.createDataFrame(store["rows"], "k int, v string, o int")
    write = lambda df, n: store.update(rows=[tuple(r) for r in df.collect()])
    stream = spark.readStream.schema("k int, v string, o int").parquet(src)
    refresh.continuous_upsert(stream, read, write, "k", "o", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[1] for r in store["rows"]) == ["b", "c", "keep"]


def test_inferred_names(spark):
    wide = [["ИТ", "очная", "01.03.01", "Математика", *["1"] * 20]]
    rows = [("w", [f"Колонка {i}" for i in range(1, 25)], wide), ("g", ["Колонка 1", "x"], [["01.03.01", "a"], ["02.03.01", "b"]])]
    got = {r["table_id"]: r["columns"] for r in tables.with_inferred_names(spark.createDataFrame(rows, TABLE)).collect()}
    assert got["w"][:5] == ["Подразделение", "Форма", "Код", "Направление", "1 курс — Фед. бюджет"] and got["g"] == ["Код", "x"]


def test_workbooks(spark, tmp_path):
    import zipfile

    from tessera.sources import workbooks

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = [[("A1", "Вуз"), ("B1", "№")], [("A2", "Alpha"), ("D2", "1–14 июня"), ("J2", "see"), ("B2", "7")], [("A3", "Beta"), ("N3", "-")], [("A4", "Gamma")]]
    body = "".join(f"<row>{''.join(cell(*c) for c in r)}</row>" for r in rows)
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Даты" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {rel}><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData>{body}</sheetData><hyperlinks><hyperlink ref="J2" r:id="h1"/></hyperlinks></worksheet>')
        z.writestr("xl/worksheets/_rels/s1.xml.rels", f'<Relationships {rel}><Relationship Id="h1" Target="http://a/b"/></Relationships>')
    cells = workbooks.workbook_cells(spark, str(tmp_path / "b.xlsx"))
    got = workbooks.dated_entities(cells).orderBy("id").collect()
    assert [(r["id"], r["university"], r["official_vacancies_link"]) for r in got] == [("u002", "Alpha", "http://a/b"), ("u004", "Gamma", "")]
    by_word = workbooks.keyword_entities(cells, {"name": ["вуз"], "num": ["№"]}, number="num").orderBy("row_idx").collect()
    assert [(r["id"], r["seq_id"], r["name"]) for r in by_word] == [(7, "u001", "Alpha"), (2, "u002", "Beta"), (3, "u003", "Gamma")]
    assert workbooks.sheet_matrices(cells).first()["rows"][0][:2] == ["Вуз", "№"]


def test_cells_that_meet_in_one_column(spark):
    rows = [("a", 2.0, 1, ["Код", "Бюджетные места"], [["01.03.02", "1"]]), ("a", 1.0, 2, ["Код", "Бюджет 1", "Бюджет 2"], [["01.03.03", "2", "2"], ["01.03.04", "2", "3"], ["01.03.05", "23", "3"]])]
    df = spark.createDataFrame(rows, "e string, score double, at int, columns array<string>, rows array<array<string>>")
    assert tables.merge_similar(df, ["e"], "at", 0.2).first()["rows"] == [["01.03.02", "1"], ["01.03.03", "2"], ["01.03.04", "2 3"], ["01.03.05", "23"]]


def test_noise_is_the_same_in_expressions_and_in_folds(spark):
    import itertools
    import random

    from tessera.operators import standardize as std

    rng = random.Random(1)
    words = ["", "", "01.03.02", "Итого", "5", "1.5", "Филиал x", "все курсы", "факультет институт журнал " * 12, "погода " * 40, "3 курс", "—", "x", "X"]
    names = ["code", "direction", "program", "level", "course", "form"]
    rows = [tuple(rng.choice(words) for _ in names) for _ in range(1500)] + [r for r in itertools.product(["", "5"], ["Филиал x", ""], ["Филиал x"], ["филиал X"], ["", "٣"], ["x"])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = df.select(*names, std.noise(*(F.col(n) for n in names)).alias("noise")).collect()
    assert {r["noise"] for r in got} == {True, False}
    for r in got:
        assert r["noise"] == std.noisy(r.asDict()), r


def test_folds_keep_tables_whole(spark):
    from tessera.operators.standardize import fold

    rows = [(k, i, "x") for k in (None, 1, 2, 3) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, pos int, v string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        count = lambda rows: [r | {"v": str(len(rows))} for r in rows if r["pos"] % 2]
        got = fold(df.repartition(3), "k", count, ["pos"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["k"]), r["pos"]) for r in got) == sorted((str(k), i) for k, i, _ in rows if i % 2) and {r["v"] for r in got} == {"150"}


def test_tables_of_any_length_are_standardised_whole(spark):
    """Rows far beyond 1200, over several Arrow batches: merged and carried forward across them."""
    names = ["Код", "Наименование специальности", "Курс", "Форма обучения", "Бюджет", "Платные"]
    cells = [[f"01.03.{i % 80 + 10}" if i % 3 == 0 else "", f"Направление {i}" if i % 3 < 2 else "", "1" if i % 3 != 1 else "", "", str(i % 50) if i % 3 != 1 else "", ""] for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = standardize(spark.createDataFrame([("t", names, cells), ("u", names, cells[:4])], TABLE)).orderBy("table_id", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    full = [(i, f"01.03.{j % 80 + 10}", f"Направление {j} Направление {j + 1}", str(i % 50)) for i in range(3000) if i % 3 != 1 for j in [i - i % 3]]
    assert [(r["pos"], r["code"], r["direction"], r["budget"]) for r in got if r["table_id"] == "t"] == full
    assert [r["pos"] for r in got if r["table_id"] == "u"] == [0, 2, 3]


def test_steps_over_rows_hold_few():
    from tessera.operators.standardize import FIELDS, carry, merge_continuations

    given = iter([dict.fromkeys(FIELDS, "") | {"code": "01.03.02", "direction": str(i), "has_other": True, "payload": True, "amount": True, "many": False, "last_course": ""} for i in range(100)])
    steps = iter(carry(merge_continuations(given)))
    assert [next(steps)["direction"] for _ in range(3)] == ["0", "1", "2"] and len(list(given)) >= 95
