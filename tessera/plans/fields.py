"""Queries of the column functions: codes, flags, numbers, texts, links, ids, normalisers, order, charsets, dates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, normalize, numbers, text
from ..operators import search, timeline
from ..sources import html_tables
from .registry import golden, pick, picked, query, table

HIGHER = "Высшее образование - "


@query(f"""WITH t AS (SELECT *, p_partkey % 40 + 1 AS a, p_partkey % 11 AS b, (p_partkey % 40 + 1) || '.' || (p_partkey % 11) || '.' || p_size AS code FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN code WHEN 1 THEN code END AS split_code, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) END AS split_text,
p_partkey % 5 = 2 AS is_code, p_partkey % 3 <> 2 AS is_number, lower(p_name) AS header,
CASE WHEN b = 2 THEN 'Среднее профессиональное образование' WHEN b = 3 THEN '{HIGHER}бакалавриат' WHEN b = 4 THEN '{HIGHER}магистратура' WHEN b = 5 THEN '{HIGHER}специалитет'
WHEN b = 6 OR (b IN (7, 8, 9) AND a < 10) THEN '{HIGHER}подготовка кадров высшей квалификации' ELSE '' END AS level FROM t""")
def study_codes(spark, d):
    """Codes told from texts, and the level that a code's middle group names."""
    code = F.concat_ws(".", (F.col("p_partkey") % 40 + 1), (F.col("p_partkey") % 11), "p_size")
    raw = [F.concat(code, F.lit(" – "), "p_name"), F.concat(code, F.lit(" "), F.upper("p_name")), code, F.concat("p_name", F.lit(" "), code), F.concat(F.lit("  "), code, F.lit("-7"))]
    p = table(spark, d, "part").select("*", F.element_at(F.array(*raw), (F.col("p_partkey") % 5 + 1).cast("int")).alias("raw"))
    split = text.split_code("raw")
    number = F.concat(F.col("p_size").cast("string"), pick([".5", "", ",5"], "p_partkey"))
    return p.select("p_partkey", split["code"].alias("split_code"), split["direction"].alias("split_text"), text.is_code("raw").alias("is_code"), text.is_numeric_cell(number).alias("is_number"), text.header(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  "))).alias("header"), text.level_from_code(code).alias("level"))


#: Cells, and by the rules: total or heading, form that a header names, looks like a level, like a form, yes or no.
CELLS = [
    ("Итого по курсу", True, "", False, False, None),
    ("Всего", True, "", False, False, None),
    ("Все курсы", True, "", False, False, None),
    ("—", True, "", False, False, False),
    ("Очно-заочная форма", False, "очно-заочная", False, True, None),
    ("заочная", False, "", False, True, None),
    ("заоч.", False, "заочная", False, False, None),
    ("Очная", False, "очная", False, True, None),
    ("дистанционно", False, "дистанционная", False, True, None),
    ("вечернее", False, "вечерняя", False, True, None),
    ("Высшее образование - бакалавриат", False, "", True, False, None),
    ("транспорт", False, "", True, False, None),
    ("Да", False, "", False, False, True),
    ("нет", False, "", False, False, False),
    (" + ", False, "", False, False, True),
    ("yes", False, "", False, False, True),
    ("0", False, "", False, False, False),
    ("", False, "", False, False, None),
]


@query(f"""SELECT c_custkey, g.* EXCLUDE (i) FROM customer JOIN {golden("g", "is_summary, form_literal, like_level, like_form, flag", [r[1:] for r in CELLS])} ON c_custkey % {len(CELLS)} = g.i""")
def cell_kinds(spark, d):
    """Totals, forms, levels and flags among cells."""
    raw = pick([r[0] for r in CELLS], "c_custkey")
    return table(spark, d, "customer").select("c_custkey", text.is_summary(raw).alias("is_summary"), text.form_literal(raw).alias("form_literal"), text.looks_like_level(raw).alias("like_level"), text.looks_like_form(raw).alias("like_form"), text.flag(raw).alias("flag"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS b, (o_orderkey % 6 + 1) AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN a || ';0;' || b WHEN 1 THEN a WHEN 2 THEN '' ELSE a || ';' || b END AS amounts, CASE k WHEN 0 THEN c || ';' || (c + 1) WHEN 2 THEN c::VARCHAR ELSE '' END AS courses,
CASE WHEN k <> 1 THEN o_orderkey END AS token, CASE k WHEN 1 THEN c::VARCHAR WHEN 3 THEN 'первый' ELSE '' END AS course, CASE WHEN k = 0 THEN o_orderkey + 0.5 ELSE 0 END::DOUBLE AS number FROM t""")
def number_tokens(spark, d):
    """Numbers, dashes and words in cells of amounts and courses."""
    a, b, c = (x.cast("string") for x in (F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 6 + 1))
    nth = lambda *v: F.element_at(F.array(*v), (F.col("o_orderkey") % 4 + 1).cast("int"))
    after = (F.col("o_orderkey") % 6 + 2).cast("string")
    amounts = nth(F.concat(a, F.lit(" - "), b), F.concat(a, F.lit(",7")), F.lit("Нет"), F.concat(a, F.lit("  "), b))
    courses = nth(F.concat(c, F.lit(" – "), after), F.lit("—"), F.concat(c, F.lit(" курс")), F.lit(""))
    token = nth(F.concat(a, F.lit(",9")), F.concat(F.lit("x"), a), a, F.concat(a, F.lit(".0")))
    course = nth(F.lit("Все курсы"), F.concat(c, F.lit(" курс")), F.lit("-"), F.lit("первый"))
    number = nth(F.concat(a, F.lit(".5")), F.lit("x"), F.lit("NaN"), F.lit(""))
    joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ";")
    return table(spark, d, "orders").select("o_orderkey", joined(numbers.amount_tokens(amounts)).alias("amounts"), joined(numbers.course_tokens(courses)).alias("courses"), numbers.int_token(token).alias("token"), numbers.course(course).alias("course"), numbers.to_number(number).alias("number"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_name || '; ' || p_type END AS appended,
CASE WHEN p_size % 3 = 0 THEN '' ELSE (p_size % 3)::VARCHAR END AS quality_text, lower(p_name) || ' x' AS comparable,
CASE WHEN length(p_name || ' ' || p_type) > 12 THEN rtrim(substr(p_name || ' ' || p_type, 1, 12)) || '…' ELSE p_name || ' ' || p_type END AS short,
CASE WHEN p_partkey % 3 = 2 AND length(p_name) >= 4 THEN p_name END AS kept, p_name || '; ' || p_type || '; ' || p_brand AS long_text, p_name || ' ' || p_type AS item,
coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'http://a.example/' || p_partkey END, 'https://b.example/x') AS link FROM part""")
def text_edits(spark, d):
    """Joining, shortening, tidying and links of cells."""
    n, t = F.col("p_name"), F.col("p_type")
    nth = lambda *v: F.element_at(F.array(*v), (F.col("p_partkey") % 4 + 1).cast("int"))
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://a.example/"), "p_partkey"))
    return table(spark, d, "part").select(
        "p_partkey",
        text.append_text(nth(F.concat(n, F.lit(" ")), n, F.lit(""), n), nth(n, F.lit(None), t, t)).alias("appended"),
        text.clean_qa(F.col("p_size") % 3).alias("quality_text"),
        normalize.comparable(F.concat(F.lit("  "), F.upper(n), F.lit("  x "))).alias("comparable"),
        text.short_text(F.concat_ws(" ", n, t), 12).alias("short"),
        text.without_sentinel(F.when(F.col("p_partkey") % 3 == 0, "nan").when(F.col("p_partkey") % 3 == 1, "ab").otherwise(n), 4).alias("kept"),
        text.long_text(F.concat(n, F.lit("\n;"), t, F.lit(" ; "), "p_brand")).alias("long_text"),
        text.item_text(F.concat(F.lit("•— "), n, F.lit("\t"), t, F.lit(" ; ;"))).alias("item"),
        text.cell_link(link, F.lit("see https://b.example/x, or not")).alias("link"),
    )


@query(r"""WITH p AS (SELECT page_id, url, html, CASE page_id % 5 WHEN 0 THEN 'http://x.example/a.PDF' WHEN 1 THEN 'http://x.example/b.xls?v=1' WHEN 2 THEN 'http://x.example/c.csv' WHEN 3 THEN url ELSE 'http://x.example/d' END AS u FROM pages)
SELECT page_id, len(regexp_extract_all(html, '(?i)https?://[^\s<>\]\)\};,]+'))::INTEGER AS n_urls, regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\.', '') AS host,
CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 2 THEN 'csv' WHEN 3 THEN 'html' ELSE CASE page_id % 3 WHEN 0 THEN 'excel' WHEN 1 THEN 'pdf' ELSE 'csv' END END AS source_type,
replace(replace(replace(replace(url, '?', '%3F'), '&', '%26'), '=', '%3D'), '#', '%23') AS query_value FROM p""")
def link_parts(spark, d):
    """Links in pages, their hosts, types of sources, and a link as a query's value."""
    p = table(spark, d, "pages")
    nth = lambda n, *v: F.element_at(F.array(*v), (F.col("page_id") % n + 1).cast("int"))
    u = nth(5, F.lit("http://x.example/a.PDF"), F.lit("http://x.example/b.xls?v=1"), F.lit("http://x.example/c.csv"), F.col("url"), F.lit("http://x.example/d"))
    kind = F.when(F.col("page_id") % 5 == 4, nth(3, F.lit("application/vnd.ms-excel"), F.lit("application/PDF"), F.lit("text/csv"))).otherwise("text/html")
    only = F.replace(F.replace(text.query_value("url"), F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))
    return p.select("page_id", F.size(text.urls("html")).alias("n_urls"), text.host("url").alias("host"), text.source_type(u, kind).alias("source_type"), only.alias("query_value"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1)) AS href, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a>', 1)))) AS place FROM pages)
SELECT page_id, place::INTEGER AS place, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN href = '' THEN url WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href ELSE href END AS link FROM a""")
def absolute_links(spark, d):
    """Every anchor's link against its page's address."""
    rows = html_tables.links(table(spark, d, "pages"))
    return html_tables.with_absolute(rows, "url", "href", "link").select("page_id", "place", "href", "link")


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS tag, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')))) AS place FROM pages),
b AS (SELECT page_id, url, place, regexp_extract(tag, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g') AS words FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN href = '' THEN url WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href ELSE href END AS link FROM b),
e AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(link, '[?#].*$', ''), '(?i)\.(pdf|xlsx?|csv)$') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(words || ' ' || link), 'the') THEN 4.0 ELSE 0 END + CASE WHEN contains(lower(words || ' ' || link), 'de') THEN 4.0 ELSE 0 END AS score FROM c),
f AS (SELECT page_id, link, max(score)::DOUBLE AS score, min(place) AS place FROM e WHERE score > 0 GROUP BY page_id, link)
SELECT page_id, link, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place)::INTEGER AS rank FROM f) WHERE rank <= 10""")
def download_links(spark, d):
    """Scored download links; the driver's pages have no such files, so two words of theirs stand in."""
    return html_tables.download_links(table(spark, d, "pages"), words=["the", "de"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'abc' || c_custkey ELSE 'u' || CASE WHEN c_custkey < 1000 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END END AS id,
'u' || CASE WHEN c_custkey < 1000 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END || ',u007,x' AS ids FROM customer
WHERE c_custkey IN (SELECT s_suppkey FROM supplier) OR c_custkey IN (4, 5)""")
def entity_ids(spark, d):
    """Ids in their spellings, lists of ids, and rows of an allow-list: a table of ids or a few of them."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer")
    allowed = search.only(c, "c_custkey", table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")))
    c = allowed.union(search.only(c, "c_custkey", [4, 5])).dropDuplicates(["c_custkey"])
    raw = F.element_at(F.array(k, F.concat(F.lit("u"), k), F.concat(F.lit(" U0"), k), F.concat(k, F.lit(" ")), F.concat(F.lit("ABC"), k)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", text.entity_id(raw).alias("id"), F.array_join(text.entity_ids(F.concat(F.lit(" "), k, F.lit("; u7,  X "))), ",").alias("ids"))


#: Levels, and by the rules of the page, of quality control, of the profile (key and title), and the page's label.
LEVELS = [
    ("Высшее образование - специалитет", "высшее", "специалитет", "spec", "Специалитет", "Высшее"),
    ("Бакалавриат", "бакалавриат", "бакалавриат", "bak", "Бакалавриат", "Бакалавриат"),
    ("магистратура ", "магистратура", "магистратура", "mag", "Магистратура", "Магистратура"),
    ("Среднее профессиональное", "спо", "спо", "spo", "СПО", "СПО"),
    ("транспорт", "спо", "транспорт", "spo", "СПО", "СПО"),
    ("Высшее образование – подготовка кадров высшей квалификации", "аспирантура", "аспирантура", "higher", "Высшее (не уточнено)", "Аспирантура"),
    ("ординатура", "ординатура", "ординатура", "ord", "Ординатура", "Ординатура"),
    ("Дополнительное", "дополнительное", "дополнительное", "dpo", "Доп. образование", "Дополнительное"),
    ("", "", "", "", "", "Не указано"),
    ("ВЫСШЕЕ", "высшее", "высшее", "higher", "Высшее (не уточнено)", "Высшее"),
]
#: Forms: of the page, of quality control, the page's label.
FORMS = [
    ("Очно - заочная", "очно-заочная", "очно-заочная", "Очно-заочная"),
    ("ЗАОЧНАЯ", "заочная", "заочная", "Заочная"),
    ("очная форма", "очная", "очная", "Очная"),
    ("онлайн", "дистанционная", "онлайн", "Дистанционная"),
    ("—", "", "", "не указана"),
    ("нет данных", "", "", "не указана"),
    ("семейная", "семейная", "семейная", "Семейная"),
]
#: Courses: of the page, of quality control, the page's label.
COURSES = [
    ("5-6 курс", "5-6 курс", "5", "5-6 курс"),
    ("3 курса", "3", "3", "3 курс"),
    ("0", "", "", "Не указан"),
    ("первый", "первый", "первый", "первый"),
    ("2", "2", "2", "2 курс"),
]
KINDS = [("federal", "Федеральный"), ("art", "Творческий"), ("other", "other"), ("", "")]
STATUSES = [("OK", "ok"), ("partial", "partial"), ("loaded", "error")]


@query(f"""SELECT c_custkey, l.* EXCLUDE (i), f.* EXCLUDE (i), c.* EXCLUDE (i), t.* EXCLUDE (i), s.* EXCLUDE (i) FROM customer
JOIN {golden("l", "ui_level, qa_level, level_key, level_title, level_label", [r[1:] for r in LEVELS])} ON c_custkey % {len(LEVELS)} = l.i
JOIN {golden("f", "ui_form, qa_form, form_label", [r[1:] for r in FORMS])} ON c_custkey % {len(FORMS)} = f.i
JOIN {golden("c", "ui_course, qa_course, course_label", [r[1:] for r in COURSES])} ON c_custkey % {len(COURSES)} = c.i
JOIN {golden("t", "type_label", [r[1:] for r in KINDS])} ON c_custkey % {len(KINDS)} = t.i
JOIN {golden("s", "status_label", [r[1:] for r in STATUSES])} ON c_custkey % {len(STATUSES)} = s.i""")
def normalisers(spark, d):
    """The three families of normalisers, and labels."""
    level, form, course, kind, status = (pick([r[0] for r in rows], "c_custkey") for rows in (LEVELS, FORMS, COURSES, KINDS, STATUSES))
    n = normalize
    found = {
        "ui_level": n.ui_level(level), "qa_level": n.qa_level(level), "level_key": n.profile_level(level), "level_title": n.profile_title(n.profile_level(level)), "level_label": n.level_label(level),
        "ui_form": n.ui_form(form), "qa_form": n.qa_form(form), "form_label": n.form_label(form), "ui_course": n.ui_course(course), "qa_course": n.qa_course(course), "course_label": n.course_label(course),
        "type_label": n.type_label(kind), "status_label": n.status_label(status),
    }
    return table(spark, d, "customer").select("c_custkey", *(c.alias(name) for name, c in found.items()))


@query("""SELECT p_partkey, lower(p_brand) || '|' || p_name || '|' || lower(p_type) || '|' || CASE p_partkey % 2 WHEN 0 THEN 'магистратура' ELSE 'высшее' END || '|' || (p_partkey % 4 + 1) || '|очная|' || p_size || '|' || CASE WHEN p_partkey % 3 = 0 THEN (p_size + 0.5)::DECIMAL(9, 1)::VARCHAR ELSE '0' END AS row_key FROM part""")
def row_keys(spark, d):
    """Rows named by their normalised fields."""
    p = table(spark, d, "part").select("*", pick(["Магистратура", HIGHER + "специалитет"], "p_partkey").alias("level"), F.concat((F.col("p_partkey") % 4 + 1).cast("string"), F.lit(" курс")).alias("course"), F.lit("Очная").alias("form"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 0.5).cast("string").alias("paid"))
    return p.select("p_partkey", normalize.row_key("p_brand", "p_name", "p_type", "level", "course", "form", "p_size", "paid").alias("row_key"))


PREFIXES = ["ель ", "Ёлка ", "ЕЛЬ ", "Éa ", "eb "]


@query(f"""WITH t AS (SELECT p_partkey, p_brand, {picked(PREFIXES, "p_partkey")} AS raw, ([4, 3, 4, 1, 2])[p_partkey % 5 + 1] AS k, p_size, p_partkey::HUGEINT * 100000000000000000000 + p_partkey AS big FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_size, big)::INTEGER AS place FROM t""")
def collation_order(spark, d):
    """Texts in the order that people expect: blind to case and accents, numbers of any length by value."""
    big = F.concat(F.col("p_partkey").cast("string"), F.lpad(F.col("p_partkey").cast("string"), 20, "0"))
    raw = F.concat(pick(PREFIXES, "p_partkey"), F.col("p_size").cast("string"), F.lit("."), big)
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(normalize.collation_key(raw)))
    return table(spark, d, "part").select("p_partkey", place.alias("place"))


@query("""WITH t AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + (p_partkey % 3 = 1)::INTEGER * 0.5 END AS number, p_name FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY number NULLS LAST, CASE WHEN number IS NULL THEN p_name END NULLS FIRST, p_partkey)::INTEGER AS place FROM t""")
def mixed_order(spark, d):
    """Numbers by value, then texts."""
    value = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, (F.col("p_size") + 0.5).cast("string")).otherwise(F.col("p_size").cast("string"))
    p = table(spark, d, "part").withColumn("value", value)
    return p.select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(*search.mixed_order("value"), "p_partkey")).alias("place"))


#: Words, wrongly decoded below, and what is not to be changed.
WORDS = ["Автомобили", "Магистратура", "Направление подготовки", "Русский язык", "экономика и право"]


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{85}}]+', ' ', 'g'))) AS cleaned,
{picked(WORDS, "doc_id")} AS from_latin, {picked(WORDS, "doc_id")} AS from_cyrillic, {picked(WORDS, "doc_id")} AS untouched, 'café' AS accented, (length(regexp_replace({picked(WORDS, "doc_id")}, ' ', '', 'g')))::INTEGER - (regexp_matches({picked(WORDS, "doc_id")}, '[РС][а-я]'))::INTEGER AS quality FROM documents""")
def mojibake(spark, d):
    """Whole texts cleaned with charset recovery, and words decoded wrongly in two ways, brought back."""
    word = pick(WORDS, "doc_id")
    garbled = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    twisted = F.translate(word, "".join(chr(0x410 + i) for i in range(64)), "".join(chr(0xC0 + i) for i in range(64)))  # one byte a letter
    back = lambda c: text.clean_recovered(c)
    return table(spark, d, "documents").select("doc_id", F.sha2(back("text").cast("binary"), 256).alias("cleaned"), back(garbled).alias("from_latin"), back(twisted).alias("from_cyrillic"), back(word).alias("untouched"), back(F.lit("café")).alias("accented"), text.text_quality(word).alias("quality"))


MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
NAMES = ["январь", "февраль", "март", "апрель", "мая", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]

_DATES = f"""WITH t AS (SELECT o_orderkey, o_orderkey % 8 AS k, (month(o_orderdate) - 1)::INTEGER AS m, day(o_orderdate)::INTEGER AS day, ((month(o_orderdate) + 1) % 12)::INTEGER AS m2 FROM orders),
p AS (SELECT o_orderkey, k, m, day,
 CASE k WHEN 7 THEN NULL WHEN 3 THEN CASE WHEN day > 21 THEN m ELSE (m + 11) % 12 END ELSE m END AS sm,
 CASE k WHEN 7 THEN NULL WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN day > 21 THEN 1 ELSE 15 END ELSE 1 END AS sd,
 CASE k WHEN 7 THEN NULL WHEN 0 THEN m2 WHEN 1 THEN m2 WHEN 5 THEN m2 ELSE m END AS em,
 CASE k WHEN 7 THEN NULL WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN day WHEN 3 THEN day WHEN 4 THEN 10 WHEN 5 THEN 28 ELSE 28 END AS ed,
 CASE WHEN k < 7 THEN k >= 3 END AS approx FROM t)"""


def _date_text():
    m, day, m2 = F.month("o_orderdate"), F.dayofmonth("o_orderdate").cast("string"), (F.month("o_orderdate") + 1) % 12 + 1
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    forms = [
        F.concat(day, F.lit("."), two(m), F.lit(" – 5."), two(m2), F.lit(" (бюджет)")),
        F.concat(day, F.lit(" "), of(MONTHS, m), F.lit(" 2024 — 5 "), of(MONTHS, m2)),
        F.concat(F.lit("1-"), day, F.lit(" "), of(MONTHS, m), F.lit(" 2024")),
        F.concat(F.lit("Не позднее  "), day, F.lit(" "), of(MONTHS, m), F.lit(" 18:00")),
        F.concat(F.lit("1-я неделя "), of(MONTHS, m)),
        F.concat(of(NAMES, m), F.lit("–"), of(NAMES, m2)),
        F.concat(F.lit("набор ("), of(NAMES, m), F.lit(")")),
        F.lit("уточняется"),
    ]
    return F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))


@query(_DATES + """ SELECT o_orderkey, sm AS start_month, sd AS start_day, em AS end_month, ed AS end_day, approx, m AS month_index FROM p""")
def ru_dates(spark, d):
    """Year-less ranges in seven ways of writing, and texts without one."""
    o = table(spark, d, "orders").select("o_orderkey", dates.parse_range(_date_text()).alias("r"), dates.month_index(F.upper(F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate")))).alias("month_index"))
    return o.select("o_orderkey", "r.start_month", "r.start_day", "r.end_month", "r.end_day", "r.approx", "month_index")


@query(_DATES + """, w AS (SELECT o_orderkey, 'summer' AS wave, CASE WHEN sm IN (2,3,4,5,6,7,8,9) THEN sm END AS start_month, sd, list_position([2,3,4,5,6,7,8,9], sm) - 1 AS place FROM p
UNION ALL SELECT o_orderkey, 'winter', CASE WHEN sm IN (10,11,0,1,2,3) THEN sm WHEN k = 7 THEN 11 END, CASE WHEN k = 7 THEN 8 ELSE sd END, list_position([10,11,0,1,2,3], CASE WHEN k = 7 THEN 11 ELSE sm END) - 1 FROM p)
SELECT o_orderkey, wave, start_month, (CASE WHEN start_month IS NOT NULL THEN place * 31 + sd END)::BIGINT AS sort_key, CASE WHEN start_month IS NOT NULL AND wave = 'summer' THEN 6 END AS pub_month, CASE WHEN wave = 'summer' THEN 4 END::INTEGER AS pub_day,
round(CASE WHEN start_month IS NOT NULL THEN place * 600.0 / CASE wave WHEN 'summer' THEN 8 ELSE 6 END + (sd - 1) / 30.0 * 600.0 / CASE wave WHEN 'summer' THEN 8 ELSE 6 END END, 6) AS track, start_month IS NOT NULL AS is_dated FROM w""")
def ru_timeline(spark, d):
    """Both waves of every entity: dated or vague, in order, with the day of publication and the place on a track."""
    raw = _date_text()
    winter = F.when(F.col("o_orderkey") % 8 == 7, F.lit("уточняется; 8 декабря – 25 января")).otherwise(raw)
    o = table(spark, d, "orders").select("o_orderkey", raw.alias("summer"), winter.alias("winter"), F.lit("1 июля – 6 июля").alias("vacPubSummer"), F.lit("").alias("vacPubWinter"))
    rows = timeline.ordered(timeline.timeline(o, "o_orderkey"))
    track = F.when(F.col("wave") == "summer", dates.track_position(F.col("parsed.start_month"), F.col("parsed.start_day"), dates.SUMMER_MONTHS, 600.0)).otherwise(dates.track_position(F.col("parsed.start_month"), F.col("parsed.start_day"), dates.WINTER_MONTHS, 600.0))
    return rows.select("o_orderkey", "wave", "parsed.start_month", F.col("sort_key").cast("long").alias("sort_key"), "pub_month", F.when(F.col("wave") == "summer", F.col("pub_day")).alias("pub_day"), F.round(track, 6).alias("track"), "is_dated")


#: Chunks, and whether they name the winter's or the summer's season.
CHUNKS = [("1–14 июня", False, True), ("8 декабря – 25 января", True, False), ("март", False, False), ("зимой и летом", True, True), ("до 5 мая", False, False), ("май", False, True)]


@query(f"""WITH t AS (SELECT o_orderkey, unnest([0, 1]) AS pos FROM orders), c AS (SELECT o_orderkey, pos, g.* EXCLUDE (i) FROM t JOIN {golden("g", "chunk, winter, summer", CHUNKS)} ON (o_orderkey + pos * (1 + o_orderkey // 6)) % 6 = g.i)
SELECT o_orderkey, coalesce(string_agg(chunk, '; ' ORDER BY pos) FILTER (WHERE winter), '') AS winter, coalesce(string_agg(chunk, '; ' ORDER BY pos) FILTER (WHERE summer), '') AS summer, coalesce(string_agg(chunk, '; ' ORDER BY pos) FILTER (WHERE NOT winter AND NOT summer), '') AS other FROM c GROUP BY o_orderkey""")
def seasons(spark, d):
    """A text's chunks by season."""
    first = pick([c[0] for c in CHUNKS], "o_orderkey")
    second = pick([c[0] for c in CHUNKS], "o_orderkey + 1 + o_orderkey div 6")
    split = dates.season_split(F.concat(F.lit(" "), first, F.lit(" ; . "), second, F.lit(".;")))
    return table(spark, d, "orders").select("o_orderkey", *(F.array_join(split[n], "; ").alias(n) for n in ("winter", "summer", "other")))
