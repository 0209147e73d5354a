"""Tables as rows: ``columns array<string>, rows array<array<string>>``. Headers, metrics, scores, similarity, merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CODE, LEVEL_WORDS, any_of, clean, collapse_duplicates, form_of, header, let, looks_like_form, looks_like_level

#: Word lists of the scoring rules.
TABLE_WORDS = ["вакант", "мест", "бюджет", "направлен", "специальн", "курс", "очная", "заочная", "колич", "финанс", "обуч"]
MENU_WORDS = ["факультет", "институт", "библиот", "журнал", "расписан", "подраздел", "отдел", "служб", "центр", "деятельность", "консультац"]
HEADER_WORDS = ["код", "наименован", "курс", "форма", "уровень", "бюдж"]
PAID_WORDS = ["плат", "договор", "средств физ", "средств юрид", "внебюдж"]
BUDGET_WORDS = ["бюджет", "ассигн", "фед", "субъект", "местн"]
PROGRAM_WORDS = ["образовательная программа", "направленност", "профил", "специализац"]
BLOCKED_WORDS = ["код", "курс", "форма", "уровень", "бюдж", "договор", "плат", "ассигн", "субъект", "местн", "фед"]
PLAIN_DIRECTIONS = ["специальность", "направление", "направление подготовки", "направления подготовки"]
GENERIC = r"(?iu)^колонка\s*\d+$"


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words the text holds."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def best_index(heads: Column, scorer: Callable[[Column], Column]) -> Column:
    """The first place of the highest positive score (from 0), else null. heads: of each column what ``header`` gives."""
    scored = F.transform(heads, lambda h, i: F.struct(scorer(h).alias("score"), (-i).alias("place")))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, -best["place"])


def _has(h: Column, w: str) -> Column:
    return F.contains(h, F.lit(w))


def is_paid(h: Column) -> Column:
    n = hits(h, PAID_WORDS)
    return (n > 0) & (n >= hits(h, BUDGET_WORDS))


def is_budget(h: Column) -> Column:
    return ~is_paid(h) & any_of(h, BUDGET_WORDS)


def _points(*rules: tuple[int, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(n)).otherwise(F.lit(0)) for n, c in rules])


def code_score(h: Column) -> Column:
    return _points((2, _has(h, "код")), (2, any_of(h, ["специальн", "направлен", "професс", "шифр"])))


def direction_score(h: Column) -> Column:
    subject = any_of(h, ["специальн", "направлен"])
    return _points(
        (3, _has(h, "наимен") & (subject | _has(h, "професс"))),
        (2, subject),
        (2, h.isin(PLAIN_DIRECTIONS)),
        (2, h.isin("наименование", "наименование наименование")),
        (2, h.startswith("наименование")),
        (1, _has(h, "подготов") & _has(h, "направлен")),
        (-2, _has(h, "код")),
        (-2, any_of(h, PROGRAM_WORDS)),
    )


def form_score(h: Column) -> Column:
    return F.when(_has(h, "форм") & _has(h, "обуч"), 5).when(h.rlike(r"(?U)\bформа\b"), 4).when(h.startswith("форм"), 3).otherwise(0)


def column_share(rows: Column, place: Column, test: Callable[[Column], Column]) -> Column:
    """Share of a column's non-empty values for which the test holds."""
    values = F.filter(F.transform(rows, lambda r: clean(F.get(r, place))), lambda v: v != "")
    good = F.size(F.filter(values, test))
    return F.when(F.size(values) > 0, good / F.size(values)).otherwise(0.0)


def column_shares(rows: DataFrame, keys: list[str], value: str, tests: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and, for each test, the share of a group's non-empty values for which it holds: one aggregation, for groups of any size."""
    v = clean(F.col(value).cast("string"))
    n = F.count_if(v != "")
    return rows.groupBy(*keys).agg(*(F.when(n > 0, F.count_if((v != "") & test(v)) / n).otherwise(0.0).alias(name) for name, test in tests.items()))


def _places(heads: Column, test: Callable[[Column], Column]) -> Column:
    marked = F.transform(heads, lambda h, i: F.when(test(h), i))
    return F.filter(marked, lambda i: i.isNotNull())


def with_roles(tables: DataFrame) -> DataFrame:
    """The tables with ``roles``: places of the fields, amount columns, course groups and the default form."""
    heads, rows = F.col("_heads"), F.col("rows")
    tables = settled(tables.withColumn("_heads", F.transform("columns", header)), "_heads")  # cleaned once, tested a dozen times
    fallback = F.array_min(_places(heads, lambda h: _has(h, "наимен") & ~any_of(h, BLOCKED_WORDS)))
    named = tables.withColumns(
        {
            "_code": best_index(heads, code_score),
            "_direction": F.coalesce(best_index(heads, direction_score), fallback),
            "_program": best_index(heads, lambda h: _points((3, any_of(h, PROGRAM_WORDS)))),
            "_level": best_index(heads, lambda h: _points((3, _has(h, "уровень") & _has(h, "образован")))),
            "_course": best_index(heads, lambda h: _points((3, _has(h, "курс") & ~_has(h, "курсов")))),
            "_form": best_index(heads, form_score),
        }
    )
    named = settled(named, "_code", "_direction", "_program", "_level", "_course", "_form")
    literals = F.array_distinct(F.filter(F.transform(heads, form_of), lambda x: x != ""))
    course = F.filter(F.transform(heads, lambda h, i: F.struct(F.regexp_extract(h, r"(\d{1,2})\s*курс", 1).alias("course"), h.alias("head"), i.alias("place"))), lambda g: g["course"] != "")
    groups = F.transform(course, lambda g: F.struct(g["course"].alias("course"), is_paid(g["head"]).alias("paid"), g["place"].alias("place")))
    use_groups = F.size(F.array_distinct(F.transform(groups, lambda g: g["course"]))) >= 2
    roles = F.struct(
        F.col("_code").alias("code"),
        F.col("_direction").alias("direction"),
        F.col("_program").alias("program"),
        F.when(F.col("_level").isNotNull() & (column_share(rows, F.col("_level"), looks_like_level) >= 0.3), F.col("_level")).alias("level"),
        F.col("_course").alias("course"),
        F.when(F.col("_form").isNotNull() & (column_share(rows, F.col("_form"), looks_like_form) >= 0.4), F.col("_form")).alias("form"),
        F.when(F.size(literals) == 1, F.get(literals, F.lit(0))).otherwise(F.lit("")).alias("default_form"),
        _places(heads, is_budget).alias("budget"),
        _places(heads, is_paid).alias("paid"),
        F.when(use_groups, groups).otherwise(F.filter(groups, lambda g: F.lit(False))).alias("groups"),
    )
    return named.withColumn("roles", roles).drop("_heads", "_code", "_direction", "_program", "_level", "_course", "_form")


def header_kind(c: Column) -> Column:
    """One of 13 kinds; the first rule that holds."""
    return let(header(c), _kind)


def _kind(h: Column) -> Column:
    has = lambda w: _has(h, w)
    kinds = [
        (h == "", "unknown"),
        (has("п/п") | h.isin("№", "номер"), "ordinal"),
        (is_paid(h), "paid"),
        (has("субъект"), "budget_subject"),
        (has("местн"), "budget_local"),
        (is_budget(h) & (has("фед") | has("ассигн")), "budget_federal"),
        (is_budget(h), "budget_other"),
        (has("курс") & ~has("курсов"), "course"),
        ((has("форм") & has("обуч")) | h.rlike(r"(?U)\bформа\b"), "form"),
        (has("уровень") & has("образован"), "level"),
        (any_of(h, PROGRAM_WORDS), "program"),
        (has("код"), "code"),
        (has("наимен") & any_of(h, ["специальн", "направлен", "професс"]), "direction"),
        (h.startswith("наименование"), "direction"),
    ]
    out = F.when(*[F.lit(False), F.lit("")])
    for test, name in kinds:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def _blob(rows: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(rows, 1, n), lambda r: F.array_join(r, " ")), " ")


def _count(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(xs, test))


def metrics(columns: Column, rows: Column) -> dict[str, Column]:
    sample = F.lower(_blob(rows, 12))
    menu = reduce(lambda a, b: a + b, [F.regexp_count(sample, F.lit(w)) for w in MENU_WORDS])
    return {
        "digit_ratio": F.regexp_count(sample, F.lit(r"\p{Nd}")) / F.greatest(F.length(sample), F.lit(1)),
        "menu_hits": menu.cast("double"),
        "generic_cols": _count(columns, lambda c: F.trim(c).rlike(GENERIC)).cast("double"),
        "unnamed_cols": _count(columns, lambda c: _has(F.lower(c), "unnamed")).cast("double"),
        "max_col_len": F.coalesce(F.array_max(F.transform(columns, F.length)), F.lit(0)).cast("double"),
        "header_hits": _count(columns, lambda c: any_of(F.lower(c), HEADER_WORDS)).cast("double"),
    }


def base_score(columns: Column, rows: Column) -> Column:
    sample = F.lower(F.concat_ws(" ", F.array_join(columns, " "), _blob(rows, 15)))
    wide = F.size(columns)
    return 6.0 * hits(sample, TABLE_WORDS) + F.least(F.size(rows), F.lit(400)) / 20 + F.least(wide, F.lit(20)) / 3 - F.when(wide <= 1, 8).otherwise(0)


def score(columns: Column, rows: Column) -> Column:
    """The score of HTML tables; Excel and CSV use ``base_score`` alone."""
    m = metrics(columns, rows)
    wide = F.size(columns)
    share = F.when(wide > 0, m["generic_cols"] / wide).otherwise(0.0)
    out = base_score(columns, rows) + m["digit_ratio"] * 40 + m["header_hits"] * 2.5 - m["menu_hits"] * 3 - m["generic_cols"] * 5 - m["unnamed_cols"] * 8
    return out - share * 40 - F.when(share > 0.4, 15).otherwise(0) - F.when(wide > 60, 25).otherwise(0) - F.when(m["max_col_len"] > 280, 12).otherwise(0)


def is_layout(columns: Column, rows: Column) -> Column:
    m, wide = metrics(columns, rows), F.size(columns)
    return (
        (wide > 80)
        | (F.size(rows) < 2)
        | ((m["digit_ratio"] < 0.01) & (m["menu_hits"] >= 2))
        | ((m["generic_cols"] >= F.greatest(F.lit(2), F.floor(wide / 2))) & (m["digit_ratio"] < 0.02))
        | ((m["max_col_len"] > 500) & (wide <= 2))
    )


def row_similarity(a: Column, b: Column) -> Column:
    """Share of places where both rows hold the same non-empty text, whatever its case."""
    same = F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit("")) != "") & (F.lower(x) == F.lower(y)))
    n = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _count(same, lambda x: x) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (arrays without repeats)."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def header_similarity(a: Column, b: Column) -> Column:
    full = lambda v: F.array_distinct(F.filter(v, lambda s: s != ""))
    both = F.struct(F.transform(a, header).alias("x"), F.transform(b, header).alias("y"))
    sets = lambda h: let(F.struct(full(h["x"]).alias("x"), full(h["y"]).alias("y")), lambda s: jaccard(s["x"], s["y"]))
    return let(both, lambda h: F.greatest(row_similarity(h["x"], h["y"]), sets(h)))


def best_table(tables: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key's tables that are no layout, the one of the highest score, the first of equals."""
    kept = tables.filter(~is_layout(F.col("columns"), F.col("rows")))
    kept = settled(kept.withColumn("score", score(F.col("columns"), F.col("rows"))), "score")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), *order))
    return kept.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merge_similar(tables: DataFrame, keys: list[str], order: str, least: float = 0.55) -> DataFrame:
    """One table per key: distinct rows of the tables whose headers are like those of the best-scored one.

    Rows of tables of another width are aligned by header kind, then by place. Rows that echo the header go.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), order))
    anchors = tables.withColumn("_rank", rank).filter("_rank = 1").select(*keys, F.col("columns").alias("anchor"))
    near = tables.join(anchors, keys).filter(header_similarity(F.col("anchor"), F.col("columns")) >= least)
    kinds = lambda c: F.transform(c, header_kind)
    near = near.withColumns({"_source": kinds(F.col("columns")), "_target": kinds(F.col("anchor"))})

    def target_place(c: Column, i: Column) -> Column:
        alike = F.filter(F.sequence(F.lit(0), F.size("anchor") - 1), lambda j: F.get("_target", j) == F.get("_source", i))
        points = F.transform(alike, lambda j: F.struct(align_points(c, F.get("anchor", j)).alias("p"), (-j).alias("j")))
        return F.coalesce(-F.array_max(points)["j"], i)

    # Where each column goes is worked out once a table, before its rows are taken apart.
    near = near.withColumn("_to", F.transform("columns", target_place)).withColumn("_same", F.size("columns") == F.size("anchor"))
    rows = near.select(*keys, "anchor", "_to", "_same", "score", order, F.posexplode("rows").alias("_at", "row"))
    rows = rows.withColumn("row", F.transform("row", clean))
    goes = lambda j: F.filter("row", lambda v, i: (F.get("_to", i) == j) & (v != ""))
    # Cells that meet in one column are joined, but for those that it holds already.
    add = lambda a, v: F.when(a == "", v).when(F.contains(a, v), a).otherwise(F.concat(a, F.lit(" "), v))
    aligned = F.transform("anchor", lambda _, j: F.aggregate(goes(j), F.lit(""), add))
    rows = rows.withColumn("row", F.when(F.col("_same"), F.col("row")).otherwise(aligned))
    rows = rows.filter(F.exists("row", lambda v: v != "")).filter(row_similarity(F.col("row"), F.col("anchor")) <= 0.8)
    first = rows.groupBy(*keys, "anchor", "row").agg(F.min(F.struct(order, "_at")).alias("first"), F.max("score").alias("score"))
    return first.groupBy(*keys, F.col("anchor").alias("columns")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "row"))), lambda r: r["row"]).alias("rows"), F.max("score").alias("score"))


#: Tokens that make two headers of one kind belong together.
ALIGN_WORDS = ["фед", "субъект", "местн", "плат", "договор", "курс", "форма", "уровень"]


def align_points(a: Column, b: Column) -> Column:
    def points(x: Column, y: Column) -> Column:
        shared = [F.when(_has(x, w) & _has(y, w), 2).otherwise(0) for w in ALIGN_WORDS]
        return reduce(lambda p, q: p + q, shared) + F.when(x == y, 3).otherwise(0)

    return let(F.struct(header(a).alias("x"), header(b).alias("y")), lambda h: points(h["x"], h["y"]))


def merge_runs(df: DataFrame, keys: list[str], order: str, by: str, text: str) -> DataFrame:
    """Neighbouring rows with the same ``by`` as one: keys, least order, by, n, and their texts joined by blanks."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_new", F.when(F.col(by) == F.lag(by).over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return marked.groupBy(*keys, "_run").agg(F.min(order).alias(order), F.min(by).alias(by), F.count("*").alias("n"), joined.alias(text)).drop("_run")


def unpivot(df: DataFrame, keys: list[str], columns: list[str], place: str, value: str) -> DataFrame:
    """Wide to long: a row for each column, with its place from 1. Zeros stay."""
    return df.select(*keys, F.posexplode(F.array(*columns)).alias("_at", value)).select(*keys, (F.col("_at") + 1).alias(place), value)


def unique_headers(columns: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """Repeated header names get a running number from the second on."""
    n = F.row_number().over(W.partitionBy(*keys, name).orderBy(place))
    return columns.withColumn("n", n).withColumn("unique_name", F.when(F.col("n") > 1, F.concat(F.col(name), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col(name)))


def inferred_name(values: Column) -> Column:
    """A header from a column's values, by ordered shares; null where none fits."""
    v = F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")
    n = F.size(v)
    share = lambda test: _count(v, test) / F.greatest(n, F.lit(1))
    length = F.aggregate(v, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(n, F.lit(1))
    letters = lambda x: F.regexp_replace(x, "[^A-Za-zА-Яа-яЁё]", "")
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(share(lambda x: _has(F.lower(x), "курс")) >= 0.45, F.lit("Курс"))
        .when(share(looks_like_form) >= 0.45, F.lit("Форма"))
        .when(share(lambda x: x.rlike(rf"\b{CODE}\b")) >= 0.4, F.lit("Код"))
        .when(share(lambda x: any_of(F.lower(x), LEVEL_WORDS[:-1])) >= 0.35, F.lit("Уровень"))
        .when((length >= 18) & (share(lambda x: x.rlike("[А-Яа-яЁё]")) >= 0.6), F.lit("Направление"))
        .when((share(lambda x: (letters(x) != "") & (letters(x) == F.upper(letters(x)))) >= 0.6) & (length <= 8), F.lit("Подразделение"))
    )

#: The layout of tables with 24 unnamed columns, four fields and five courses of four funds each.
WIDE_FIELDS = ["Подразделение", "Форма", "Код", "Направление"]
WIDE_FUNDS = ["Фед. бюджет", "Бюджет субъекта РФ", "Местный бюджет", "Платное обучение"]


def with_inferred_names(tables: DataFrame) -> DataFrame:
    """Generic headers named after their columns' values; the wide layout recognised by its first row."""
    cols, rows = F.col("columns"), F.col("rows")
    first = F.get(rows, F.lit(0))
    wide = (F.size(cols) == 24) & (F.size(first) == 24) & looks_like_form(F.get(first, F.lit(1))) & F.get(first, F.lit(2)).rlike(rf"\b{CODE}\b")
    layout = F.array(*map(F.lit, WIDE_FIELDS + [f"{k} курс — {fund}" for k in range(1, 6) for fund in WIDE_FUNDS]))
    named = F.transform(cols, lambda c, i: F.when(F.trim(c).rlike(GENERIC), F.coalesce(inferred_name(F.transform(rows, lambda r: F.get(r, i))), c)).otherwise(c))
    return tables.withColumn("columns", F.when(F.size(rows) == 0, cols).when(F.coalesce(wide, F.lit(False)), layout).otherwise(named))


#: What a header row holds, and what a block of signatures.
HEADER_HINTS = ["код", "наименован", "направлен", "специальн", "форма", "курс", "уровень", "бюджет"]
SIGNATURE_HINTS = ["документ подписан", "уникальный программный ключ", "должность"]


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The rows with these columns computed once, as a generator's output: later steps read them and don't repeat them."""
    return df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*names))))


def generic_name(i: Column) -> Column:
    return F.concat(F.lit("Колонка "), (i + 1).cast("string"))


def data_start(rows: Column) -> Column:
    """The place (from 0) of the first of 12 rows that holds a code, else null."""
    place = F.array_position(F.transform(F.slice(rows, 1, 12), lambda r: F.array_join(r, " ").rlike(rf"\b{CODE}\b")), True)
    return F.when(place > 0, (place - 1).cast("int"))


def joined_headers(rows: Column, width: Column) -> Column:
    """Each column's distinct header parts, joined by slashes; generic names where there are none."""

    def name(i: Column) -> Column:
        parts = F.filter(F.transform(rows, lambda r: collapse_duplicates(F.get(r, i))), lambda x: x != "")
        return F.when(F.size(parts) > 0, F.array_join(F.array_distinct(parts), " / ")).otherwise(generic_name(i))

    return F.transform(F.sequence(F.lit(0), width - 1), name)


def numbered_names(names: Column) -> Column:
    """Repeated names get a running number from the second on."""
    seen = lambda i, x: _count(F.slice(names, F.lit(1), i + 1), lambda y: y == x)
    return F.transform(names, lambda x, i: F.when(seen(i, x) > 1, F.concat(x, F.lit(" ("), seen(i, x).cast("string"), F.lit(")"))).otherwise(x))


def normalized(tables: DataFrame, matrix: str = "matrix") -> DataFrame:
    """The tables with ``columns`` and ``rows`` in place of their matrix; those of fewer than two rows go.

    Headers may take several rows (those before the first code), be missing (a code in the first row, or a block of
    signatures), or stand in the first data row. Echoes of the header and empty columns go, repeated names get
    numbers, and generic names follow what their columns hold.
    """
    kept = F.filter(F.transform(matrix, lambda r: F.transform(r, clean)), lambda r: F.exists(r, lambda c: c != ""))
    t = tables.withColumn("_rows", kept).filter(F.size("_rows") > 1).withColumn("_width", F.array_max(F.transform("_rows", F.size)))
    t = t.withColumn("_rows", F.transform("_rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("_width") - F.size(r)))))
    rest = lambda rows, n: F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0)))  # noqa: E731  without the first n
    start = F.col("_start")
    t = t.withColumn("_start", data_start(F.col("_rows")))
    t = t.withColumns(
        {
            "columns": F.when(start > 0, joined_headers(F.slice("_rows", F.lit(1), start), F.col("_width"))).when(start == 0, F.transform(F.sequence(F.lit(0), F.col("_width") - 1), generic_name)).otherwise(F.get("_rows", F.lit(0))),
            "rows": rest(F.col("_rows"), F.coalesce(start, F.lit(1))),
        }
    )
    t = settled(t, "columns", "rows")
    generic = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), generic_name)
    signed = any_of(F.lower(_blob(F.col("_rows"), 4)), SIGNATURE_HINTS)
    t = t.withColumn("columns", F.when(signed, generic).otherwise(F.col("columns")))
    unnamed = _count(F.col("columns"), lambda c: F.trim(c).rlike(GENERIC)) >= F.greatest(F.lit(2), F.floor(F.col("_width") / 2))
    promote = (F.size("rows") > 0) & unnamed & any_of(F.lower(F.array_join(F.get("rows", F.lit(0)), " ")), HEADER_HINTS)
    t = t.withColumn("_promote", F.coalesce(promote, F.lit(False)))
    t = t.withColumns({"columns": F.when(F.col("_promote"), F.get("rows", F.lit(0))).otherwise(F.col("columns")), "rows": F.when(F.col("_promote"), rest(F.col("rows"), F.lit(1))).otherwise(F.col("rows"))})
    t = settled(t, "columns", "rows")
    names = F.transform("columns", lambda c, i: F.coalesce(F.nullif(collapse_duplicates(c), F.lit("")), generic_name(i)))
    t = t.withColumn("columns", names)
    t = settled(t, "columns").withColumn("columns", numbered_names(F.col("columns")))
    t = settled(t, "columns")
    echo = (F.size("rows") > 0) & (row_similarity(F.get("rows", F.lit(0)), F.col("columns")) > 0.7)
    t = t.withColumn("rows", F.when(F.coalesce(echo, F.lit(False)), rest(F.col("rows"), F.lit(1))).otherwise(F.col("rows")))
    t = settled(t, "rows")
    places = F.filter(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.exists("rows", lambda r: F.get(r, i) != ""))
    t = settled(t.withColumn("_keep", places), "_keep")
    only = lambda xs: F.when(F.size("_keep") > 0, F.transform("_keep", lambda i: F.get(xs, i))).otherwise(xs)
    t = t.withColumns({"columns": only(F.col("columns")), "rows": F.transform("rows", only)})
    t = settled(t, "columns", "rows")
    return settled(with_inferred_names(t.drop(matrix, "_rows", "_width", "_start", "_promote", "_keep")), "columns", "rows")


def best_by_base(tables: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key's sheets or files the one of the highest base score, the first of equals; layouts are not told apart."""
    scored = tables.withColumn("score", base_score(F.col("columns"), F.col("rows")))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), *order))
    return scored.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
