"""Normalisers of level, form and course. Three families that disagree on purpose, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, text

#: Ordered tests (any of these in the text -> value); the first that holds counts.
UI_LEVELS = [
    (["бакалав"], "бакалавриат"),
    (["магистр"], "магистратура"),
    (["спо", "среднее профессион"], "спо"),
    (["подготовка кадров высшей квалификации", "аспиран"], "аспирантура"),
    (["ординат"], "ординатура"),
    (["высш"], "высшее"),
    (["специал"], "специалитет"),
]
QA_LEVELS = [
    (["бакалав"], "бакалавриат"),
    (["магистр"], "магистратура"),
    (["специал"], "специалитет"),
    (["среднее профессион"], "спо"),
    (["ординат"], "ординатура"),
    (["аспиран", "подготовка кадров высшей квалификации"], "аспирантура"),
    (["высш"], "высшее"),
]
PROFILE_LEVELS = [
    (["дополнитель"], "dpo"),
    (["аспиран"], "asp"),
    (["ординат"], "ord"),
    (["магистр"], "mag"),
    (["бакалав"], "bak"),
    (["специал"], "spec"),
    (["высш"], "higher"),
]
FORMS = [(["очно-заоч"], "очно-заочная"), (["заоч"], "заочная"), (["очн"], "очная")]
BLANK = ["", "0", "-", "—", "–", "нет данных"]
LEVEL_LABELS = [("бакалав", "Бакалавриат"), ("магистр", "Магистратура"), ("спо", "СПО"), ("аспиран", "Аспирантура"), ("ординат", "Ординатура"), ("высшее", "Высшее"), ("специал", "Специалитет")]
TYPE_LABELS = {"federal": "Федеральный", "private": "Частный/коммерческий", "art": "Творческий", "regional": "Региональный/филиал"}
LEVEL_ORDER = ["spo", "bak", "spec", "mag", "asp", "ord", "dpo", "higher"]


def _first(t: Column, tests, otherwise: Column) -> Column:
    out = F.when(t == "", F.lit(""))
    for words, value in tests:
        for w in words:
            out = out.when(F.contains(t, F.lit(w)), F.lit(value))
    return out.otherwise(otherwise)


def comparable(c: Column | str) -> Column:
    return F.lower(clean(c))


def ui_level(c: Column | str) -> Column:
    t = comparable(c)
    return _first(t, UI_LEVELS, t)


def qa_level(c: Column | str) -> Column:
    t = F.regexp_replace(comparable(c), "[–—]", "-")
    return F.when(t == "спо", F.lit("спо")).otherwise(_first(t, QA_LEVELS, t))


def profile_level(c: Column | str) -> Column:
    t = comparable(c)
    has = lambda w: F.contains(t, F.lit(w))
    spo = (has("средн") & (has("проф") | has("звена"))) | has("спо")
    return F.when(spo, F.lit("spo")).otherwise(_first(t, PROFILE_LEVELS, F.lit("")))


#: Titles of the level keys.
LEVEL_TITLES = {"spo": "СПО", "bak": "Бакалавриат", "spec": "Специалитет", "mag": "Магистратура", "asp": "Аспирантура", "ord": "Ординатура", "dpo": "Доп. образование", "higher": "Высшее (не уточнено)"}


def profile_title(key: Column | str) -> Column:
    """A level key's title; other texts as they are."""
    titles = F.create_map(*[F.lit(x) for pair in LEVEL_TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, text(key)), text(key))


def _form(c: Column | str, extra) -> Column:
    t = F.regexp_replace(comparable(c), r"\s*-\s*", "-")
    return F.when(t.isin(BLANK), F.lit("")).otherwise(_first(t, [*FORMS, *extra], t))


def ui_form(c: Column | str) -> Column:
    return _form(c, [(["дистанц", "онлайн"], "дистанционная")])


def qa_form(c: Column | str) -> Column:
    return _form(c, [])


def ui_course(c: Column | str) -> Column:
    t = clean(c)
    digits = F.regexp_extract(t, r"(?iu)^(\d+)\s*(?:курс[а-я]*)?$", 1)
    return F.when(F.lower(t).isin(BLANK), F.lit("")).when(digits != "", digits).otherwise(t)


def qa_course(c: Column | str) -> Column:
    t = comparable(c)
    digits = F.regexp_extract(t, r"\d+", 0)
    return F.when(t.isin(BLANK), F.lit("")).when(digits != "", digits).otherwise(t)


def level_label(c: Column | str) -> Column:
    norm = ui_level(c)
    out = F.when(F.lit(False), F.lit(""))
    for word, label in LEVEL_LABELS:
        out = out.when((norm == word) if word in ("спо", "высшее") else F.contains(norm, F.lit(word)), F.lit(label))
    return out.otherwise(F.coalesce(F.nullif(text(c), F.lit("")), F.lit("Не указано")))


def form_label(c: Column | str) -> Column:
    norm = ui_form(c)
    return F.when(norm == "", F.lit("не указана")).otherwise(F.concat(F.upper(F.substring(norm, 1, 1)), F.substring(norm, 2, 1 << 20)))


def course_label(c: Column | str) -> Column:
    norm = ui_course(c)
    return F.when(norm == "", F.lit("Не указан")).when(norm.rlike(r"^\d+$"), F.concat(norm, F.lit(" курс"))).otherwise(norm)


def type_label(c: Column | str) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, text(c)), text(c))


def status_label(c: Column | str) -> Column:
    t = F.lower(text(c))
    return F.when(t.isin("ok", "partial"), t).otherwise(F.lit("error"))


def row_key(code: str, direction: str, program: str, level: str, course: str, form: str, budget: str, paid: str) -> Column:
    """Eight normalised fields, joined by bars: names a row in a link."""
    from .numbers import to_number

    number = lambda c: F.regexp_replace(to_number(c).cast("string"), r"\.0$", "")
    return F.concat_ws("|", comparable(code), comparable(direction), comparable(program), ui_level(level), ui_course(course), ui_form(form), number(budget), number(paid))


#: Letters with marks and the letters that they sort as.
MARKED, PLAIN = "ёàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "еaaaaaaceeeeiiiinooooouuuuyy"


def collation_key(c: Column | str) -> Column:
    """Sorts as people expect: blind to case and accents, digit runs of any length by value (``2.1.9`` before ``2.1.11``)."""
    t = F.translate(F.lower(text(c)), MARKED, PLAIN)
    parts = F.regexp_extract_all(t, F.lit(r"\d+|\D+"), F.lit(0))

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)  # the longer number is the larger

    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), "")


def folded(c: Column | str, locale: str = "ru") -> Column:
    """The text under a collation that knows neither case nor accents: joins, groups and filters on it take such as equal.

    What comes out is still the text as written; of a group, any of its spellings. (ё and е are one letter to it.)
    """
    return F.collate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), f"{locale}_CI_AI")
