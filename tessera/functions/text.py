"""Text functions on Columns. Missing text counts as the empty text throughout."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a link may hold, a study code, the dashes that stand for "none".
URL = r"(?i)https?://[^\s<>\]\)\};,]+"
CODE = r"\d{1,2}\.\d{1,2}\.\d{1,2}"
DASHES = ["-", "—", "–"]
LEVEL_WORDS = ["бакалав", "магистр", "специал", "аспиран", "ординат", "среднее профессион", "спо", "базовое высшее"]
FORM_WORDS = ["очная", "заочная", "очно-заочная", "очно заочная", "дистанц", "вечерн"]


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(c: Column | str) -> Column:
    """Collapse white space (no-break spaces too) and trim."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def clean_qa(c: Column | str) -> Column:
    """As ``clean``, but a number 0 counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.cast("string") == "0", F.lit("")).otherwise(clean(c))


def header(c: Column | str) -> Column:
    return F.lower(clean(c))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words; the text is computed once."""
    return c.rlike("|".join(map(re.escape, words)))


def collapse_duplicates(c: Column | str) -> Column:
    """``a b a b`` to ``a b``; ``№ №`` to ``№``."""
    t = clean(c)
    words = F.split(t, " ")
    n = F.size(words)
    half = (n / 2).cast("int")
    twice = (n >= 2) & (n % 2 == 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
    return F.when(twice, F.array_join(F.slice(words, F.lit(1), half), " ")).otherwise(t)


def append_text(base: Column, extra: Column) -> Column:
    """Join two texts with a newline-free separator unless the first holds the second already."""
    a, b = clean(base), clean(extra)
    return F.when(b == "", a).when(a == "", b).when(F.contains(a, b), a).otherwise(F.concat(a, F.lit("; "), b))


def first_url(c: Column | str) -> Column:
    return F.regexp_extract(text(c), URL, 0)


def urls(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(URL), F.lit(0))


def cell_link(link: Column, cell: Column) -> Column:
    """A cell's hyperlink, else the first link in its text."""
    return F.coalesce(F.nullif(clean(link), F.lit("")), first_url(cell))


def split_code(c: Column | str) -> Column:
    """struct(code, direction) of ``dd.dd.dd - text``; null unless the text after the code holds a letter."""
    t = clean(c)
    pattern = rf"^({CODE})(?:\s*[–—-]\s*|\s+)(.+)$"
    code, rest = F.regexp_extract(t, pattern, 1), clean(F.regexp_extract(t, pattern, 2))
    good = (code != "") & rest.rlike("[A-Za-zА-Яа-яЁё]")
    return F.when(good, F.struct(code.alias("code"), rest.alias("direction")))


def is_code(c: Column | str) -> Column:
    return clean(c).rlike(rf"^{CODE}$")


def is_numeric_cell(c: Column | str) -> Column:
    return clean(c).rlike(r"^\d+(\.\d+)?$")


def is_summary(c: Column | str) -> Column:
    """Totals, "all courses" and dashes."""
    t = F.lower(clean(c))
    return t.isin(DASHES) | t.startswith("итог") | t.startswith("всего") | (F.contains(t, F.lit("все")) & F.contains(t, F.lit("курс")))


def level_from_code(c: Column | str) -> Column:
    """The level that a code's middle group stands for; empty where it stands for none."""
    t = clean(c)
    pattern = r"^(\d{1,2})\.(\d{1,2})\.(\d{1,2})$"
    first = F.regexp_extract(t, pattern, 1).try_cast("int")
    middle = F.regexp_extract(t, pattern, 2).try_cast("int")
    higher = "Высшее образование - "
    top = F.lit(higher + "подготовка кадров высшей квалификации")
    return (
        F.when(middle == 2, F.lit("Среднее профессиональное образование"))
        .when(middle == 3, F.lit(higher + "бакалавриат"))
        .when(middle == 4, F.lit(higher + "магистратура"))
        .when(middle == 5, F.lit(higher + "специалитет"))
        .when(middle == 6, top)
        .when(middle.isin(7, 8, 9) & (first < 10), top)
        .otherwise(F.lit(""))
    )


def form_literal(c: Column | str) -> Column:
    """The form of study that a header names. "заочная" names none, as it holds "очн" too."""
    return let(header(c), form_of)


def form_of(h: Column) -> Column:
    """``form_literal`` of what ``header`` gives."""
    has = lambda w: F.contains(h, F.lit(w))
    mixed = has("очно-заоч") | has("очно заоч")
    return (
        F.when(mixed, F.lit("очно-заочная"))
        .when(has("очн") & has("заоч"), F.lit(""))
        .when(has("заоч"), F.lit("заочная"))
        .when(has("очн"), F.lit("очная"))
        .when(has("дистанц"), F.lit("дистанционная"))
        .when(has("вечер"), F.lit("вечерняя"))
        .otherwise(F.lit(""))
    )


def looks_like_level(c: Column | str) -> Column:
    return any_of(F.lower(text(c)), LEVEL_WORDS)


def looks_like_form(c: Column | str) -> Column:
    return any_of(F.lower(text(c)), FORM_WORDS)


def short_text(c: Column | str, n: int) -> Column:
    t = text(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("…"))).otherwise(t)


def host(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(text(c), F.lit("HOST")), F.lit("")), "^www\\.", "")


def query_value(c: Column | str) -> Column:
    """A text as the value of a link's query."""
    return F.url_encode(text(c))


def source_type(url: Column, content_type: Column) -> Column:
    """html, pdf, excel or csv by the path's suffix, then the content type."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    kind = F.lower(text(content_type))
    return (
        F.when(path.endswith(".pdf") | F.contains(kind, F.lit("pdf")), F.lit("pdf"))
        .when(path.rlike(r"\.xlsx?$") | F.contains(kind, F.lit("excel")) | F.contains(kind, F.lit("spreadsheet")), F.lit("excel"))
        .when(path.endswith(".csv") | F.contains(kind, F.lit("csv")), F.lit("csv"))
        .otherwise(F.lit("html"))
    )


#: Fixed value: a numbered item up to the next number or the end.
NUMBERED = r"(?s)(?:^|[\s;])\d{1,2}[.)]\s*(.*?)(?=(?:[\s;]\d{1,2}[.)]\s)|$)"


def long_text(c: Column | str) -> Column:
    """White space collapsed, and one blank after each semicolon."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?U)\s+", " "), r"\s*;\s*", "; "))


def item_text(c: Column | str) -> Column:
    """Without leading bullets and trailing semicolons."""
    tidy = F.regexp_replace(F.regexp_replace(text(c), r"^[\-–—•●*]+\s*", ""), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(tidy, r"[;\s]+$", ""))


def split_items(c: Column | str) -> Column:
    """Numbered items where there are two or more, else chunks between ; and bullets, else none."""
    full = lambda items: F.filter(F.transform(items, item_text), lambda x: x != "")
    t = long_text(c)
    numbered = full(F.regexp_extract_all(t, F.lit(NUMBERED), F.lit(1)))
    chunks = full(F.split(t, r"\s*;\s*|\s*[•●]\s*"))
    return F.when(F.size(numbered) >= 2, numbered).when(F.size(chunks) >= 2, chunks).otherwise(F.array().cast("array<string>"))


def entity_id(c: Column | str) -> Column:
    """``2``, ``u2``, ``U002`` to ``u002``; after u only digits count; other texts lower-cased."""
    t = F.lower(F.trim(text(c)))
    digits = F.when(t.startswith("u"), F.regexp_replace(t, r"\D", "")).when(t.rlike(r"^\d+$"), t).otherwise(F.lit(""))
    number = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(digits != "", F.concat(F.lit("u"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))).otherwise(t)


def entity_ids(c: Column | str) -> Column:
    """The ids of a list between commas, semicolons and blanks, in order, repeats included."""
    return F.transform(F.filter(F.split(F.trim(text(c)), r"[,\s;]+"), lambda x: x != ""), entity_id)


def flag(c: Column | str, yes: bool = True) -> Column:
    """Tri-state from text. ``yes``: the English word counts too."""
    t = F.lower(clean(c))
    true = ["да", "есть", "+", "true", "1"] + ["yes"] * yes
    return F.when(t.isin(true), F.lit(True)).when(t.isin("нет", "-", "—", "false", "0", "no"), F.lit(False))


def without_sentinel(c: Column | str, least: int) -> Column:
    """Null for ``nan`` and for texts shorter than ``least``."""
    t = clean(c)
    return F.when((t != "nan") & (F.length(t) >= least), t)


#: Encode and decode steps that undo a wrong decoding, in the order in which they are tried.
TRANSCODINGS = [("latin-1", "utf-8"), ("latin-1", "cp1251"), ("latin-1", "koi8-r"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8")]


def quality(t: str) -> int:
    """Cyrillic letters less marks of wrong decoding."""
    upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
    share = upper / (upper + lower) if upper and lower else 0
    return (
        len(re.findall("[А-Яа-яЁё]", t))
        - 2 * len(re.findall("[ÐÑÃÊÂ�]", t))
        - len(re.findall("[РС][А-Яа-яЁё]", t))
        - 3 * len(re.findall("[─-▟]", t))
        - 2 * len(re.findall("[∀-⋿]", t))
        - 4 * t.count("�")
        - (int(8 * share) if share > 0.4 else 0)
    )


def text_quality(c: Column | str) -> Column:
    """``quality`` as a Column: no Python."""
    t = text(c)
    n = lambda p: F.regexp_count(t, F.lit(p))
    upper, lower = n(r"\p{Lu}"), n(r"\p{Ll}")
    share = F.when((upper > 0) & (lower > 0), upper / (upper + lower)).otherwise(0.0)
    loud = F.when(share > 0.4, F.floor(8 * share)).otherwise(0)
    marks = 2 * n("[ÐÑÃÊÂ�]") + n("[РС][А-Яа-яЁё]") + 3 * n("[─-▟]") + 2 * n("[∀-⋿]") + 4 * n("�")
    return (n("[А-Яа-яЁё]") - marks - loud).cast("int")


def clean_recovered(c: Column | str, safe: bool = True) -> Column:
    """``clean`` after charset recovery: what every text of a landed table goes through.

    Only texts that can be decoded wrongly go to Python.
    """
    t = text(c)
    wrong = may_be_wrong(t) if safe else t.rlike(r"[^\x00-\x7F]")
    return clean(F.when(wrong, recover_mojibake(F.when(wrong, t), safe)).otherwise(t))


def may_be_wrong(t: Column) -> Column:
    """Whether the safe rule of ``recover`` may change a text: a test by its characters, without Python.

    Texts of Latin-1 alone: bytes taken as cp1251 or koi8-r turn every accented letter into a Cyrillic one, so an accented
    letter beside a plain one would mix scripts, and three in a row make a word; bytes taken as UTF-8 need a lead and a continuation. Others can only be
    bytes of cp1251, koi8-r or cp866 taken as UTF-8: in the first two no letter from А to я can follow another one (both
    are leads), in the third a letter from А to п can't come first (it is a continuation).
    """
    latin = t.rlike("[À-ÿ]") & (t.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") | t.rlike("[¨£³¸À-ÿ]{3}") & ~t.rlike("[A-Za-z][À-ÿ]|[À-ÿ][A-Za-z]"))
    other = t.rlike("[\u0400-\u04ff─-▟]") & ~(t.rlike("[А-Яа-я][А-Яа-я]") & t.rlike(r"(?:^|[\x00-\x7F])[А-п]"))
    return F.when(t.rlike("[^\u0000-\u00ff]"), other).otherwise(latin)


#: Accented letters of French, Spanish and German.
ACCENTED = [set("àâçéèêëîïôùû"), set("áéíñóúü"), set("äöüß")]


def accented_words(t: str) -> bool:
    """Whether words of accented letters can be Cyrillic ones: a long word is enough, else they must not be too few.

    Words of one or two accented letters, as ``à`` among French ones or ``Ê`` alone, say nothing, and a word says nothing
    new however often it comes. By chance Latin texts hold words of up to six accented letters, and short words that one
    language has all letters of.
    """
    words = set(re.findall("[¨£³¸À-ÿ]{3,}", t))
    longest, letters = max(map(len, words), default=0), sum(map(len, words))
    if longest < 3 or longest >= 7:
        return longest >= 7
    if longest < 5 and any(set("".join(words).lower()) <= own for own in ACCENTED):
        return False
    plain = sum(map(len, set(re.findall("[A-Za-z]+", re.sub(URL, "", t)))))
    return letters * (4 if longest >= 5 else 1) > plain


def mixed_words(t: str) -> int:
    """Places where a Latin and a Cyrillic letter meet: what accented Latin text turns into when taken for wrong."""
    return len(re.findall("[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z]", t))


def recover(t: str, safe: bool = True) -> str:
    """The best transcoding. ``safe``: only lossless ones that score at least 3 better, mix no scripts and give words; else the exact older rule."""
    if t.isascii():
        return t
    best, top = t, None  # most texts have no other reading: nothing is counted then
    for to, back in TRANSCODINGS:
        try:
            other = t.encode(to).decode(back, "strict" if safe else "ignore")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if other == t or safe and to == "latin-1" and back != "utf-8" and not accented_words(t):
            continue
        top = quality(t) + (2 if safe else 0) if top is None else top
        if (q := quality(other)) > top and not (safe and mixed_words(other) > mixed_words(t)):
            best, top = other, q
    return best


def recover_mojibake(c: Column | str, safe: bool = True) -> Column:
    """Undo a wrong decoding; one vectorised UDF, as Spark has no charset search."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: recover(t, safe))

    return run(text(c))
