"""Hand-derived results of the column functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates, normalize, numbers, text


def results(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (numbers.digits_sum, ["2 2", "10 20", "1.5", "нет", None], [2, 30, 6, 0, 0]),
    (numbers.int_token, ["3,9", "x", None], [3, None, None]),
    (numbers.amount_tokens, ["4 - 5", "нет"], [[4, 0, 5], []]),
    (numbers.course_tokens, ["1 - 3", "-"], [["1", "3"], []]),
    (numbers.course, ["2 курс", "все курсы", "—", "x"], ["2", "", "", "x"]),
    (numbers.to_number, ["5", "x", "NaN"], [5.0, 0.0, 0.0]),
    (text.level_from_code, ["38.04.01", "2.1.1", "5.2.6", "1.7.3"], ["Высшее образование - магистратура", "", "Среднее профессиональное образование", "Высшее образование - подготовка кадров высшей квалификации"]),
    (text.form_literal, ["заочная", "заоч.", "очная", "Очно-заочная форма"], ["", "заочная", "очная", "очно-заочная"]),
    (text.collapse_duplicates, ["a b a b", "№ №", "a b a", None], ["a b", "№", "a b a", ""]),
    (text.clean, [" a  b\n", None], ["a b", ""]),
    (text.entity_id, ["2", "u2", "U002", "x"], ["u002", "u002", "u002", "x"]),
    (text.is_summary, ["Итого", "-", "все курсы", "01"], [True, True, True, False]),
    (text.split_items, ["1. foo 2. bar", "a; b", "x", None], [["foo", "bar"], ["a", "b"], [], []]),
    (text.flag, ["Да", "нет", "maybe", None], [True, False, None, None]),
    (text.host, ["http://www.a.ru:80/x", "none"], ["a.ru", ""]),
    (text.looks_like_level, ["транспорт", "x"], [True, False]),
    (normalize.ui_level, ["Высшее образование - специалитет", "подготовка кадров высшей квалификации"], ["высшее", "аспирантура"]),
    (normalize.qa_level, ["Высшее образование - специалитет", "СПО"], ["специалитет", "спо"]),
    (normalize.profile_level, ["подготовка кадров высшей квалификации", "среднее проф."], ["higher", "spo"]),
    (normalize.ui_course, ["5-6 курс", "3 курса", "0"], ["5-6 курс", "3", ""]),
    (normalize.qa_course, ["5-6 курс"], ["5"]),
    (normalize.ui_form, ["Очно - заочная", "онлайн", "-"], ["очно-заочная", "дистанционная", ""]),
    (normalize.qa_form, ["онлайн"], ["онлайн"]),
    (normalize.form_label, ["очная", "", "иное"], ["Очная", "не указана", "Иное"]),
    (normalize.level_label, ["спо", "", "Высшее"], ["СПО", "Не указано", "Высшее"]),
    (normalize.course_label, ["2", "x", ""], ["2 курс", "x", "Не указан"]),
    (normalize.type_label, ["art", "x"], ["Творческий", "x"]),
]


@pytest.mark.parametrize("f,values,expected", CASES, ids=[f.__name__ for f, _, _ in CASES])
def test_function(spark, f, values, expected):
    assert results(spark, f, values) == expected


def test_split_code(spark):
    got = results(spark, text.split_code, ["01.03.02", "01.03.02 Математика", "01.03.02 - 5"])
    assert got[0] is None and tuple(got[1]) == ("01.03.02", "Математика") and got[2] is None


def test_collation_sorts_digit_runs_by_value(spark):
    a, b = results(spark, normalize.collation_key, ["2.1.9", "2.1.11"])
    assert a < b
    assert len(set(results(spark, normalize.collation_key, ["Ёж", "еж"]))) == 1


RANGES = [
    ("20.06 – 29.08 (бюджет)", (5, 20, 7, 29, False)),
    ("8 декабря – 25 января", (11, 8, 0, 25, False)),
    ("1–14 июня; доп. период", (5, 1, 5, 14, False)),
    ("До 10 сентября 18:00", (7, 15, 8, 10, True)),
    ("До 21 июня", (4, 15, 5, 21, True)),
    ("До 22 июня", (5, 1, 5, 22, True)),
    ("До 20 января", (11, 15, 0, 20, True)),
    ("Июль–август", (6, 1, 7, 28, True)),
    ("Декабрь и июнь (1–15 числа)", (11, 1, 11, 28, True)),
    ("1–14 май", None),
    (None, None),
]


def test_ranges(spark):
    got = results(spark, dates.parse_range, [t for t, _ in RANGES])
    assert [g and tuple(g)[:5] for g in got] == [e for _, e in RANGES]


def test_wave_takes_the_chunk_that_fits(spark):
    got = results(spark, lambda c: dates.parse_for_wave(c, dates.WINTER_MONTHS), ["1–14 июня; 8 декабря – 25 января", "1–14 июня"])
    assert tuple(got[0])[:4] == (11, 8, 0, 25) and got[1] is None


def test_season_split(spark):
    got = results(spark, dates.season_split, ["1–14 июня; 8 декабря – 25 января; март", "январь и июнь", None])
    assert tuple(got[0]) == (["8 декабря – 25 января"], ["1–14 июня"], ["март"])
    assert tuple(got[1]) == (["январь и июнь"], ["январь и июнь"], [])
    assert tuple(got[2]) == ([], [], [])


def test_lone_accented_letters_stay():
    for t in ("u. du. du. " + "Ê " * 8, "de de " + "è " * 33, "enstungge " + "üß " * 9, "Ê", "se " + "ó " * 9, "der ßäü " * 3):
        assert text.recover(t) == t
    for t in ("Математика (https://a.edu/long/path)", "Вуз", "Master of Science: Математика", "по курсам"):
        assert text.recover(t.encode("cp1251").decode("latin-1")) == t


def test_repeated_and_short_accented_words_stay():
    for t in ("En de " + "èéä " * 30, "èçè", "éçé. Le", "ñíñ", "üüö.", "plain words about éèéèé and more of them, all plain"):
        assert text.recover(t) == t
    for t in ("Код", "Филиал", "Вуз " * 9, "Курсы of us", "Master of Science in all subjects: Математика"):
        assert text.recover(t.encode("cp1251").decode("latin-1")) == t


def test_recovery():
    assert text.recover("РђРІС‚РѕРј") == "Автом" and text.recover("café") == "café" and text.recover("СПбГУ 5") == "СПбГУ 5"
    assert text.recover("café", safe=False) == "cafй" and text.recover("СПбГУ 5", safe=False) == " 5"


PLAIN_AND_WRONG = st.text(st.sampled_from("ab é«ï»ÐÑàÿ·жЯпРСЃѓЂ ёА╨╤▓░ю—"), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PLAIN_AND_WRONG, min_size=200, max_size=200))
def test_recovery_skips_only_what_it_would_leave(spark, texts):
    flags = results(spark, text.may_be_wrong, texts)
    assert all(text.recover(t) == t for t, wrong in zip(texts, flags, strict=True) if not wrong)
