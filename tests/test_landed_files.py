"""Charsets of bytes, and tables of PDF files."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.plans.readers import pdf
from tessera.sources import charsets
from tessera.sources import pdf as pdfs

RUSSIAN = "Вакантные места для приёма (перевода) студентов на 1 сентября: Математика — 5, «Физика» – нет. Съезд, объём, ёлка."
FRENCH = "Les élèves de l'école ont été reçus à Noël; où êtes-vous, garçon? Ça va très bien, déjà."


def decoded(spark, rows, pairs=None):
    df = spark.createDataFrame([(i, bytearray(raw) if raw is not None else None, name) for i, (raw, name) in enumerate(rows)], "i int, raw binary, name string")
    return [r["t"] for r in df.select("i", charsets.decoded(F.col("raw"), F.col("name"), pairs).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "cp1251", "koi8-r", "cp866", "iso-8859-5"])
def test_russian_comes_back_undeclared(spark, name):
    text = RUSSIAN if name not in ("koi8-r", "cp866", "iso-8859-5") else "".join(c for c in RUSSIAN if c not in "—«»–")
    assert decoded(spark, [(text.encode(name), None), (text.encode(name), "no-such"), (text.encode(name), "ascii")]) == [text] * 3


def test_declared_named_and_odd_bytes(spark):
    rows = [
        (FRENCH.encode("latin-1"), None), (FRENCH.encode("latin-1"), "utf-8"), (RUSSIAN.encode("cp1251"), "windows-1251"), (b"\xcf\xf0", "koi8-r"),
        (b'<meta charset="koi8-r">' + "да".encode("koi8-r"), None), (b"", None), (None, None), (b"plain", "utf-16"), (b"plain!", "hex"), (b"\x00\x01\xff", "utf-8"),
    ]
    got = decoded(spark, rows)
    assert got[:3] == [FRENCH, FRENCH, RUSSIAN] and got[3] == b"\xcf\xf0".decode("koi8-r") and got[4].endswith("да")
    assert got[5:7] == ["", ""] and got[7:9] == ["plain", "plain!"] and len(got[9]) == 3


def test_a_counted_model_tells_capitals_apart(spark):
    texts = spark.createDataFrame([(RUSSIAN * 3,), (FRENCH,), (None,)], "text string")
    pairs = charsets.model(charsets.pair_counts(texts))
    loud = "ВАКАНТНЫЕ МЕСТА ДЛЯ ПЕРЕВОДА СТУДЕНТОВ"
    assert decoded(spark, [(loud.encode(n), None) for n in ("cp1251", "koi8-r", "cp866")], pairs) == [loud] * 3


def test_lone_accented_letters_are_not_cyrillic(spark):
    german = ["Be, lichberzu geschach der ß schkeittz nicht zu geßch.", "du. " * 20 + "Ê " * 20, "Und, und ßte der zu cheiß ä ü", "à la fin, ça y est", "vereint | enat | lichü"]
    counted = charsets.model(charsets.pair_counts(spark.createDataFrame([(RUSSIAN * 3,), ("a b in der zu " * 90,), (FRENCH,)], "text string")))
    for pairs in (None, counted):
        assert decoded(spark, [(t.encode("latin-1"), None) for t in german], pairs) == german
        assert decoded(spark, [(t.encode("cp1251"), None) for t in ("Математика http://a.edu/x",)], pairs) == ["Математика http://a.edu/x"]


def test_repeated_and_mixed_words_are_not_cyrillic(spark):
    """A word counts once, however often it comes; one next to plain letters shows that its text is not Cyrillic."""
    french = ["Équereç treêê aiç pourenêaire étreoi. " + "En Aile " * 40 + "èèé " * 60, "de elleiervi queque aiquele re aiéè. Aneau èçè que. And the on eslyth of rerestou"]
    counted = charsets.model(charsets.pair_counts(spark.createDataFrame([(RUSSIAN * 3,), ("a b in der zu " * 90,), (FRENCH,)], "text string")))
    russian = ["Математика, Java, Python и SQL: места", "места " * 30 + "plain", "Математика"]
    for pairs in (None, counted):
        assert decoded(spark, [(t.encode("latin-1"), None) for t in french], pairs) == french
        assert decoded(spark, [(t.encode("cp1251"), None) for t in russian], pairs) == russian


def tables(spark, *files):
    rows = spark.createDataFrame([(f"f{i}", bytearray(f) if f is not None else None) for i, f in enumerate(files)], "path string, content binary")
    return {r["path"]: (r["columns"], r["rows"]) for r in pdfs.pdf_tables(rows).collect()}


HEAD = ["Код", "Направление", "Бюджет", "Договор"]
BODY = [["01.03.02", "Прикладная математика", "3", "10"], ["09.03.01", "", "0", "5"], ["38.03.01", "Экономика", "12", "7"]]


def test_pages_of_one_table_and_files_without(spark):
    more = [["40.03.01", "Юриспруденция", "1", "2"], ["45.03.02", "Лингвистика", "4", "0"]]
    got = tables(spark, pdf([[HEAD, *BODY], [HEAD, *more]]), b"no pdf", None, b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 9 0 R>>\nendobj", pdf([[["only", "one row"]]]))
    assert got == {"f0": (HEAD, BODY + more)}


def test_text_operators_fonts_and_object_streams(spark):
    """Literal strings with escapes, relative moves, quotes as operators, a simple font, and dictionaries in an object stream."""
    content = b"BT /F2 12 Tf 14 TL 50 700 Td (Code) Tj 200 0 Td (Places \\(all\\)) Tj -200 -14 Td (01.03.02) Tj 200 0 Td [(1) 20 (0)] TJ -200 0 Td T* (09.03.01) Tj 200 0 Td (\\065) Tj -200 0 Td (38.03.01) ' 200 0 Td <37> Tj ET"
    inner = [b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</F2 5 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents[4 0 R]>>", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 48/Widths[600 600 600]>>"]
    heads = b"2 0 3 %d 5 %d " % (len(inner[0]), len(inner[0] + inner[1]))
    z = zlib.compress(heads + b"".join(inner))
    file = b"%PDF-1.5\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n4 0 obj\n<</Length 1>>\nstream\n" + content + b"\nendstream\nendobj\n"
    file += b"7 0 obj\n<</Type/ObjStm/N 3/First %d/Filter/FlateDecode>>\nstream\n" % len(heads) + z + b"\nendstream\nendobj\n"
    columns, rows = tables(spark, file)["f0"]
    assert columns == ["Code", "Places (all)"] and rows == [["01.03.02", "10"], ["09.03.01", "5"], ["38.03.01", "7"]]


def test_every_page_is_read(spark):
    """Files of any number of pages, in a page tree of any depth, and a node that holds itself."""
    rows = [[f"01.{i // 60 + 10}.{i % 60 + 10}", f"Направление {i}", str(i), "5"] for i in range(80)]
    deep = b"%PDF-1.5\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n"
    for n in range(2, 70):
        deep += b"%d 0 obj\n<</Type/Pages/Count 1/Kids[%d 0 R %d 0 R]>>\nendobj\n" % (n, 2, n + 1) if n == 2 else b"%d 0 obj\n<</Type/Pages/Count 1/Kids[%d 0 R]>>\nendobj\n" % (n, n + 1)
    content = b"BT /F 10 Tf 1 0 0 1 50 700 Tm (Code) Tj 1 0 0 1 200 700 Tm (Places) Tj 1 0 0 1 50 680 Tm (01.03.02) Tj 1 0 0 1 200 680 Tm (10) Tj 1 0 0 1 50 660 Tm (09.03.01) Tj 1 0 0 1 200 660 Tm (5) Tj ET"
    deep += b"70 0 obj\n<</Type/Page/Contents 71 0 R>>\nendobj\n71 0 obj\n<</Length 1>>\nstream\n" + content + b"\nendstream\nendobj\n"
    got = tables(spark, pdf([[HEAD, *rows[i : i + 2]] for i in range(0, 80, 2)]), deep)
    assert got == {"f0": (HEAD, rows), "f1": (["Code", "Places"], [["01.03.02", "10"], ["09.03.01", "5"]])}
