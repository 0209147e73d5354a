"""Text index, facet bitmaps and versioned publication."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import facets, text_index
from tessera.sources import sinks, versions

FIELDS = ["a", "b"]


def texts(seed, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abАб %_é", k=rng.randrange(9)))
    return [(i, rng.choice([word(), None]), word() + " " + word()) for i in range(n)]


def scan(rows, needle):
    return sorted(k for k, *fields in rows if any(needle.lower() in (f or "").lower() for f in fields))


NEEDLES = ["", "a", "AB", "aba", "бАб", "a%a", "b b", "ab a", "nowhere", "абаб", "aa ", "_a_"]


def test_search_is_a_scan(spark, tmp_path):
    rows, path = texts(1), str(tmp_path / "i")
    text_index.build(spark.createDataFrame(rows, "k long, a string, b string"), "k", FIELDS, path, slots=7)
    for needle in NEEDLES:
        assert sorted(r["key"] for r in text_index.search(spark, path, needle).collect()) == scan(rows, needle), needle


def test_refresh_replaces_adds_and_drops(spark, tmp_path):
    rows, path = texts(2), str(tmp_path / "i")
    schema = "k long, a string, b string"
    text_index.build(spark.createDataFrame(rows, schema), "k", FIELDS, path, slots=16)
    reading = text_index.search(spark, path, "aba")  # begun before the refresh, run after it
    changed, gone = [(5, "aba new", "x"), (1000, "aba", "y")], {7, 8}
    text_index.refresh(spark.createDataFrame(changed, schema), "k", FIELDS, path, gone=spark.createDataFrame([(k,) for k in gone], "k long"))
    now = [r for r in rows if r[0] not in gone | {5}] + changed
    for needle in ("aba", "ab", "new"):
        assert sorted(r["key"] for r in text_index.search(spark, path, needle).collect()) == scan(now, needle)
    assert sorted(r["key"] for r in reading.collect()) == scan(rows, "aba")
    first, second = (versions.version(spark, path, n) for n in (1, 2))
    assert 1 <= sum(first.parts[s] != second.parts[s] for s in first.parts) <= 4  # the other slots stay where they were
    text_index.refresh(spark.createDataFrame([], schema), "k", FIELDS, path)
    assert versions.numbers(spark, path) == [1, 2]


def test_empty_index(spark, tmp_path):
    path, schema = str(tmp_path / "i"), "k long, a string, b string"
    text_index.build(spark.createDataFrame([], schema), "k", FIELDS, path)
    assert text_index.search(spark, path, "aba").count() == text_index.search(spark, path, "").count() == 0
    text_index.refresh(spark.createDataFrame([(1, "aba", None)], schema), "k", FIELDS, path)
    assert [r["key"] for r in text_index.search(spark, path, "ABA").collect()] == [1]


def test_search_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "i")
    text_index.build(spark.createDataFrame(texts(3), "k long, a string, b string"), "k", FIELDS, path, slots=4)
    plan = text_index.search(spark, path, "abab")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "PushedFilters: [In(gram" in plan


def test_facets_are_counts(spark):
    rng = random.Random(4)
    rows = [(i * 37, rng.choice("xyz"), rng.choice(["1", "2", None]), rng.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, p string, q string, r string")
    index = facets.bitmap_index(df, "o", {"p": "p", "q": "q", "r": "r"})
    for filters in (None, {"p": ["x", "y"]}, {"p": ["x"], "q": [None, "2"], "r": ["a"]}, {"p": ["none such"]}):
        kept = [r for r in rows if all(r[" pqr".index(f)] in values for f, values in (filters or {}).items())]
        want = {(f, v): sum(r[i] == v for r in kept) for i, f in enumerate("pqr", 1) for v in {r[i] for r in kept}}
        assert {(r["facet"], r["value"]): r["n"] for r in facets.counts_under(index, filters).collect()} == want
        if filters:
            assert sorted(r["ordinal"] for r in facets.ordinals(facets.selection(index, filters)).collect()) == sorted(r[0] for r in kept)


def test_versions(spark, tmp_path):
    path, df = str(tmp_path / "v"), spark.range(3)
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    versions.publish(spark, path, df.write.parquet)
    reading = versions.read(spark, path)
    versions.publish(spark, path, lambda folder: reading.union(reading).write.parquet(folder))  # made from what it replaces
    assert versions.read(spark, path).count() == 6 and reading.count() == 3 and versions.read(spark, path, number=1).count() == 3

    def fails(folder):
        df.write.parquet(folder)
        raise OSError("between data and manifest")

    with pytest.raises(OSError):
        versions.publish(spark, path, fails)
    assert versions.numbers(spark, path) == [1, 2] and versions.read(spark, path).count() == 6
    with pytest.raises(versions.Conflict), versions.publishing(spark, path):
        versions.publish(spark, path, df.write.parquet)
    assert versions.numbers(spark, path) == [1, 2, 3]
    gone = versions.expire(spark, path, keep=1)
    assert len(gone) == 3 and versions.numbers(spark, path) == [3] and versions.read(spark, path).count() == 3


def test_documents_are_in_order_and_computed_in_parallel(spark, tmp_path):
    import json

    rows = spark.range(0, 50, 1, 8).select(F.col("id"), (-F.col("id")).alias("n"))
    stats, path = spark.createDataFrame([(50,)], "total long"), str(tmp_path / "d")
    sinks.document(stats, rows, "items", path, order=["n"])
    doc = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
    assert doc["total"] == 50 and [x["id"] for x in doc["items"]] == list(range(49, -1, -1))
    plan = sinks._document(stats, rows, "items", "", "", ["n"])._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "Coalesce 1" not in plan
