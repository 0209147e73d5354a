"""What a task holds, and where work and data go: figures that must not grow with the tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import batches
from tessera.functions import text
from tessera.operators import crawl, text_index
from tessera.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_handed_on_by_weight():
    schema = pa.schema([("k", pa.int64()), ("t", pa.list_(pa.string()))])
    rows = [(i, ["x"] * 10) for i in range(1000)]
    got = list(batches.batches_of(iter(rows), schema, lambda r: len(r[1]), most=100))
    assert [b.num_rows for b in got] == [10] * 100 and list(batches.rows_of(got, 3)) == rows
    assert list(batches.batches_of(iter([]), schema)) == []
    assert batches.mapped(lambda a: a and a + 1, pa.int64(), pa.array([1, None, 3]), size=2).to_pylist() == [2, None, 4] and len(batches.mapped(len, pa.int64(), pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("name", ["pdf_files", "page_tables", "decoded_pages"])
def test_readers_take_batches_apart_by_themselves(spark, name):
    """No pandas frame of a whole batch: neither of files nor of what they hold."""
    p = plan(QUERIES[name](spark, D))
    assert "MapInPandas" not in p and ("MapInArrow" in p or "ArrowEvalPython" in p)


def test_texts_without_another_reading_are_not_counted(monkeypatch):
    monkeypatch.setattr(text, "quality", lambda t: 1 / 0)
    assert [text.recover(t) for t in ("Направление 12", "plain", "очная — 5")] == ["Направление 12", "plain", "очная — 5"]


def test_roles_of_a_small_file_are_found_by_many_tasks(spark):
    assert QUERIES["header_roles"](spark, D).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_crawl_broadcasts_nothing(spark):
    level = spark.createDataFrame([(1, 1, "a", 0)], "k int, pos int, url string, n_before int")
    facts = spark.createDataFrame([("a", "a", True, False, True)], "url string, final string, is_html boolean, table boolean, landed boolean")
    links = spark.createDataFrame([("a", 0, "b")], "url string, place int, link string")
    tried = crawl._tried(level, facts, level.select("k", F.lit("z").alias("url")), "k", 25)
    queued = crawl._queued(tried, links, level.select("k", "url"), level.groupBy("k").agg(F.max("pos").alias("size")), "k", 50)
    assert [(r["k"], r["pos"], r["url"]) for r in queued.collect()] == [(1, 1, "b")]
    assert "Broadcast" not in plan(tried) + plan(queued)


def test_an_index_works_its_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "k long, a string")
    text_index.build(rows.withColumn("a", counted("a")), "k", ["a"], str(tmp_path / "i"), slots=4)
    assert seen.value == 50 and [r["key"] for r in text_index.search(spark, str(tmp_path / "i"), "t 49").collect()] == [49]


def test_header_kinds_names_forms(spark):
    got = QUERIES["header_kinds"](spark, D).select("p_partkey", "form_literal").collect()
    assert {r["form_literal"] for r in got} == {"", "очно-заочная"} and all((r["form_literal"] != "") == (r["p_partkey"] % 18 == 16) for r in got)
