"""The register that a stream keeps, against a plain replay; restart from the checkpoint; late records."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.plans.queries import QUERIES
from tessera.sources import versions
from tessera.streaming import tracking

SCHEMA = "k string, ts timestamp, r long, v string"
START = dt.datetime(2024, 1, 1)


def rows(*items):
    return [(k, START + dt.timedelta(minutes=m), r, v) for k, m, r, v in items]


def run(spark, tmp_path, parts):
    """Each part is a file that comes later than the one before; the stream is stopped and started again in between."""
    source, path = str(tmp_path / "in"), str(tmp_path / "register")
    dropped = 0
    for part in parts:
        spark.createDataFrame(rows(*part), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = tracking.keep_register(tracking.tracked(stream, "k", "ts", "r", ["v"], "60 minutes", "10 minutes"), path, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        dropped += tracking.dropped(query)
    found = versions.read(spark, path).withColumn("v", F.get_json_object("payload", "$.v"))
    return {r["key"]: (r["v"], r["n"], r["status"]) for r in found.collect()}, dropped


def test_last_record_status_restart_and_late_records(spark, tmp_path):
    got, dropped = run(spark, tmp_path, [
        [("a", 0, 1, "a0"), ("b", 0, 1, "b0"), ("b", 0, 2, "b0 later"), ("c", 5, 1, "c5")],
        [("a", 30, 1, "a30"), ("a", 25, 1, "out of order"), ("c", 8, 9, "too late: the watermark is at 20 in the next batch")],
        [("d", 120, 1, "d120"), ("c", 1, 1, "before the watermark of the batch before")],
        [("b", 119, 1, "b back")],
    ])
    assert got == {"a": ("a30", 3, "stale"), "b": ("b back", 3, "active"), "c": ("too late: the watermark is at 20 in the next batch", 2, "stale"), "d": ("d120", 1, "active")}
    assert dropped == 1


def test_entities_of_one_group_share_a_state_and_a_timer(spark, tmp_path):
    """Python is called per group, not per entity; expiries of entities of one group come one after another."""
    source, path = str(tmp_path / "in"), str(tmp_path / "register")
    many = [(f"k{i}", i % 50, 1, f"v{i}") for i in range(400)]
    steps = [many, [("k7", 60, None, "no rank"), ("k7", 60, 5, "first of equals"), ("k7", 60, 5, "second")], [("late", 95, 1, "x")], [("k8", 200, 1, "back"), ("k9", 86, 1, "in time")]]
    states = []
    for step in steps:
        spark.createDataFrame(rows(*step), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = tracking.keep_register(tracking.tracked(stream, "k", "ts", "r", ["v"], "60 minutes", "10 minutes", groups=2), path, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        states += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    got = {r["key"]: ((r["at"] - rows(("", 0, 0, ""))[0][1].replace(tzinfo=dt.UTC).timestamp() * 1000) / 60000, r["n"], r["status"]) for r in versions.read(spark, path).collect()}
    want = {f"k{i}": (i % 50, 1, "stale") for i in range(400)} | {"k7": (60, 4, "stale"), "k8": (200, 2, "active"), "k9": (86, 2, "stale"), "late": (95, 1, "stale")}
    assert got == want and max(states) == 2
    held = {r["key"]: r["payload"] for r in versions.read(spark, path).filter("key = 'k7'").collect()}
    assert held == {"k7": '{"v":"first of equals"}'}


def test_events_whose_ids_run_against_time_are_all_counted(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("event_id", -F.col("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["tracked_register"](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == events.count()
