"""A register kept by a stream: the last record of every entity, and whether it was seen in time.

Keyed state (``applyInPandasWithState``) holds one record per entity and when it turns stale. A later record replaces it
and moves that time; when the watermark reaches it, the entity turns stale, until a record comes again. Records within the
watermark may come in any order; those beyond it are dropped by Spark, which counts them (``dropped``).

Entities are dealt into groups by a hash. A group's records are one state, a table in Arrow's form, with one timer, at
the earliest of its entities' times: Python is called per group and micro-batch and works on whole columns, not per entity.
A group's state is written whole where one of its entities changes, as the published register is.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.enrich import last_wins, upsert
from ..shared import cut
from ..sources import versions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def merged(held: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
    """One row per key of both: the last by time and rank (of equals the first that came), and how many there were."""
    rows = new if held is None else pd.concat([held, new], ignore_index=True)
    last = rows.sort_values(["at", "rank"], ascending=False, kind="stable").drop_duplicates("key")
    together = rows.groupby("key", sort=False, dropna=False)
    return last.assign(n=together["n"].transform("sum"), touched=together["touched"].transform("any"))


def register(quiet_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The update of a group's state, which yields an entity's record whenever it changes: key, at (ms), n (records so far), payload, status."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            held = pa.ipc.open_stream(state.get[0]).read_pandas().assign(touched=False)
        for part in rows:
            if len(part):
                held = merged(held, part[["key", "at", "rank", "payload"]].assign(n=1, touched=True, stale=False))
        ends, watermark = held["at"] + quiet_ms, state.getCurrentWatermarkMs()
        stale = ends <= watermark
        changed = held[held["touched"] | (stale & ~held["stale"])]
        held["stale"] = stale
        kept = pa.Table.from_pandas(held.drop(columns="touched"), preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, kept.schema) as writer:
            writer.write_table(kept)
        state.update((out.getvalue().to_pybytes(),))
        if not stale.all():
            state.setTimeoutTimestamp(max(int(ends[~stale].min()) - 1, 1))  # Spark's timers expire when the watermark is past them, not at them
        if len(changed):
            yield changed[["key", "at", "n", "payload"]].assign(status=np.where(stale[changed.index], "stale", "active"))

    return update


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Within it, streams start with the state store that keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def tracked(events: DataFrame, key: str, ts: str, rank: str, payload: list[str], quiet: str, late: str, groups: int = 256) -> DataFrame:
    """key, at, n, payload, status of entities that change, as a stream.

    ``rank`` decides between records of one time; ``payload`` columns come back as one JSON text. ``quiet``: after how long
    without a record an entity is stale; ``late``: how far out of order records may come. ``groups``: into how many groups entities are dealt, a checkpoint's
    number stays as it is.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), ts, F.unix_millis(ts).alias("at"), F.coalesce(F.col(rank).cast("long"), F.lit(-(1 << 63))).alias("rank"), F.to_json(F.struct(*payload)).alias("payload"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, at long, n long, payload string, status string"
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInPandasWithState(register(quiet_ms), schema, "entities binary", "update", "EventTimeTimeout")


def keep_register(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish the register as versions below ``path``: each micro-batch's changes replace the entities that they name.

    A batch that is run again after a failure gives the same register, so it may be published twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Written first, so that the stateful plan runs once. Of a record and its expiry in one batch, the expiry counts.
        new = cut(last_wins(batch, ["key"], ["at", "n", "status"]), "changes")
        base = versions.read(spark, path) if versions.numbers(spark, path) else new.limit(0)
        versions.publish(spark, path, upsert(base, new, "key").write.parquet)
        versions.expire(spark, path, keep=2)

    with state_store(changes.sparkSession):
        return changes.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """Records that came too late for the watermark, by the query's progress so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
