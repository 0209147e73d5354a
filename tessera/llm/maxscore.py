"""Exact top-k inner products by MaxScore over shards.

A component x counts as floor(256 * x). Each shard holds its vectors' components by dimension (its postings) with the
least and the largest of each. For a query, a dimension's bound is the most that it can add in this shard. Dimensions
are taken by falling spread of what they add; the essential ones are the fewest after which the rest's bounds
together stay below the threshold. Essential postings are traversed for the whole shard, the others are
probed only for the vectors that are still competitive, in steps, with the threshold rising to the k-th best known
score. Shards' results merge by a window over at most k rows per query and shard.

Vectors move once, to their shard; only the queries are dealt to every shard (a stated query set against all rows).
A task keeps one shard in memory and streams the queries past it, so the queries need no size bound, and nothing is
broadcast. Ties go to the smaller id. Vectors that are null or hold null or
non-finite components take no part, nor does a null id; a query leaves out every row with its own id. Vectors of another length than
the query's are not compared. An empty vector is compared with nothing. Repeated rows count as rows. Sums are exact as 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back

STEP = 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, q (array of long, floor(256 * component)) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad).select("vec_id", F.transform("v", lambda x: F.floor(256 * x).cast("long")).alias("q"))


def top_of_shard(ids: np.ndarray, postings: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the shard's k best for one query. ``postings``: dimension by row; ids ascending."""
    low, high = postings.min(axis=1), postings.max(axis=1)
    bound = np.maximum(query * low, query * high)
    spread = bound - np.minimum(query * low, query * high)
    order = np.argsort(-spread, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what dimensions from here on can still add
    alive = np.flatnonzero(ids != query_id)
    if len(alive) <= k:
        return alive, query @ postings[:, alive]
    seeds = alive[: max(4 * k, 64)]
    scores = query @ postings[:, seeds]
    threshold = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else np.iinfo(np.int64).min
    at = max(int(np.argmax(np.append(rest[:-1] < threshold, True))), 1)  # the essential dimensions
    partial = query[order[:at]] @ postings[order[:at]][:, alive]
    while True:
        keep = partial + rest[at] >= threshold
        alive, partial = alive[keep], partial[keep]
        if at >= len(order):
            break
        own = order[at : at + STEP]
        partial = partial + query[own] @ postings[np.ix_(own, alive)]
        at = min(at + STEP, len(order))
        if len(alive) > k:  # what is certain so far may raise the threshold
            floor = partial + np.minimum(query * low, query * high)[order[at:]].sum()
            threshold = max(threshold, int(np.partition(floor, len(floor) - k)[len(floor) - k]))
    best = np.lexsort((ids[alive], -partial))[:k]
    return alive[best], partial[best]


class Shard:
    """A shard's vectors, by length: ids ascending, and postings (dimension by row)."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.parts = {}
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for size, rows in by.items():
            own = np.array([ids[i] for i in rows], np.int64)
            order = np.argsort(own, kind="stable")
            postings = np.array([vectors[i] for i in rows], np.int64).reshape(len(rows), size)
            self.parts[size] = own[order], np.ascontiguousarray(postings[order].T)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores)"""
        if not len(query) or len(query) not in self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, postings = self.parts[len(query)]
        rows, scores = top_of_shard(ids, postings, query_id, query, k)
        return ids[rows], scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. Both sides: vec_id and q, as from ``quantised``.

    Shards are dealt by a hash of the id, so copies of one vector spread evenly.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    held = vectors.select(own.alias("shard"), F.lit(0).alias("asks"), "vec_id", "q")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "q")
    rows = held.union(asked).repartition("shard").sortWithinPartitions("shard", "asks", "vec_id")

    def compare(batches):
        now, ids, vectors, shard = None, [], [], None
        for b in batches:
            out: list[list] = [[], [], []]
            for number, asks, i, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != now:
                    now, ids, vectors, shard = number, [], [], None
                if not asks:
                    ids.append(i)
                    vectors.append(q)
                    continue
                if shard is None:  # a shard's own vectors come before the queries
                    shard = Shard(ids, vectors)
                    ids, vectors = [], []
                found, scores = shard.best(i, np.array(q, np.int64), k)
                for column, x in zip(out, ([i] * len(found), found.tolist(), scores.tolist()), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])
        give_back()

    found = rows.mapInArrow(compare, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND len(a.v) > 0 WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
