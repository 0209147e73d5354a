"""Packing token sequences into as few sequences of ``capacity`` tokens as can be, by bin completion.

Only lengths matter for where a piece goes, and there are at most ``capacity`` of them. So Spark counts the pieces of
each length, and bin completion runs once over those counts: best fit gives the first incumbent, a lower bound says
when no packing can be better (mostly at once), and else the sequences of the longest pieces are filled in every
undominated way, by branch and bound on waste, within ``steps`` steps. Spark then numbers the pieces of each length,
in buckets, and looks up each number's place.

Null and empty texts are one end token. Repeated rows are packed each on its own. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import encoder
from .common import cut, small, with_text

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Steps that the search may take; where they end, the best packing so far stands (best fit's, or a better one).
STEPS = 200_000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token ids of each document plus an end token, cut into pieces of at most ``capacity`` tokens.

    Only documents longer than that are cut; their first piece is the shorter one.
    """

    def run(batches):
        enc = encoder(path)
        for b in small(batches):
            out: list[list] = [[], [], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(t) + end_id.to_bytes(4, "little")
                n = len(ids) // 4
                start, size = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    part = ids[4 * start : 4 * (start + size)]
                    for column, x in zip(out, (i, k, start, size, zlib.crc32(part), part), strict=True):
                        column.append(x)
                    start, size = start + size, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[:n], kinds, strict=False)], names=names[:n])

    return with_text(docs).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


Filling = tuple[int, list[int]]


def best_fit(counts: list[int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on counts: (times used, lengths), without a step for each piece.

    Sequences with equal room are alike, so a length goes to all of them at once, as often as it fits (what is left
    after one piece is the tightest room again).
    """
    rooms: dict[int, list[Filling]] = {capacity: []}
    for n in range(capacity, 0, -1):
        left = counts[n]
        for room in sorted(r for r in rooms if r >= n and rooms[r]):
            each = room // n
            while left and rooms[room]:
                times, filling = rooms[room].pop()
                full = min(times, left // each)
                if full:
                    rooms.setdefault(room - each * n, []).append((full, filling + [n] * each))
                    left, times = left - full * each, times - full
                if times and left:  # fewer than one sequence takes
                    rooms.setdefault(room - left * n, []).append((1, filling + [n] * left))
                    left, times = 0, times - 1
                if times:
                    rooms[room].append((times, filling))
        each = capacity // n
        if left >= each:
            rooms.setdefault(capacity - each * n, []).append((left // each, [n] * each))
        if left % each:
            rooms.setdefault(capacity - left % each * n, []).append((1, [n] * (left % each)))
    return [f for group in rooms.values() for f in group]


def lower_bound(counts: list[int], capacity: int) -> int:
    """No packing has fewer sequences: pieces over half a sequence need one each, and small ones what these leave."""
    n = np.arange(capacity + 1)
    c = np.asarray(counts[: capacity + 1], object)
    pieces, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * n)])
    many = lambda lo, hi: pieces[hi + 1] - pieces[lo]  # noqa: E731  pieces of lo to hi tokens
    much = lambda lo, hi: tokens[hi + 1] - tokens[lo]
    best, half = -(-tokens[-1] // capacity), capacity // 2
    for k in range(1, half + 1):  # pieces under k are left out
        alone, large = many(capacity - k + 1, capacity), many(half + 1, capacity - k)
        over = much(k, half) - (large * capacity - much(half + 1, capacity - k))
        best = max(best, alone + large + max(0, -(-over // capacity)))
    return int(best)


def dominated(filling: list[int], left: int, counts: list[int]) -> bool:
    """Whether a longer piece that is at hand could stand for one or more of the filling's (``left``: its waste)."""
    sums = {0}
    for n in filling if len(filling) <= 10 else filling[:0]:
        sums |= {x + n for x in sums}
    used = {n: filling.count(n) for n in filling}
    for x in sums - {0}:
        for y in range(x, x + left + 1):
            if y < len(counts) and counts[y] > used.get(y, 0) and y not in filling:
                return True
    return False


def fillings(room: int, counts: list[int], most_waste: int, budget: list[int], share: int):
    """Undominated fillings of ``room`` by rising waste, larger pieces first.

    Each step takes one from ``budget``, and those of one waste take ``share`` at most, so that a waste for which
    the counts run short can't spend it all.
    """
    lengths = [n for n in range(min(room, len(counts) - 1), 0, -1) if counts[n]]
    below = [0] * (len(lengths) + 1)  # tokens of the pieces of this and shorter lengths
    for k in reversed(range(len(lengths))):
        below[k] = below[k + 1] + lengths[k] * counts[lengths[k]]
    reach = 1  # bit s: some lengths add up to s, whatever their counts
    for n in reversed(lengths):
        if (reach >> n) + 1 == 1 << room - n + 1:  # all from here on is reached: longer pieces add nothing
            break
        step = n
        while step <= room:
            reach |= reach << step
            step *= 2
        reach &= (1 << room + 1) - 1

    own = [0]

    def exact(left: int, first: int, chosen: list[int]):
        budget[0] -= 1
        own[0] -= 1
        if not left:
            yield list(chosen)
            return
        for k in range(first, len(lengths)):
            n = lengths[k]
            if budget[0] <= 0 or own[0] <= 0 or left > below[k]:
                return
            if n > left or chosen.count(n) >= counts[n] or not reach >> left - n & 1:
                continue
            chosen.append(n)
            yield from exact(left - n, k, chosen)
            chosen.pop()

    for waste in range(max(room - below[0], 0), min(most_waste, room) + 1):
        if reach >> room - waste & 1:
            own[0] = share
            for f in exact(room - waste, 0, []):
                if not dominated(f, waste, counts):
                    yield waste, f
        if budget[0] <= 0:
            return


def complete(counts: list[int], capacity: int, best: list[Filling], low: int, steps: int) -> list[Filling]:
    """Bin completion by branch and bound: ``best`` or a packing with fewer sequences.

    Each node fills the sequence of the longest piece that is left, in every undominated way, as often as counts allow
    or once. A branch ends where its waste exceeds what a packing better than the incumbent may waste, or (after the
    first dive, where waste alone decides) where the lower bound of what is left does not beat it.
    """
    counts, budget = list(counts), [steps]
    total, size = sum(n * c for n, c in enumerate(counts)), sum(t for t, _ in best)
    path: list[Filling] = []
    used = wasted = 0

    def children():
        largest = max(n for n, c in enumerate(counts) if c)
        allowed = (size - 1) * capacity - total - wasted
        counts[largest] -= 1
        found = fillings(capacity - largest, counts, allowed, budget, max(steps // 100, 100))
        while True:
            got = next(found, None)
            counts[largest] += 1
            if got is None:
                return
            filling = [largest, *got[1]]
            times = min(counts[n] // filling.count(n) for n in set(filling))
            for t in dict.fromkeys((times, 1)):
                if wasted + t * got[0] <= (size - 1) * capacity - total:
                    yield t, filling
            counts[largest] -= 1

    def bounded() -> int:
        budget[0] -= capacity // 32  # about what it costs
        return lower_bound(counts, capacity)

    def use(t: int, filling: list[int], sign: int) -> None:
        nonlocal used, wasted
        for n in filling:
            counts[n] -= sign * t
        used, wasted = used + sign * t, wasted + sign * t * (capacity - sum(filling))

    stack, dived = [children()], False
    while stack and budget[0] > 0 and size > low:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            dived = True
            if path:
                use(*path.pop(), -1)
            continue
        use(*step, 1)
        path.append(step)
        budget[0] -= 1 + capacity // 256  # about what a node costs
        if not any(counts):
            dived = True
            if used < size:
                best, size = list(path), used
        elif not dived or used + bounded() < size:
            stack.append(children())
            continue
        use(*path.pop(), -1)
    return best


def solve(counts: list[int], capacity: int, steps: int = STEPS) -> list[Filling]:
    """Fillings as (times used, lengths, largest first); ``counts[n]``: pieces of length n. Never worse than best fit."""
    best, low = best_fit(counts, capacity), lower_bound(counts, capacity)
    if sum(t for t, _ in best) > low:
        best = complete(counts, capacity, best, low, steps)
    return best


def places(fillings: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length, runs of piece numbers: where a run begins, its first sequence, pieces a sequence, offset."""
    runs, following, sequence = [], {}, 0
    for times, filling in fillings:
        offset = 0
        for n in dict.fromkeys(filling):
            k = filling.count(n)
            begin = following.get(n, 0)
            runs.append((n, begin, sequence, k, offset))
            following[n] = begin + k * times
            offset += k * n
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return dict(zip(("length", "begin", "sequence", "each", "offset"), table.T, strict=True))


def pack(parts: DataFrame, capacity: int = 2048, steps: int = STEPS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``parts`` should be a written table: it is read three times.

    Columns of ``parts`` named _bucket, _before, _inside or _number are overwritten.
    """
    found = parts.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = [0] * (capacity + 1)
    for r in found:
        counts[r["length"]] = r["count"]
    runs = places(solve(counts, capacity, steps))
    buckets = max(8, -(-sum(counts) // 50_000))
    numbered = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = numbered.groupBy("length", "_bucket").count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = numbered.withColumn("_inside", inside - 1).join(sizes, ["length", "_bucket"])
    names = [c for c in parts.columns]
    numbered = numbered.select(*names, (F.col("_before") + F.col("_inside")).cast("long").alias("_number"))

    def look_up(batches):
        lengths, begins = runs["length"], runs["begin"]
        for b in batches:
            n, r = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "_number"))
            at = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                own, (lo, hi) = n == length, np.searchsorted(lengths, [length, length + 1])
                at[own] = lo + np.searchsorted(begins[lo:hi], r[own], "right") - 1
            step = r - begins[at]
            sequence = runs["sequence"][at] + step // runs["each"][at]
            offset = runs["offset"][at] + step % runs["each"][at] * n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(look_up, T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place; encodes once and keeps the pieces in the shared folder."""
    return pack(cut(pieces(docs, path, capacity, keep_ids=keep_ids), "pieces"), capacity)
