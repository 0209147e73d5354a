"""Removal of byte strings that also start earlier, by external induced sorting of suffixes.

A byte goes if it lies in a ``length``-byte string that starts earlier too (in a smaller document, or before it in
the same one). Instead of all suffixes, those at *anchors* are sorted: in every window of ``length`` bytes the
leftmost 32-byte string of the least hash. Equal windows have equal anchors at equal offsets, so all windows can be
induced from the anchors' suffixes, and about 3 % of the suffixes are anchors.

1. The hashes of all anchors are counted. A bitmap of fixed size (2^27 bits) holds those that occur twice or more.
   It only thins out: what passes by accident drops out later, and if it were full, results would not change.
2. Anchors in the bitmap become suffix tuples: anchor hash, a hash of the bytes that its windows cover (before the
   anchor and from it on), and their place. Tuples of equal bytes merge by partial aggregation, keeping the earliest
   place, so copies cost nothing later: all windows of a later copy go.
3. The merged tuples of anchors that have several get their bytes and are sorted by anchor and suffix, externally, by Spark's disk-backed sort. Each task walks its
   sorted run and induces: the order and common prefixes of suffixes one byte further left follow from those at hand
   (stable by the byte before; common prefix: one more than the least in between). Wherever neighbours share
   ``length`` bytes they are equal windows, and only the earliest stays.
   What equal tuples tell is written before that, and the tuples go.
4. An anchor with more than ``heavy`` different surroundings does not go to one task: its windows are dealt by their
   own hash, aggregated partially to the earliest place, and joined back (a join that Spark may split where skewed).
5. Removed windows meet their document and are cut out.

Null text is empty. Texts shorter than ``length`` stay. Rows with equal doc_id and text are one document whose result
row repeats; equal doc_id with different texts are ordered by a hash of the text. A null doc_id sorts first. Strings
are told apart by a 64-bit hash of the anchor with one of all bytes around it, in step 3 by the bytes themselves, in
step 4 by 128-bit hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, remove, replaced, short_shuffles, small

FILTER_BITS = 27
PLACE_BITS = 20
LEAST = -(1 << 63)


@functools.cache
def _byte_values() -> np.ndarray:
    """A pseudo-random odd number per byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) | 1 for b in range(256)], np.uint64)


MIX = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of ``size`` bytes, put together from hashes of powers of two."""
    power, mult, span = _byte_values()[data], MIX, 1
    out, done = None, 0
    while True:
        if size & span:
            if out is None:
                out, done = power, span
            else:
                n = len(data) - done - span + 1
                out = out[:n] * mult + power[done : done + n]
                done += span
        if 2 * span > size:
            break
        n = len(power) - span
        power = power[:n] * mult + power[span : span + n]
        mult, span = mult * mult, 2 * span
    out = out ^ out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, least = 1, values
    while 2 * n <= width:
        least = np.minimum(least[: len(least) - n], least[n:])
        n *= 2
    count = len(values) - width + 1
    return np.minimum(least[:count], least[width - n : width - n + count])


def spread(least: np.ndarray) -> np.ndarray:
    """Anchor hashes are the least of many, so their leading bits are small; this makes all bits even again."""
    with np.errstate(over="ignore"):
        mixed = (least ^ least >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * MIX
    return mixed.view(np.int64)


def anchors(text: bytes, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, place, and the first and last + 1 window of each anchor of a text, in order."""
    found = []
    width, step = length - size + 1, (1 << PLACE_BITS) - length
    for begin in range(0, max(len(text) - length + 1, 0), step):
        data = np.frombuffer(text[begin : begin + step + length - 1], np.uint8)
        with np.errstate(over="ignore"):
            h = rolling(data, size)
        low = (1 << PLACE_BITS) - 1
        at = (sliding_min(h & np.uint64(~low & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64), width) & np.uint64(low)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        place = at[first]
        found.append((spread(h[place]), place + begin, first + begin, np.append(first[1:], len(at)) + begin))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def slot(keys: np.ndarray) -> np.ndarray:
    """The filter's bit for each key."""
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def repeated_filter(docs: DataFrame, length: int, size: int) -> bytes:
    """The bitmap of anchor hashes that occur twice or more: 2^FILTER_BITS bits, whatever the input's size."""

    def run(batches):
        for b in small(batches):
            for t in b.column(0):
                keys = anchors(t.as_py().encode(), length, size)[0]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    def joined(batches):  # a batch per text is too small to hand over
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    twice = docs.select("text").mapInArrow(joined, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1  # Spark counts these places from one
    maps = twice.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    out = bytearray(1 << FILTER_BITS - 3)
    per = 4096  # bytes of one of Spark's bitmaps
    with short_shuffles(docs.sparkSession):
        found = maps.collect()  # at most 2^FILTER_BITS / 32768 rows of 4096 bytes
    for r in found:
        out[(r["bucket"] - 1) * per : r["bucket"] * per] = r["map"]
    return bytes(out)


TUPLES = "key long, context long, d long, th long, first int, last int, place int, again boolean"
FULL = "key long, contexts long, d long, th long, first int, last int, place int, before binary, suffix binary"


def suffix_tuples(docs: DataFrame, length: int, size: int, bitmap) -> DataFrame:
    """One row per anchor in the bitmap. ``again``: the same bytes stand earlier in the same document."""
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_()]
    names = [c.split()[0] for c in TUPLES.split(", ")]

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        out: list[list] = [[] for _ in names]
        for b in small(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = t.encode()
                key, place, first, last = anchors(text, length, size)
                if not len(key):
                    continue
                at = slot(key)
                some = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
                if not len(some):
                    continue
                th, seen = xxhash.xxh64_intdigest(text, 42), set()
                th -= (th >> 63) << 64
                for k, p, f, z in zip(key[some].tolist(), place[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                    context = xxhash.xxh64_intdigest(text[f : z + length - 1], 1)
                    context -= (context >> 63) << 64
                    again = (k, context) in seen
                    seen.add((k, context))
                    row = (k, context, d, th, f, z, p, again)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, TUPLES)


def with_bytes(docs: DataFrame, tuples: DataFrame, length: int) -> DataFrame:
    """The tuples with the bytes before their anchors and from them on, cut from their documents.

    Tuples meet their document as one list, which is as long as the document has anchors. Documents move once, for all
    tuples, and by a merge at every size: what small tables take then holds for large ones. ``docs``: d, text.
    """
    names = [c.split()[0] for c in FULL.split(", ")]
    per_doc = tuples.groupBy("d", "th").agg(F.collect_list(F.struct("key", "first", "last", "place", "contexts")).alias("found"))
    joined = docs.withColumn("th", F.xxhash64("text")).join(per_doc.hint("merge"), ["d", "th"]).select("d", "th", "text", "found")

    def run(batches):
        for b in small(batches, 256):
            lists = b.column(3)
            size = np.diff(np.asarray(lists.offsets))
            values = lists.flatten()
            key, first, last, place, contexts = (values.field(i) for i in range(5))
            doc = pa.array(np.repeat(np.arange(len(size)), size))
            before, suffix, at = [], [], 0
            f, z, p = (x.to_pylist() for x in (first, last, place))
            for n, t in zip(size.tolist(), b.column(2).to_pylist(), strict=True):
                text = t.encode()
                for i in range(at, at + n):
                    before.append(text[f[i] : p[i]])
                    suffix.append(text[p[i] : z[i] + length - 1])
                at += n
            columns = [key, contexts, b.column(0).take(doc), b.column(1).take(doc), first, last, place, pa.array(before, pa.binary()), pa.array(suffix, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return joined.mapInArrow(run, FULL)


def induce(group: np.ndarray, suffix: list[bytes], before: list[bytes], rank: np.ndarray, length: int) -> np.ndarray:
    """dup[row, o]: whether the window that starts o bytes before the row's anchor equals an earlier one's.

    Rows come sorted by group (anchor) and suffix; ``rank`` orders places. ``order`` holds the suffixes at offset o
    sorted, ``common`` each one's common prefix with its predecessor, counted from the anchor on (-1: different bytes
    before the anchor, or another anchor).
    """
    n = len(suffix)
    sizes = np.fromiter(map(len, suffix), np.int64, n)
    wide = np.zeros((n, length + 1), np.uint8)
    wide[np.arange(length + 1) < sizes[:, None]] = np.frombuffer(b"".join(suffix), np.uint8)
    differ = wide[1:] != wide[:-1]
    common = np.full(n, -1, np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
    common[1:][group[1:] != group[:-1]] = -1
    most = np.fromiter(map(len, before), np.int64, n)
    deep = int(most.max(initial=0))
    left = np.zeros((n, deep), np.int64)  # column o: the byte o + 1 before the anchor
    left[np.arange(deep) < most[:, None]] = np.frombuffer(b"".join(x[::-1] for x in before), np.uint8)
    dup = np.zeros((n, deep + 1), bool)
    order = np.arange(n)
    for o in range(deep + 1):
        begin = np.flatnonzero(common < length - o)
        own = rank[order]
        first = np.minimum.reduceat(own, begin)
        dup[order, o] = own > np.repeat(first, np.diff(begin, append=len(order)))
        if o == deep:
            break
        byte = left[order, o]
        byte[most[order] <= o] = 256  # nothing further left: sorted behind the others of its anchor, then dropped
        code = group[order] * 257 + byte
        new = np.argsort(code, kind="stable")
        same = code[new[1:]] == code[new[:-1]]
        low = np.full(len(new), -1, np.int64)
        pairs = np.flatnonzero(same)
        if len(pairs):  # the least common prefix between the two old places
            ranges = np.stack([new[pairs] + 1, new[pairs + 1] + 1], axis=1).ravel()
            low[pairs + 1] = np.minimum.reduceat(np.append(common, length), ranges)[::2]
        stay = byte[new] < 256
        order, common = order[new[stay]], low[stay]
        if not len(order):
            break
    return dup


SPANS = "d long, th long, begin int, end int"


def runs(dup: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, begin and end of the bytes under runs of marked windows (window at offset o starts at place - o)."""
    padded = np.zeros((dup.shape[0], dup.shape[1] + 2), np.int8)
    padded[:, 1:-1] = dup
    edge = np.diff(padded, axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, place[row] - (high - 1), place[row] - low + length


def induced_spans(tuples: DataFrame, length: int) -> DataFrame:
    """Spans (d, th, begin, end) under windows that equal an earlier one. ``tuples``: no anchor is heavy."""
    sorted_runs = tuples.repartition("key").sortWithinPartitions("key", "suffix").select("key", "d", "th", "place", "before", "suffix")

    def solve(rows: pa.Table):
        key = np.asarray(rows.column("key").combine_chunks())
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        if not many.any():
            return None
        rows = rows.filter(pa.array(many))
        d, th, place = (np.asarray(rows.column(c).combine_chunks()).astype(np.int64) for c in ("d", "th", "place"))
        order = np.lexsort((place, th, d))
        rank = np.empty(len(d), np.int64)
        same = (np.diff(place[order]) == 0) & (np.diff(th[order]) == 0) & (np.diff(d[order]) == 0)
        rank[order] = np.cumsum(np.append(0, ~same))  # repeated rows share their place
        dup = induce(group[many], rows.column("suffix").to_pylist(), rows.column("before").to_pylist(), rank, length)
        row, begin, end = runs(dup, place, length)
        return pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(th[row]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["d", "th", "begin", "end"])

    def walk(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.asarray(b.column(0))
            cutoff = int(np.searchsorted(key, key[-1], "left")) if key[0] != key[-1] else 0
            if cutoff:  # the last anchor may go on in the next batch
                held.append(b.slice(0, cutoff))
                if (out := solve(pa.Table.from_batches(held))) is not None:
                    yield out
                held = [b.slice(cutoff)]
            elif held and np.asarray(held[-1].column(0))[-1] != key[0]:
                if (out := solve(pa.Table.from_batches(held))) is not None:
                    yield out
                held = [b]
            else:
                held.append(b)
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out
        held.clear()
        give_back()

    return sorted_runs.mapInArrow(walk, SPANS)


def window_spans(tuples: DataFrame, length: int) -> DataFrame:
    """The same for heavy anchors: windows dealt by their own hash."""

    def explode(batches):
        for b in small(batches):
            for key, d, th, first, last, before, suffix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = before + suffix
                n = last - first
                high, low = [], []
                for i in range(n):
                    h = xxhash.xxh3_128_intdigest(data[i : i + length])
                    high.append((h >> 64) - ((h >> 127) << 64))
                    low.append((h & (1 << 64) - 1) - ((h >> 63 & 1) << 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([d] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(range(first, last), pa.int32())], names=["h1", "h2", "d", "th", "begin"]
                )

    rows = tuples.select("key", "d", "th", "first", "last", "before", "suffix")
    windows = rows.mapInArrow(explode, "h1 long, h2 long, d long, th long, begin int")
    earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("d", "th", "begin")).alias("least"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(earliest, ["h1", "h2"]).filter(F.struct("d", "th", "begin") != F.col("least"))
    return later.select("d", "th", "begin", (F.col("begin") + length).cast("int").alias("end"))


def repeated_spans(docs: DataFrame, length: int = 100, heavy: int = 2000) -> DataFrame:
    """d, th, begin, end of removed bytes (spans may overlap). ``docs``: d, text."""
    spark: SparkSession = docs.sparkSession
    size = min(32, max(1, length // 3))
    bitmap = spark.sparkContext.broadcast(repeated_filter(docs, length, size))
    tuples = cut(suffix_tuples(docs.select("d", "text"), length, size, bitmap), "tuples")
    fresh = tuples.filter("not again")
    # Equal bytes merge: the earliest place stays, and how many there were. The bytes themselves do not move yet.
    place = F.struct("d", "th", "first", "last", "place")
    merged = fresh.groupBy("key", "context").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    merged = cut(merged.select("key", "context", "n", "at.*"), "merged")
    many = merged.groupBy("key").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > 1)
    # Only the earliest tuples of anchors with several surroundings get their bytes.
    first = cut(merged.join(many, "key").select("key", "d", "th", "first", "last", "place", "contexts"), "first")
    # What equal tuples tell comes before texts move, and tables that were used up go: disk holds one step's.
    end = (F.col("last") + length - 1).cast("int").alias("end")
    inside = tuples.filter("again").select("d", "th", F.col("first").alias("begin"), end)
    copied = merged.filter("n > 1").select("key", "context", F.col("d").alias("d0"), F.col("th").alias("th0"))
    later = fresh.select("key", "context", "d", "th", "first", "last").join(copied, ["key", "context"])
    later = later.filter("d <> d0 or th <> th0").select("d", "th", F.col("first").alias("begin"), end)
    copies = cut(inside.unionAll(later), "copies")
    for used in (tuples, merged):
        remove(spark, used.written_to)
    full = replaced(with_bytes(docs, first, length), "bytes", first)
    few = cut(induced_spans(full.filter(F.col("contexts") <= heavy), length), "induced")
    most = full.filter(F.col("contexts") > heavy)
    most = cut(window_spans(most, length), "windows") if most.limit(1).count() else few.limit(0)
    remove(spark, full.written_to)
    return copies.unionAll(few).unionAll(most)


def deduplicate(docs: DataFrame, length: int = 100, heavy: int = 2000) -> DataFrame:
    """row (the input's columns), n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (maximal), text.

    ``text`` holds what is left in whole characters: a character that a span cuts stays.
    """
    text, d = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long"))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), d.alias("d"))
    spans = repeated_spans(rows.select("d", "text"), length, heavy)
    per_doc = spans.groupBy("d", "th").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    joined = rows.withColumn("th", F.xxhash64("text")).join(per_doc.hint("merge"), ["d", "th"], "left").select("row", "found")  # the row has the text, which moves once
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept", "spans", "text"]
    span = T.StructType().add("begin", "integer").add("end", "integer")
    types = (joined.schema["row"].dataType, T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(span), T.StringType())
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string()]

    def run(batches):
        for b in small(batches):
            out: list[list] = [[] for _ in kinds]
            for t, found in zip(b.column(0).field("text").to_pylist(), b.column(1), strict=True):
                t = t or ""
                text, merged = t.encode(), merge(found)
                kept = without(text, merged)
                whole = t if not merged else without(text, [inner(text, i, j) for i, j in merged]).decode()
                row = (len(text), len(text) - len(kept), len(merged), kept, [{"begin": i, "end": j} for i, j in merged], whole)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)

    return joined.mapInArrow(run, schema)


def merge(found) -> list[tuple[int, int]]:
    """Maximal runs of an Arrow list of (begin, end) structs."""
    if not found.is_valid or not len(found):
        return []
    begin, end = np.asarray(found.values.field(0)), np.asarray(found.values.field(1))
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
    return list(zip(begin[new].tolist(), reach[last].tolist(), strict=True))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for i, j in spans:
        parts.append(text[at:i])
        at = j
    return b"".join([*parts, text[at:]])


def inner(text: bytes, i: int, j: int) -> tuple[int, int]:
    """The whole characters within bytes i to j (a byte of the form 10xxxxxx goes on with a character)."""
    inside = lambda k: k < len(text) and text[k] & 0xC0 == 0x80
    while inside(i):
        i += 1
    while inside(j):
        j -= 1
    return i, max(i, j)
