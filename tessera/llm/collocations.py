"""Phrase collocations of each language, counted over a prefix-free parse.

1. Texts are split into pieces and words, and pieces into chunks at content: a window of ``max_words - 1`` words whose
   hash says so ends one chunk and begins the next, and belongs to both. So equal passages give equal chunks wherever
   they stand, and the dictionary of distinct chunks with their frequencies (partial aggregation) replaces the texts.
2. A chunk owns the phrases that start before its last window (the one at a piece's end: all), so each occurrence is
   counted in exactly one chunk, times the chunk's frequency.
3. Counting goes by 64-bit hashes, each with a place where the phrase stands: words and pairs of words, then longer
   phrases all of whose pairs reached ``min_count``. Which did is known by a bitmap of fixed size (2^FILTER_BITS bits). It
   only thins out: what passes by accident, or through a full bitmap, is dropped by its own count. The phrases that are
   left get their words from the chunks that they were seen in.
4. Candidates meet the counts of the parts at each cut, and the candidates that hold them, by joins on (lang, phrase).

Null lang is ``und``, null text empty; repeated rows count again; an empty table has no phrase. Words may be as long as
they like; a piece without end is one list of words in a task. Columns other than lang and text are ignored. Numbers of
words stay below 2^53; products are decimals of 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, short_shuffles, small

FILTER_BITS = 27
#: One window in so many ends a chunk. Pieces of up to SHORT words are one chunk.
RARITY, SHORT = 16, 8
#: Chunks and hashes that a task holds before it hands on what it has added up.
HELD_CHUNKS, HELD_HASHES = 1 << 16, 1 << 19
MIX, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A-Z to lower case, and whatever ends a piece to a line feed.
PLAIN = bytes(10 if chr(b) in ".,;:!?\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: str):
    """The words of each piece of a text."""
    for p in text.encode().translate(PLAIN).split(b"\n"):
        if words := p.split():  # spaces and tabs: nothing else that bytes.split() takes for a space is left
            yield words


def chunks(words: list[bytes], overlap: int):
    """(chunk, words it owns) of a piece: consecutive ones share a window of ``overlap`` words."""
    begin = 0
    if len(words) > SHORT:
        for i in range(1, len(words) - overlap):
            if xxhash.xxh64_intdigest(b" ".join(words[i : i + overlap])) % RARITY == 0:
                yield words[begin : i + overlap], i - begin
                begin = i
    yield words[begin:], len(words) - begin


def parse(docs: DataFrame, max_words: int) -> DataFrame:
    """lang, chunk (words joined by spaces, UTF-8), own (phrases start at so many words), n: the dictionary of chunks."""
    overlap = max(1, max_words - 1)

    def run(batches):
        held: dict[tuple, int] = {}

        def out():
            rows = list(held)
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "own", "n"])

        for b in small(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in pieces(text):
                    for chunk, own in chunks(words, overlap):
                        key = (lang, b" ".join(chunk), own)
                        held[key] = held.get(key, 0) + 1
                if len(held) >= HELD_CHUNKS:
                    yield out()
        yield out()
        give_back()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, chunk binary, own int, n long").groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def large(batches, rows: int = 1 << 15):
    """Batches put together into larger ones, so that equal words and phrases meet before Python sees them."""
    held, n = [], 0
    for b in batches:
        for part in (b.slice(i, rows) for i in range(0, b.num_rows, rows)):
            held.append(part)
            n += part.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Grams:
    """The phrases of a part of the dictionary: for each word, hashes of the phrases that start there."""

    def __init__(self, t: pa.Table) -> None:
        lang, chunk, own, n, chunk_id = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
        lists = pc.split_pattern(chunk, pattern=" ")
        size = np.diff(np.asarray(lists.offsets))
        codes = lists.flatten().dictionary_encode()
        self.row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(self.row)) - np.repeat(np.cumsum(size) - size, size)
        self.left = np.repeat(size, size) - place
        self.owned = place < np.asarray(own)[self.row]
        self.weight, self.place, self.id = np.asarray(n)[self.row], place, np.asarray(chunk_id)[self.row]
        langs = lang.dictionary_encode()
        word, of_lang = (np.fromiter(map(xxhash.xxh64_intdigest, x), np.uint64, len(x)) for x in (codes.dictionary.to_pylist(), langs.dictionary.to_pylist()))
        self.hashes = [_mixed(word[np.asarray(codes.indices)] ^ _mixed(of_lang)[np.asarray(langs.indices)][self.row])]

    def hash(self, k: int) -> np.ndarray:
        """Of the k words from each word on (at a chunk's end: of fewer)."""
        while len(self.hashes) < k:
            n = len(self.hashes)
            later = np.append(self.hashes[0][n:], np.zeros(min(n, len(self.row)), np.uint64))
            with np.errstate(over="ignore"):
                self.hashes.append(_mixed(self.hashes[-1] * MIX + later))
        return self.hashes[k - 1]

    def starts(self, k: int) -> np.ndarray:
        return self.owned & (self.left >= k)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * MORE
        return (h ^ h >> np.uint64(29)) * MIX


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set: the leading bits count, as many as number the bitmap's."""
    at = (h >> np.uint64(61 - len(bits).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def bitmap(keys: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the keys' leading bits set: the same size for any number of keys."""
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1  # Spark counts these places from one
    maps = keys.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    out, per = np.zeros(1 << FILTER_BITS - 3, np.uint8), 4096
    with short_shuffles(keys.sparkSession):
        for r in maps.collect():  # at most 2^FILTER_BITS / 32768 rows of 4096 bytes
            out[(r["bucket"] - 1) * per : r["bucket"] * per] = np.frombuffer(r["map"], np.uint8)
    return out


def with_ids(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("lang", "chunk", "own", "n", F.xxhash64("lang", "chunk", "own").alias("id"))


def reaching(dictionary: DataFrame, min_count: int, lengths, bits=None) -> DataFrame:
    """key, n, id, at of the phrases of these lengths that occur often enough. One stands in chunk ``id``; ``at`` is 256 times
    its first word's place there, and its length.

    ``dictionary``: as from ``with_ids``. ``bits``: a broadcast bitmap of what all phrases one word shorter than the
    shortest in them must be.
    """
    shortest = min(lengths)

    def counted(held: list[tuple[np.ndarray, ...]]):
        key, weight, chunk, at = (np.concatenate(x) for x in zip(*held, strict=True))
        value, first, which = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=weight, minlength=len(value)).astype(np.int64)
        columns = [value.view(np.int64), total, chunk[first], at[first]]
        for i in range(0, len(value), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["key", "n", "id", "at"])

    def run(batches):
        held, size = [], 0
        for t in large(batches):
            g = Grams(t)
            part = marked(bits.value, g.hash(shortest - 1)) if bits else None
            for k in lengths:
                some = g.starts(k)
                for i in range(k - shortest + 2 if bits else 0):  # each phrase of shortest - 1 words in it
                    some[: len(some) - i] &= part[i:]
                at = np.flatnonzero(some)
                held.append((g.hash(k)[at], g.weight[at], g.id[at], g.place[at] * 256 + k))
                size += len(at)
            if size >= HELD_HASHES:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)
        give_back()

    found = dictionary.mapInArrow(run, "key long, n long, id long, at long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("id", "at"))).filter(F.col("n") >= min_count)


def phrases(dictionary: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """lang, phrase, size, f: every phrase of up to ``max_words`` words with at least ``min_count`` occurrences."""
    context, chunks_ = dictionary.sparkSession.sparkContext, with_ids(dictionary)
    found = cut(reaching(chunks_, min_count, range(1, min(max_words, 2) + 1)), "short")
    if max_words > 2:
        shared = context.broadcast(bitmap(found.select("key")))
        found = found.union(cut(reaching(chunks_, min_count, range(3, max_words + 1), shared), "long"))
        shared.destroy()
    shared = context.broadcast(bitmap(found.select(F.col("id").alias("key"))))

    def named(batches):
        for b in batches:
            yield b.filter(pa.array(marked(shared.value, np.asarray(b.column(2)).view(np.uint64))))

    some = chunks_.select("lang", "chunk", "id").mapInArrow(named, "lang string, chunk binary, id long")
    size, place = (F.col("at") % 256).cast("int"), F.floor(F.col("at") / 256).cast("int")
    words = F.slice(F.split(F.col("chunk").cast("string"), " "), place + 1, size)
    return found.join(some, "id").select("lang", F.array_join(words, " ").alias("phrase"), size.alias("size"), F.col("n").alias("f"))


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of up to ``max_words`` (255) by their weakest cut."""
    dictionary = cut(parse(docs, max_words), "chunks")
    counts = cut(phrases(dictionary, max_words, min_count), "phrases")
    words = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    return ranked(scored(counts, words), top)


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of several words that no longer one of their count holds."""
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    places = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = found.select("lang", "phrase", "a", "words", "size", places)
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(words) if words.limit(4097).count() <= 4096 else words, "lang")
    exact = {c: F.col(c).cast("decimal(20,0)") for c in "alrn"}
    cuts = cuts.withColumn("above", (exact["a"] * exact["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("score", F.expr("above div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))))
    held = found.filter("size > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(held, ["lang", "phrase"], "left").filter("longer is null or longer < a")
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(rows: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language; a language's rows are thinned out in ``salts`` parts before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(words[i : i + k - 1], ' ') FOR i IN range(1, len(words) - k + 2)]) AS phrase FROM w, range(1, 6) t(k)),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, i, (1000 * a * n) // (x.f * y.f) AS score
  FROM c CROSS JOIN range(1, 5) t(i) JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[i + 1 : c.k], ' ')
  WHERE i < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
held AS (
  SELECT DISTINCT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, a AS longer
  FROM c CROSS JOIN range(2, 5) s(j) CROSS JOIN range(1, 5) t(i) WHERE j < k AND i + j - 1 <= k),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.longer >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
