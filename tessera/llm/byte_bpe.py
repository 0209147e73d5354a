"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap (one up to ``chunk_chars`` is a single chunk), and every chunk is pre-tokenised
on its own, in parallel. Two neighbours are stitched where their pre-token boundaries first coincide behind a visible
character: from such a place on, the left-to-right pattern matches alike, and what stands before it needs no look at
what follows. The pieces between such places are encoded in parallel too, and a text's ids are put together at last.
A document with a pre-token or white space longer than the overlap has no such place; its chunks are stitched in one
task, by running the pattern on from the last sure boundary. Decoding concatenates the tokens' bytes.

Null and empty texts have no ids. Rows that are repeated give repeated results; doc_id may be null or repeated.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Units, Vocabulary, split_special, splitter
from .common import cut, small, with_text

SCHEMA = "doc_id long, n_tokens long, ids binary"


class Encoder:
    """Per worker: pieces to ids (little-endian unsigned 32-bit) and back, for one vocabulary."""

    def __init__(self, path: str):
        vocab = Vocabulary.load(path)
        order = sorted((t for t in vocab.ids if t not in vocab.ranks), key=vocab.ids.__getitem__)
        order += sorted(vocab.ranks, key=vocab.ranks.__getitem__)
        self.special = vocab.special
        self.same = all(vocab.ids[t] == n for n, t in enumerate(order))
        self.ids = np.array([vocab.ids[t] for t in order], "<u4")
        self.lib = tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks={t: n for n, t in enumerate(order)}, special_tokens={})
        self.tokens = {vocab.ids[t]: t for t in order} | {i: s.encode() for s, i in vocab.special.items()}
        self.units = Units(self.plain)

    def plain(self, text: str) -> bytes:
        got = np.array(self.lib.encode_ordinary(text), "<u4")
        return (got if self.same else self.ids[got]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.special or not any(s in text for s in self.special):
            return b"".join(self.units.of(text, self.plain))
        return b"".join(int(i).to_bytes(4, "little") if i is not None else b"".join(self.units.of(part, self.plain)) for part, i in split_special(text, self.special))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def piece(self, text: str) -> bytes:
        return self.plain(text)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters at a chunk's end in which a boundary may still move: the longest contraction of the pattern.
UNSURE = 3


def pretokenise(text: str) -> list[int]:
    """Where pre-tokens start."""
    return [m.start() for m in splitter().finditer(text)]


def stitch(chunks: list[tuple[int, str, list[int]]]) -> list[tuple[int, int, int]]:
    """(chunk, first, last): slices of the chunks' characters whose pre-tokens together are those of the whole text.

    ``chunks``: offset, text and pre-token starts (within the chunk), in order. A slice may reach into the next
    chunks' text, where a pre-token is longer than the overlap.
    """
    out, at = [], 0
    for k, (offset, text, starts) in enumerate(chunks):
        end, final = offset + len(text), k + 1 == len(chunks)
        if at >= end and not final:
            continue
        if final:
            out.append((k, at - offset, len(text)))
            break
        following = {chunks[k + 1][0] + s for s in chunks[k + 1][2]}
        sure = [offset + s for s in starts if offset + s <= end - UNSURE]
        # White space is split by what follows it, so a slice must not end in it.
        joint = next((p for p in sure if p >= max(at, chunks[k + 1][0]) and p in following and not text[p - offset - 1].isspace()), None)
        if joint is None:  # run on from the last sure boundary over the text that follows
            begin = max((p for p in sure if p >= at), default=at) if at - offset in starts else at
            long, m = text[begin - offset :], k
            joint = None
            while joint is None:
                m += 1
                long += chunks[m][1][max(0, begin + len(long) - chunks[m][0]) :]
                last, known = m + 1 == len(chunks), {chunks[m][0] + s for s in chunks[m][2]}
                found = (begin + x.start() for x in splitter().finditer(long))
                joint = next((p for p in found if p > begin and p >= chunks[m][0] and p in known and (last or p <= begin + len(long) - UNSURE) and not long[p - begin - 1].isspace()), None)
                if joint is None and last:
                    joint = begin + len(long)
        out.append((k, at - offset, joint - offset))
        at = joint
    return out


CHUNK = "did long, key string, offset int, text string, head array<int>, tail array<int>"
#: Up to so many chunks' places or documents' names (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def encode(docs: DataFrame, path: str, chunk_chars: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every document; other columns are dropped.

    Only documents longer than a chunk are shuffled, chunk by chunk.
    """
    rows = with_text(docs)

    def whole(batches):
        for b in small(batches):
            ids = [encoder(path).encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    def boundaries(batches):
        for b in small(batches, 64):
            heads, tails = [], []
            for offset, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = pretokenise(t)
                heads.append([offset + s for s in found if s < overlap])
                tails.append([offset + s for s in found if chunk_chars <= s <= len(t) - UNSURE and not t[s - 1].isspace()])
            columns = [*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["did", "key", "offset", "text", "head", "tail"])

    def pieces(batches):
        for b in small(batches, 64):
            ids = [encoder(path).encode(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], names=["did", "key", "offset", "ids"])

    def together(batches):
        now, parts = None, []
        for b in batches:
            out: list[list] = [[], [], []]
            for did, key, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (did, key) != now:
                    for column, x in zip(out, (*now, b"".join(parts)) if now else (), strict=False):
                        column.append(x)
                    now, parts = (did, key), []
                parts.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["did", "key", "ids"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.string()), pa.array([b"".join(parts)], pa.binary())], names=["did", "key", "ids"])

    def join(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        parts = [(o, t, pretokenise(t)) for o, t in zip(pdf.offset, pdf.text, strict=True)]
        ids = b"".join(encoder(path).encode(_slice(parts, k, a, z)) for k, a, z in stitch(parts))
        return pd.DataFrame({"did": pdf.did.iloc[:1], "key": pdf.key.iloc[:1], "ids": [ids]})

    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(whole, SCHEMA)
    long, name = rows.filter(F.length("text") > chunk_chars), ["did", "key"]
    key = F.concat(F.md5(F.col("text").cast("binary")), F.when(F.col("doc_id").isNull(), "n").otherwise(""))
    long = long.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), key.alias("key"), "text")
    steps = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk_chars))
    cuts = long.select(*name, "text", F.explode(steps).alias("offset"))
    cuts = cuts.select(*name, "offset", F.expr(f"substring(text, offset + 1, {chunk_chars + overlap})").alias("text"))
    copies = cut(long.groupBy(*name).count().filter("count > 1"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    chunks = cut(cuts.dropDuplicates([*name, "offset"]).select(*name, "offset", "text").mapInArrow(boundaries, CHUNK), "chunks")
    # Where each chunk's piece begins and ends: boundaries near its ends that its neighbours share. No text moves here.
    sides = chunks.select(*name, "offset", "head", "tail")
    following = sides.select(*name, (F.col("offset") - chunk_chars).alias("offset"), F.col("head").alias("next"))
    ends = sides.join(following, [*name, "offset"], "left").select(*name, "offset", F.array_min(F.array_intersect("tail", "next")).alias("end"), F.col("next").isNotNull().alias("goes_on"))
    ends = cut(ends, "ends")
    begins = ends.filter("goes_on").select(*name, (F.col("offset") + chunk_chars).alias("offset"), F.col("end").alias("begin"))
    hard = cut(ends.filter("goes_on and end is null").select(*name).distinct(), "hard")
    some = hard.count()
    hard = F.broadcast(hard) if some <= BROADCAST_ROWS else hard
    places = ends.join(begins, [*name, "offset"], "left").select(*name, "offset", "begin", "end")
    places = cut(places.join(hard, name, "left_anti") if some else places, "places")
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    begin = F.coalesce("begin", "offset") - F.col("offset")
    easy = chunks.select(*name, "offset", "text").join(places, [*name, "offset"])
    easy = easy.select(*name, "offset", F.substring("text", begin + 1, F.coalesce(F.col("end") - F.col("offset"), F.length("text")) - begin).alias("text"))
    parts = easy.mapInArrow(pieces, "did long, key string, offset int, ids binary")
    found = parts.repartition(*name).sortWithinPartitions(*name, "offset").mapInArrow(together, "did long, key string, ids binary")
    if some:
        rest = chunks.select(*name, "offset", "text").join(hard, name, "left_semi").groupBy(*name)
        found = found.union(rest.applyInPandas(join, "did long, key string, ids binary"))
    found = found.join(copies, name, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("count", F.lit(1)).cast("int"))))
    doc_id = F.when(~F.col("key").endswith("n"), F.col("did"))
    return short.unionByName(found.select(doc_id.alias("doc_id"), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"))


def _slice(parts, k: int, first: int, last: int) -> str:
    offset, text, _ = parts[k]
    while len(text) < last:  # the slice reaches beyond the chunk
        k += 1
        text += parts[k][1][max(0, offset + len(text) - parts[k][0]) :]
    return text[first:last]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The encoded rows with ``decoded`` (the tokens' bytes, concatenated) beside their ids."""

    def run(batches):
        for b in small(batches):
            raw = [encoder(path).decode(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, SCHEMA + ", decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The ids and decoded bytes as SHA-256 digests."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
