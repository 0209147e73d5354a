"""Language identification: script ranges, then Viterbi over per-word scores with a switching penalty.

A word is a run of letters. Its script (by code point ranges) narrows the languages to those that were seen in that
script while training. Its score for a language is the mean log probability of its character n-grams, times its
length. Viterbi over a text's words, with a penalty for each switch, labels spans of mixed-language text; the text's
language is the one that covers most letters. All documents of a batch take their Viterbi steps together.

The model is fitted on about ``sample`` whole documents per language: those whose hash of the id lies below a
threshold that the language's count of documents sets, so no group of rows is sorted or gathered. Prediction reads
every whole text and never looks at lang, source or doc_id. Up to 32,767 languages.

Null texts and texts without a letter are ``und`` with score 0. A word in a script that was never seen counts for all
languages alike. Without training rows everything is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

BITS = 16
LABEL = np.int16
BUCKETS = 1 << BITS
#: Up to so many languages are broadcast with their thresholds; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Hashes for the sample: so many values.
SHARES = 1 << 30
#: First code points of ranges, and the script that holds from there.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x1100, "hangul"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
]
STARTS = [a for a, _ in SCRIPTS]


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point up to U+FFFF is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


@dataclass
class Words:
    """The words of some texts, in order: how many each text has, their lengths, scripts and n-gram buckets.

    ``grams``: for each n, the bucket of the n-gram that starts at each place, or BUCKETS where there is none. A
    word's n-grams start at its places and the one before it; what is no letter stands for a word's end.
    """

    per_text: np.ndarray
    size: np.ndarray
    script: np.ndarray
    first: np.ndarray
    grams: list[np.ndarray]


def cut_words(texts: list[str]) -> Words:
    parts = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in parts]) + 3
    code = np.frombuffer(("   " + "".join(t + " " for t in parts) + "    ").encode("utf-32-le"), "<u4")
    high = code > 0xFFFF
    is_letter = letters()[np.where(high, 0, code)]
    if high.any():
        known, back = np.unique(code[high], return_inverse=True)
        is_letter[high] = np.array([chr(c).isalpha() for c in known])[back]
    c = np.where(is_letter, code, 0).astype(np.uint32)
    edge = np.diff(is_letter.astype(np.int8))
    first, after = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    n = len(c) - 4
    m = [is_letter[k : k + n] for k in range(4)]
    good = [m[0], m[0] | m[1], m[1], m[1] & m[2]]
    grams, h = [], np.zeros(n, np.uint32)
    for k in range(4):
        h = h * np.uint32(0x01000193) + c[k : k + n] + np.uint32(k + 1)
        mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        grams.append(np.where(good[k], mixed >> np.uint32(32 - BITS), BUCKETS).astype(np.int32))
    per_text = np.diff(np.searchsorted(first, ends), prepend=0)
    return Words(per_text, after - first, np.maximum(np.searchsorted(STARTS, code[first], "right") - 1, 0), first, grams)


@dataclass
class Model:
    """Log probabilities by n-gram bucket and language, and the languages seen in each range of SCRIPTS."""

    languages: list[str]
    log_p: np.ndarray
    seen: np.ndarray
    penalty: float

    def scores(self, w: Words) -> np.ndarray:
        """One row per word, the best language at 0."""
        if not len(w.first):
            return np.zeros((0, len(self.languages)), np.float32)
        total = self.log_p[w.grams[0]]
        for g in w.grams[1:]:
            total += self.log_p[g]
        total = np.add.reduceat(total, w.first - 1, axis=0)
        n = w.size + sum(np.maximum(w.size + 3 - k, 0) for k in (2, 3, 4))
        total *= (w.size / n).astype(np.float32)[:, None]
        allowed = self.seen[w.script]
        narrowed = allowed.any(axis=1, keepdims=True) & ~allowed
        total -= narrowed * (20 * w.size).astype(np.float32)[:, None]
        return total - total.max(axis=1, keepdims=True)


def spans(scores: np.ndarray, per_text: np.ndarray, penalty: float) -> np.ndarray:
    """The language number of each word, by Viterbi in each text; the texts' steps run side by side."""
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    starts = (np.cumsum(per_text) - per_text)[order]
    longest, n = int(lengths.max(initial=0)), scores.shape[1]
    live = np.searchsorted(-lengths, -np.arange(longest + 1), "left")  # texts with more than t words
    back = np.zeros(scores.shape, LABEL)
    own = np.arange(n, dtype=LABEL)
    best = scores[starts[: live[0]]] if longest else scores[:0]
    state = np.zeros(len(order), np.int64)
    for t in range(1, longest + 1):
        k = live[t]
        if k < len(best):
            state[k : len(best)] = best[k:].argmax(axis=1)
            best = best[:k]
        if not k:
            break
        top = best.argmax(axis=1)
        switched = best.max(axis=1, keepdims=True) - penalty
        at = starts[:k] + t
        back[at] = np.where(best >= switched, own, top[:, None].astype(LABEL))
        best = np.maximum(best, switched) + scores[at]
    path = np.zeros(len(scores), LABEL)
    for t in range(longest - 1, -1, -1):
        at = starts[: live[t]] + t
        path[at] = state[: live[t]]
        state[: live[t]] = back[at, state[: live[t]]]
    return path


def groups(texts: list[str], chars: int):
    """Runs (from, to) of texts with about so many characters."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.filter("lang is not null and text is not null and not held_out")


def with_split(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and held_out."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), (F.crc32(key.cast("binary")) % 4 == 2).alias("held_out"))


def sampled(train: DataFrame, sample: int) -> DataFrame:
    """lang and text of about ``sample`` documents per language (all, where there are fewer), by a hash of the id."""
    sizes = train.groupBy("lang").agg(F.count("*").alias("_size"))
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    below = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(SHARES)) < F.lit(float(SHARES) * sample) / F.col("_size")
    return train.select("doc_id", "lang", "text").join(sizes, "lang").filter(below).select("lang", "text")


def fit(train: DataFrame, sample: int = 1500, penalty: float = 12.0) -> Model | None:
    """Fit on about ``sample`` whole texts per language. ``train``: doc_id, text, lang."""
    chosen = sampled(train, sample)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for b in small(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = totals.setdefault(lang, np.zeros(BUCKETS + 1 + len(SCRIPTS), np.int64))
                w = cut_words([text])
                for g in w.grams:
                    own[: BUCKETS + 1] += np.bincount(g, minlength=BUCKETS + 1)
                own[BUCKETS + 1 :] += np.bincount(w.script, minlength=len(SCRIPTS))
        for lang, own in totals.items():
            own[BUCKETS] = 0
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])

    counts = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.collect()  # at most BUCKETS + len(SCRIPTS) rows for each language
    languages = sorted({r["lang"] for r in got})
    if len(languages) > np.iinfo(LABEL).max:
        raise ValueError(f"{len(languages)} languages; labels hold {np.iinfo(LABEL).max}")
    if not languages:
        return None
    table = np.zeros((BUCKETS + 1 + len(SCRIPTS), len(languages)))
    for r in got:
        table[r["bucket"], languages.index(r["lang"])] = r["n"]
    words = table[BUCKETS + 1 :]
    seen = words > 0.001 * words.sum(axis=0)
    p = table[:BUCKETS] + 1
    log_p = np.concatenate([np.log(p / p.sum(axis=0)), np.zeros((1, len(languages)))]).astype(np.float32)
    return Model(languages, log_p, seen, penalty)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (the input's columns), lang_pred, score (share of the letters in that language's spans), unseen and spans.

    ``unseen``: the share of letters in words of scripts that no learned language is written in. ``lang_spans``:
    language, first word and number of words of each run. Row-wise.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    span = T.StructType().add("lang", "string").add("first", "integer").add("words", "integer")
    types = {"row": rows.schema["row"].dataType, "lang_pred": T.StringType(), "score": T.DoubleType(), "unseen": T.DoubleType(), "lang_spans": T.ArrayType(span)}
    schema = T.StructType([T.StructField(n, t) for n, t in types.items()])

    def run(batches):
        for b in small(batches, 4096):
            kept, texts = b.column(0), b.column(1).to_pylist()
            for begin, end in groups(texts, 4_000_000):
                part = texts[begin:end]
                if model:
                    scored = map(words_and_scores, (part[i:j] for i, j in groups(part, 200_000)))
                    per_text, size, strange, scores = map(np.concatenate, zip(*scored, strict=True))
                    path = spans(scores, per_text, model.penalty)
                else:
                    per_text, size, path = np.zeros(len(part), np.int64), np.zeros(0, np.int64), np.zeros(0, LABEL)
                    strange = np.zeros(0, bool)
                yield summary(kept.slice(begin, end - begin), per_text, size, path, strange)

    def words_and_scores(texts):
        w = cut_words(texts)  # its n-grams are large and go at once
        return w.per_text, w.size, ~model.seen[w.script].any(axis=1), model.scores(w)

    def summary(kept, per_text, size, path, strange):
        n = len(model.languages) if model else 1
        text = np.repeat(np.arange(len(per_text)), per_text)
        share = np.bincount(text * n + path.astype(np.int64), size, len(per_text) * n).reshape(-1, n)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        names = np.array([*(model.languages if model else []), "und"], object)
        pred = names[np.where(total > 0, best, -1)]
        score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
        unseen = np.bincount(text, size * strange, len(per_text)) / np.maximum(total, 1)
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        starts = np.cumsum(per_text) - per_text
        runs = pa.StructArray.from_arrays(
            [pa.array(names[path[first]], pa.string()), pa.array((first - starts[text[first]]).astype(np.int32)), pa.array(np.diff(first, append=len(path)).astype(np.int32))],
            names=["lang", "first", "words"],
        )
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=len(per_text)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), runs)
        return pa.RecordBatch.from_arrays([kept, pa.array(pred, pa.string()), pa.array(score), pa.array(unseen), lists], names=["row", "lang_pred", "score", "unseen", "lang_spans"])

    return rows.mapInArrow(run, schema)
