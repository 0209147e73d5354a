"""Phrase collocations against brute force over every occurrence."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations


def brute_force(rows, max_words=5, min_count=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    held = set()
    for (lang, longer), a in often.items():
        for k in range(2, len(longer)):
            for i in range(len(longer) - k + 1):
                if a >= often[lang, longer[i : i + k]]:
                    held.add((lang, longer[i : i + k]))
    by_lang = {}
    for (lang, p), a in often.items():
        if (lang, p) in held:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang.setdefault(lang, []).append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, found in by_lang.items():
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(found[:top], 1)]
    return sorted(out)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n long")
    got = collocations.collocations(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def texts(seed, many=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "日本", " x", "it's", "(a)"]
    passage = " ".join(rng.choices(words, k=25))
    rows = []
    for i in range(many):
        w = rng.choices(words, weights=range(1, len(words) + 1), k=rng.choice([0, 3, 40, 120]))
        marks = [rng.choice(["", "", "", ",", ". ", "\n", "\t", ";;"]) for _ in w]
        rows.append((rng.choice(["en", "de", None]), " ".join(x + m for x, m in zip(w, marks, strict=True)) + (" " + passage.upper() if i % 3 == 0 else "")))
    return rows


ODD = [("en", None), (None, ""), ("und", "joins the null ones"), ("en", " \t \n"), ("en", ".,;"), ("en", "A b " * 2000), ("en", "a b " * 2000), ("fr", "one two three four five six " * 30), ("", "empty lang " * 10)]


@pytest.mark.parametrize(("seed", "how"), [(1, {"min_count": 8}), (2, {"min_count": 3, "max_words": 3, "top": 7}), (3, {"min_count": 5, "max_words": 2}), (4, {"min_count": 2, "max_words": 7, "top": 50})])
def test_against_all_occurrences(spark, seed, how):
    rows = texts(seed) + ODD
    assert found(spark, rows, **how) == brute_force(rows, **how)


def test_a_full_bitmap_and_small_buffers_change_nothing(spark, monkeypatch):
    for name, value in (("FILTER_BITS", 16), ("HELD_CHUNKS", 5), ("HELD_HASHES", 50)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts(5) + ODD
    assert found(spark, rows, min_count=6) == brute_force(rows, min_count=6)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_chunks_own_every_start_once_and_meet_again_after_a_difference():
    rng = random.Random(6)
    shared = [b"w%d" % rng.randrange(50) for _ in range(600)]
    found = []
    for head in ([b"x"] * 3, [b"y"] * 40):
        words, at, out = head + shared, 0, []
        for chunk, own in collocations.chunks(words, 4):
            assert words[at : at + len(chunk)] == chunk and (len(chunk) == own + 4 or at + len(chunk) == len(words))
            at += own
            out.append(tuple(chunk))
        assert at == len(words)
        found.append(out)
    same = set(found[0]) & set(found[1])
    assert len(same) >= min(map(len, found)) - 3  # the parse falls into step after the first window in both


def test_scores_past_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10**11), ("en", "b", 1, 7 * 10**11), ("en", "a b", 2, 2 * 10**11)], "lang string, phrase string, size int, f long")
    words = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n long")
    [row] = collocations.scored(counts, words).collect()
    assert row["score"] == 1000 * 2 * 10**11 * 9 * 10**14 // (3 * 10**11 * 7 * 10**11)
