"""The n-gram Jaccard join against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join


def word_sets(text, words=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_force(rows, percent=90, words=3):
    """(doc_id, n, component) by comparing all pairs."""
    sets = [word_sets(t, words) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        known = low.get(root(i))
        low[root(i)] = known if d is None else d if known is None else min(d, known)
    return sorted(((d, len(s), low[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, token string, n string")
    return sorted((tuple(r) for r in ngram_join.jaccard_classes(docs, **how).collect()), key=str)


def families(seed, many=60):
    """Texts with a few words changed, so that similarities lie around the threshold, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    out = []
    for _ in range(5):
        base = rng.choices(vocabulary, k=rng.choice([30, 90, 240]))
        for _ in range(many // 5):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w + (passage if rng.random() < 0.3 else [])))
    return [(i + 1, t) for i, t in enumerate(out)]


ODD = [(None, "null id text here"), (7000, "null id text here"), (7001, None), (7002, ""), (7003, " \n\t"), (7004, "One"), (7005, "one"), (7006, "one two"), (7007, "ONE  two"), (7007, "one two"), (7008, "a " * 3000), (7009, "A " * 4000)]


def test_families_and_odd_rows(spark):
    rows = families(1) + ODD
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_hot_shingles_dealt_in_parts_and_blocks(spark, seed, monkeypatch):
    """Small parts and blocks, so that every way of dealing is taken: the links must not change."""
    for name, value in (("CROWD", 9), ("BLOCK", 4), ("SMALL", 3), ("COUNTERS", 20), ("SHORT", 2), ("BUCKETS", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = families(seed, 90)
    assert found(spark, rows) == brute_force(rows)


def test_other_thresholds(spark):
    rows = families(4)
    assert found(spark, rows, words=2, percent=75) == brute_force(rows, 75, 2)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_levels_ask_for_more_matches_where_lists_are_long(spark):
    """Each of two sets shares the matches that both levels ask for; some sets take more than one."""
    docs = spark.createDataFrame(families(5, 200), "doc_id long, text string")
    rows = ngram_join.sketches(docs, 3, 90)
    got = ngram_join.postings(rows.dropDuplicates(["sid"]), 90)
    kept = ngram_join.several(got, 90).groupBy("sid").agg(F.collect_set("token").alias("tokens"))
    kept = {r["sid"]: set(r["tokens"]) for r in kept.collect()}
    got = got.groupBy("sid", "n", "level").agg(F.collect_set("token").alias("tokens")).collect()
    assert all(r["level"] >= ngram_join.fewest(r["n"], 90) for r in got) and any(r["level"] > ngram_join.fewest(r["n"], 90) for r in got)
    exact = {r["sid"]: None for r in got}
    for r in rows.join(docs, "doc_id").select("sid", "text").collect():
        exact[r["sid"]] = word_sets(r["text"])
    for a in got:
        for b in got:
            x, y = exact[a["sid"]], exact[b["sid"]]
            if a["sid"] < b["sid"] and 100 * len(x & y) >= 90 * len(x | y):
                shared = set(a["tokens"]) & set(b["tokens"])
                assert len(shared) >= min(a["level"], b["level"])
                assert shared <= kept[a["sid"]] and shared <= kept[b["sid"]]


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 200), dtype=np.uint64)])) for _ in range(2))
        p, q = (ngram_join.signature(v) for v in (x, y))
        p, q = ngram_join.folded([p, q], min(len(p), len(q)))
        assert len(np.intersect1d(x, y)) <= min(len(x) - np.bitwise_count(p & ~q).sum(), len(y) - np.bitwise_count(q & ~p).sum())


def test_counters_keep_what_is_frequent(spark):
    """Whatever has over a share of 1 / (counters + 1) of all shingles keeps a counter."""
    docs = spark.createDataFrame([(i, f"same three words and then number{i} alone{i} stays") for i in range(300)], "doc_id long, text string")
    token, _ = ngram_join.frequent(docs, 3, 20)
    assert set(ngram_join.set_of("same three words and then", 3).tolist()) <= set(token.tolist()) and len(token) <= 20
