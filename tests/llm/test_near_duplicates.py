"""The near-duplicate stage against exact Jaccard similarity."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import simhash


def exact_links(rows, similarity=0.8, words=5):
    """Links (a, b) by the sets themselves; pairs come from an inverted index over exact document counts."""
    sets = {d: set(simhash.shingle_hashes(t or "", words).tolist()) for d, t in rows}
    seen = Counter(h for s in sets.values() for h in s)
    by, out = defaultdict(list), {}
    for d, s in sets.items():
        rarest = sorted(s, key=lambda h: (seen[h], h))[: len(s) - simhash.least_overlap(len(s), similarity) + 1]
        for h in rarest:
            by[h].append(d)
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in out and min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                    out[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return {p: j for p, j in out.items() if j >= similarity}


def roots(links, names):
    top = {n: n for n in names}

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in links:
        top[root(a)] = root(b)
    return {n: root(n) for n in names}


def groups_of(by_name):
    out = defaultdict(set)
    for name, root in by_name.items():
        out[root].add(name)
    return {frozenset(g) for g in out.values()}


def test_recall_in_each_band_of_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("text is not null").dropDuplicates(["text"])
    rows = [tuple(r) for r in docs.collect()]
    links = exact_links(rows)
    found = {r["d"]: r["root"] for r in simhash.similar(docs).collect()}
    assert len(links) > 40
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [p for p, j in links.items() if low <= j < high]
        assert band and sum(found[a] == found[b] for a, b in band) == len(band)
    assert groups_of(found) == groups_of(roots(links, found))


@pytest.mark.parametrize("block,crowd", [(512, 8192), (16, 32)])
def test_families_in_one_or_many_blocks(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(200):  # copies of one text with one to eight words changed: pairs have similarities from 0.4 on
        own = list(base)
        for at in rng.sample(range(150), 1 + i % 8):
            own[at] = word()
        rows.append((i, " ".join(own)))
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:5])] + [(300, None), (301, ""), (302, " \n")]
    expected = groups_of(roots(exact_links(rows), [d for d, _ in rows]) | dict.fromkeys((300, 301, 302), -1))
    assert 3 < len(expected) < 190
    assert groups_of({r["d"]: r["root"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == expected


def test_overlaps_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    got = simhash.overlaps(sets[:4], sets[4:], columns=16)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[4:]] for x in sets[:4]]
    n = np.array([10, 10, 10, 100])
    bins = np.ones((4, simhash.BINS), np.uint8)
    bins[2] = 2
    assert simhash.forest(n, bins, 0.8) == [(0, 1)]  # the third has other minima, the fourth another size
    assert not simhash.minima(np.zeros(0, np.uint64)).any()
    assert np.count_nonzero(simhash.minima(np.array([1, 2, 1 << 60], np.uint64))) == 2


def test_without_slack_no_minima_decide(spark):
    """Texts near the threshold, none ruled out by minima: the groups are those of the exact similarity."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = [d for d, _ in rows]
    found = {r["d"]: r["root"] for r in simhash.similar(docs, slack=1.0).collect()}
    assert groups_of(found) == groups_of(roots(exact_links(rows), names))
