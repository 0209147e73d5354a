"""The conversation prefix trie against brute force over every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import prefix_trie


def brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def visit(p):
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        if p:
            saved = (len(members[p]) - 1) * len(p[-1][1].encode())
        for k in kids[p]:
            x, y = visit(k)
            leaves, saved = leaves + x, saved + y
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, path string, depth string")
    got = prefix_trie.trie(prefix_trie.rebuilt(table), **how)
    assert got.columns == list(COLUMNS)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2])


def conversations(seed, many=120):
    """Few different turns, so that prefixes are shared; hot first turns, equal conversations, a long one."""
    rng, rows = random.Random(seed), []
    for c in range(many):
        n = 40 if c == 7 else rng.choice([0, 1, 2, 4, 9, 11])
        same = c % 3 == 0
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]) if not same else "user", f"té{0 if same else rng.randrange(2)}" * (1 + t % 3)))
    return rows


ODD = [(None, 0, "user", "of no conversation"), (900, None, "user", "null turn first"), (900, 0, None, None), (900, 0, "user", "tie"), (900, 0, "assistant", "tie"), (901, 0, "", ""), (901, 0, "", ""), (902, 1, "a", "bc"), (903, 1, "ab", "c"), (-7, 0, "user", "negative"), (-7, 1, "user", "x" * 50_000)]


def test_one_shard(spark):
    rows = conversations(1) + ODD
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("shard", [1, 30, 200])
def test_spines_of_many_shards_merge(spark, shard):
    rows = conversations(2) + ODD
    assert found(spark, rows, shard=shard) == brute_force(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_find_close_and_leaves_on_random_trees():
    rng = random.Random(3)
    for n in (1, 2, 31, 33, 400, 3000):
        for deep in (0.5, 0.95):
            sequence, open_now, left = [1], 1, n - 1
            while open_now:
                if left and (open_now == 1 or rng.random() < deep):
                    sequence.append(1)
                    open_now, left = open_now + 1, left - 1
                else:
                    sequence.append(-1)
                    open_now -= 1
            tree = prefix_trie.Parentheses(np.array(sequence, np.int8))
            stack, close, leaves = [], {}, {}
            for i, x in enumerate(sequence):
                if x > 0:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            for i, j in close.items():
                leaves[i] = sum(sequence[k] > 0 > sequence[k + 1] for k in range(i, j))
            assert tree.close.tolist() == [close[i] for i in tree.opens.tolist()]
            assert tree.leaf_pairs(tree.opens, tree.close).tolist() == [leaves[i] for i in tree.opens.tolist()]


def test_range_min():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1000, 300)
    first = rng.integers(0, 300, 500)
    size = rng.integers(1, 301 - first)
    assert prefix_trie.range_min(values, first, size).tolist() == [values[i : i + n].min() for i, n in zip(first, size, strict=True)]
