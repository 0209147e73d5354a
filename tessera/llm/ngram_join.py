"""N-gram Jaccard self-join with adaptive multi-match prefixes, exact.

Two texts link when 100 * (shared shingles) >= percent * (shingles of both). A set of n shingles that links with another
shares t = ceil(percent * n / 100) of them at least. So in any order common to all sets, the first n - t + m of each
share m: longer prefixes, but more matches before two sets are compared. Each set takes its own m.

1. Every document becomes its set and a prefix long enough for the largest m. Shingles of many documents come last in
   it: mergeable counters over all documents (Misra-Gries, fixed size) name them. The order decides what is cheap, never
   what links. Equal sets are one from here on.
2. Prefix shingles of a single set go, the others are counted. For each m the lengths of the lists that the prefix
   would read bound its candidates (at most their sum / m share m entries); the set takes the m of the least cost.
   Masks over buckets of partners count matches without listing pairs: what can't have enough with any set goes.
3. Lists of up to SHORT sets give their pairs (less than SHORT an entry), which are counted; a pair needs the smaller m of
   the two in common, of which longer lists may give as many as both have in such. Pairs that meet in longer lists alone
   are never listed: their sets meet at each such shingle, and a pair is looked at only at the least one that it shares,
   so once, where it needs its m. Bit signatures bound its overlap from above: a bit that only one of the two has is a
   shingle that the other lacks. What is left are members of that shingle's group.
4. Groups get their members' whole sets and compare them by products of incidence matrices; what already hangs together
   is skipped. Links come out as a forest per group, so no pairs of a family are listed.
5. Links are contracted to the smallest doc_id that is reachable.

Sets too small to link with another one (at 90 %, of fewer than nine shingles) take no part. A shingle with more than
CROWD sets (large ones weigh more) is dealt in parts, each pair of parts one group: a family of N sets moves N * N / CROWD
rows at most; its comparisons grow with its square where its texts are near the threshold, yet don't hang together. Sets
are told apart by 64-bit hashes of their shingles.

Null, empty and blank texts have the empty set, n_shingles 0 and link with nothing. Fewer words than a shingle: the
whole sequence is the one shingle. Repeated rows stay, one row each. A null doc_id stays null in the result and names no
component unless all of it are null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, repeated, replaced, small
from .simhash import SEED, components, key_of, overlaps, run_sizes, set_of, sets_of, whole_runs

#: Matches that a prefix asks for at least: FEWEST and one more for each SHARE shingles, or half as many more, or twice as many.
FEWEST, SHARE = 3, 32
#: Bits of a posting's mask.
BUCKETS, FULL, FAR = 64, (1 << 64) - 1, 1 << 62
#: Counters of frequent shingles, in each task and in all.
COUNTERS = 1 << 16
#: What comparing two sets costs, as a share of their shingles, beside reading one entry of a list.
COMPARE = 1 / 64
#: Lists of up to so many sets give pairs.
SHORT = 16
#: Weight of a group's members in a task (one of up to a thousand shingles weighs 1 to 2), and sets in a block.
CROWD, BLOCK, SMALL = 8192, 512, 16


def least_shared(n, percent: int):
    """How many shingles a set of n shares with any set that it links with."""
    return -(-percent * n // 100)


def fewest(n, percent: int):
    """The matches that a set of n asks for at least; larger sets ask for as many or more."""
    return np.minimum(FEWEST + n // SHARE, least_shared(n, percent))


def longest_prefix(n: int, percent: int) -> int:
    """Entries of the prefix that asks for the most matches."""
    t = least_shared(n, percent)
    return n - t + min(2 * (FEWEST + n // SHARE), t)


def linked(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def counted(token: np.ndarray, count: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of equal tokens added up; of more than ``keep`` distinct ones all lose what the next largest has."""
    value, at = np.unique(token, return_inverse=True)
    total = np.bincount(at, weights=count, minlength=len(value)).astype(np.int64)
    if len(value) > keep:
        total -= np.partition(total, -keep - 1)[-keep - 1]
        value, total = value[total > 0], total[total > 0]
    return value, total


def frequent(docs: DataFrame, words: int, keep: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many documents, sorted, and the rank of each by its count. Counts cover all documents."""

    def run(batches):
        token, count, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for b in small(batches):
            for t in b.column(0).to_pylist():
                held.append(set_of(t, words))
                size += len(held[-1])
                if size >= 1 << 21:
                    new = np.concatenate(held)
                    token, count = counted(np.concatenate([token, new]), np.concatenate([count, np.ones(len(new), np.int64)]), keep)
                    held, size = [], 0
        new = np.concatenate([*held, np.zeros(0, np.uint64)])
        token, count = counted(np.concatenate([token, new]), np.concatenate([count, np.ones(len(new), np.int64)]), keep)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "n"])
        give_back()

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "token long, n long")
    found = found.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    rows = found.orderBy(F.desc("n"), "token").limit(keep).collect()  # COUNTERS rows at most
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(rows) - np.arange(len(rows)))[order]


def signature(hashes: np.ndarray) -> bytes:
    """A bit for each hash, in a power of two of bits, four times as many as hashes at least."""
    bits = np.zeros(max(64, 1 << (4 * max(len(hashes), 1) - 1).bit_length()), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(signatures: list[bytes], size: int) -> np.ndarray:
    """The signatures as rows of ``size`` bytes; longer ones have their halves laid over each other."""
    out = np.zeros((len(signatures), size // 8), np.uint64)
    for i, s in enumerate(signatures):
        out[i] = np.bitwise_or.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row per document: doc_id, d and th (which text it is), sid (a hash of the set), n and prefix."""
    often, rank = frequent(docs, words)

    def run(batches):
        for b in small(batches):
            texts = b.column(2).to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], "<u8").view(np.int64)
            sets = [set_of(t, words) for t in texts]
            sids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], "<u8").view(np.int64)
            prefixes = []
            for h in sets:
                at = np.minimum(np.searchsorted(often, h), len(often) - 1) if len(often) else np.zeros(len(h), np.int64)
                common = often[at] == h if len(often) else np.zeros(len(h), bool)
                last = h[common][np.argsort(rank[at[common]])] if common.any() else h[:0]
                prefixes.append(np.concatenate([h[~common], last]).view(np.int64)[: longest_prefix(len(h), percent)])
            columns = [b.column(0), b.column(1), pa.array(hashes), pa.array(sids), pa.array([len(h) for h in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "d", "th", "sid", "n", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(docs).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, d long, th long, sid long, n long, prefix array<long>")


def smallest_joined(percent: int) -> int:
    """The least n of a set that can link with another one than itself: with one of n + 1."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else FAR


def postings(unique: DataFrame, percent: int) -> DataFrame:
    """token, df, sid, n, level: a row for each prefix shingle of each set that other sets have as well.

    ``level``: how many of its prefix's shingles a set asks another one to share.
    """
    entries = unique.filter(F.col("n") >= smallest_joined(percent)).select(F.posexplode("prefix").alias("pos", "token"), "sid", "n").select("token", "sid", "pos", "n")
    shared = cut(entries.repartition("token").sortWithinPartitions("token").mapInArrow(repeated, "token long, sid long, pos int, n long"), "shared")
    rows = shared.join(shared.groupBy("token").agg(F.count("*").alias("df")), "token")
    t = F.ceil(F.lit(percent) * F.col("n") / 100)
    least = FEWEST + F.floor(F.col("n") / SHARE)
    matches = [F.least(t, m) for m in (least, least + F.floor(least / 2), 2 * least)]
    before = F.col("n") - t  # a prefix that asks for m matches has so many entries and m more
    read = [F.sum(F.when(F.col("pos") < before + m, F.col("df") - 1).otherwise(0)).alias(f"read{k}") for k, m in enumerate(matches)]
    per_set = rows.groupBy("sid", "n").agg(*read, F.collect_list(F.struct("pos", "token", "df")).alias("entries"))
    cost = F.array(*(F.col(f"read{k}") * (1 + F.col("n") * COMPARE / m) for k, m in enumerate(matches)))
    level = F.get(F.array(*matches), (F.array_position(cost, F.array_min(cost)) - 1).cast("int")).cast("int")
    chosen = per_set.withColumn("level", level)
    chosen = chosen.select("sid", "n", "level", F.explode(F.filter("entries", lambda e: e["pos"] < before + F.col("level"))).alias("e"))
    return replaced(chosen.select("e.token", "e.df", "sid", "n", "level"), "postings", shared)


def several(rows: DataFrame, percent: int) -> DataFrame:
    """The postings of sets that may share enough of them with one other set of a size that fits: token, sid, n, level.

    Each posting of a list of up to BUCKETS sets gets a mask: the buckets of the sets beside it whose sizes fit. (Longer
    lists fill the mask.) A set that shares m shingles with another one has m masks with that one's bucket: buckets that
    fewer masks hold than any pair needs are struck out, and postings without a bucket left go. No pairs are listed.
    """

    def masks(batches):
        for g in whole_runs(batches):
            token, sid, n = (np.asarray(g.column(k)) for k in (0, 2, 3))
            mask = np.where(np.asarray(g.column(1)) > BUCKETS, np.uint64(FULL), np.uint64(0))
            bit = np.uint64(1) << (_spread(sid.view(np.uint64)) & np.uint64(BUCKETS - 1))
            for lag in range(1, BUCKETS):
                near = (token[lag:] == token[:-lag]) & (mask[lag:] != FULL)
                if not near.any():
                    break
                near &= linked(np.minimum(n[lag:], n[:-lag]), n[lag:], n[:-lag], percent)
                mask[lag:][near] |= bit[:-lag][near]
                mask[:-lag][near] |= bit[lag:][near]
            some = pa.array(mask > 0)
            out = g.filter(some).append_column("mask", pa.array(mask.view(np.int64)).filter(some))
            yield from out.select(["sid", "token", "n", "level", "mask"]).to_batches()
        give_back()

    def struck(batches):
        for g in whole_runs(batches):
            sid, mask = np.asarray(g.column(0)), np.asarray(g.column(4)).view(np.uint64)
            starts = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
            size = np.diff(np.append(starts, len(sid)))
            need, good = fewest(least_shared(np.asarray(g.column(2))[starts], percent), percent), np.zeros(len(starts), np.uint64)
            for k in range(BUCKETS):
                held = np.add.reduceat((mask >> np.uint64(k) & np.uint64(1)).astype(np.int64), starts)
                good |= (held >= need).astype(np.uint64) << np.uint64(k)
            keep = (mask & np.repeat(good, size)) > 0
            yield from g.select(["token", "sid", "n", "level"]).filter(pa.array(keep)).to_batches()
        give_back()

    short, long = rows.filter(F.col("df") <= BUCKETS), rows.filter(F.col("df") > BUCKETS)
    kind = "sid long, token long, n long, level int, mask long"
    masked = short.select("token", "df", "sid", "n", "level").repartition("token").sortWithinPartitions("token").mapInArrow(masks, kind)
    masked = masked.union(long.select("sid", "token", "n", "level", F.lit(-1).cast("long").alias("mask")))
    return masked.repartition("sid").sortWithinPartitions("sid").mapInArrow(struck, "token long, sid long, n long, level int")


def _spread(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)


def lists(rows: DataFrame, percent: int) -> DataFrame:
    """The postings by their lists. Of up to SHORT sets: a row per pair (sid, other) whose sizes fit; ``level``: the smaller
    one. Of more: the posting itself, other null. A posting gives less than SHORT pairs."""

    def run(batches):
        for g in whole_runs(batches):
            token, sid, n, level = (np.asarray(g.column(k)) for k in range(4))
            size = run_sizes(token)
            short, a, b, least = size <= SHORT, [], [], []
            for lag in range(1, SHORT):
                near = (token[lag:] == token[:-lag]) & short[lag:]
                if not near.any():
                    break
                near &= linked(np.minimum(n[lag:], n[:-lag]), n[lag:], n[:-lag], percent)
                x, y = sid[:-lag][near], sid[lag:][near]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                least.append(np.minimum(level[:-lag][near], level[lag:][near]))
            pairs, long = sum(map(len, a)), pa.array(~short)
            none = lambda kind: pa.nulls(pairs, kind)
            columns = [np.concatenate([*x, np.zeros(0, x[0].dtype if x else np.int64)]) for x in (a, b, least)]
            out = pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(columns[0]), none(pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[1])], names=names)
            yield out
            rest = g.filter(long)
            yield from rest.append_column("other", pa.nulls(rest.num_rows, pa.int64())).to_batches()
        give_back()

    names = ["token", "sid", "n", "level", "other"]
    return rows.select(*names[:-1]).repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, sid long, n long, level int, other long")


def enough(met: DataFrame) -> DataFrame:
    """sid, other: pairs that short lists give often enough, with what long ones may add. ``met``: as from ``lists``."""
    long = met.filter("other is null").groupBy("sid").agg(F.count("*").alias("long"))
    pairs = met.filter("other is not null").groupBy("sid", "other").agg(F.count("*").alias("shared"), F.first("level").alias("level"))
    pairs = pairs.join(long, "sid", "left").join(long.select(F.col("sid").alias("other"), F.col("long").alias("long_too")), "other", "left")
    return pairs.filter(F.col("shared") + F.least(F.coalesce("long", F.lit(0)), F.coalesce("long_too", F.lit(0))) >= F.col("level")).select("sid", "other")


def as_groups(pairs: DataFrame) -> DataFrame:
    """key, low, high, sid: each pair as a group of its own."""
    key = F.xxhash64("sid", "other")
    return pairs.select(F.inline(F.array(*(F.struct(key.alias("key"), F.lit(one).alias("low"), F.lit(not one).alias("high"), F.col(c).alias("sid")) for c, one in (("sid", True), ("other", False))))))


def met(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The postings with all of their set's shingles in postings (tokens), the set's signature, and the list's weight (load)."""

    def signed(batches):
        for b in small(batches):
            signatures = [signature(np.frombuffer(x, "<u8")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signatures, pa.binary())], names=["sid", "signature"])

    rows = rows.join(rows.groupBy("token").agg(F.sum(1 + F.col("n") / 1024).alias("load")), "token")
    facts = rows.groupBy("sid").agg(F.collect_list("token").alias("tokens"))
    return rows.join(facts.join(sets.mapInArrow(signed, "sid long, signature binary"), "sid"), "sid")


def dealt(rows: DataFrame) -> DataFrame:
    """key, low, high beside the rows' columns: a group per token, or per pair of parts where a token has many sets."""
    parts = F.ceil(F.col("load") / CROWD)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), parts))
    rows = rows.withColumn("other", F.explode(F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    key = F.when(parts == 1, F.col("token")).otherwise(F.xxhash64("token", low, high))
    return rows.withColumns({"key": key, "low": F.col("own") == low, "high": F.col("own") == high}).drop("own", "other", "load")


def matched(token, n, level, tokens, signatures, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows i and j (each sorted by n) the pairs that may link: sizes, matches, least shared token, signatures."""
    a, b = n[i][:, None], n[j][None, :]
    some = linked(np.minimum(a, b), a, b, percent)
    if not some.any():
        return i[:0], j[:0]
    left, right = [tokens[k] for k in i], [tokens[k] for k in j]
    some &= overlaps([x[x < token] for x in left], [x[x < token] for x in right]) == 0
    some &= overlaps(left, right) >= np.minimum(level[i][:, None], level[j])
    x, y = np.nonzero(some)
    if not len(x):
        return i[:0], j[:0]
    (rows, x), (columns, y), keep = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True), []
    i, j = i[rows], j[columns]
    size = min(len(signatures[k]) for k in (*i.tolist(), *j.tolist()))
    p, q = (folded([signatures[k] for k in at], size) for at in (i, j))
    for at in range(0, len(x), 1 << 14):
        u, v = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
        bound = np.minimum(n[i[u]] - np.bitwise_count(p[u] & ~q[v]).sum(1, dtype=np.int64), n[j[v]] - np.bitwise_count(q[v] & ~p[u]).sum(1, dtype=np.int64))
        keep.append(linked(bound, n[i[u]], n[j[v]], percent))
    ok = np.concatenate(keep)
    return i[x[ok]], j[y[ok]]


def few(token, n, level, tokens, signatures, pairs, percent: int) -> set[int]:
    """As ``matched``, for a handful of rows: those with a pair that may link."""
    sets, out = {}, set()
    for i, j in pairs:
        if not linked(min(n[i], n[j]), n[i], n[j], percent):
            continue
        both = sets.setdefault(i, frozenset(tokens[i].tolist())) & sets.setdefault(j, frozenset(tokens[j].tolist()))
        if len(both) < min(level[i], level[j]) or min(both) != token:
            continue
        p, q = folded([signatures[i], signatures[j]], min(len(signatures[i]), len(signatures[j])))
        bound = min(n[i] - int(np.bitwise_count(p & ~q).sum()), n[j] - int(np.bitwise_count(q & ~p).sum()))
        if linked(bound, n[i], n[j], percent):
            out |= {i, j}
    return out


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """key, low, high, sid: members of groups that may link with another member of theirs.

    ``rows``: key, low, high, token, n, level, tokens, signature, sid; a pair is a low and a high row of one key.
    """

    def run(batches):
        for g in whole_runs(batches):
            key, token, n, level = (np.asarray(g.column(k)) for k in (0, 3, 4, 5))
            low, high = (g.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            lists, signatures = g.column(6).combine_chunks(), g.column(7).to_pylist()
            ends = np.asarray(lists.offsets)
            values = np.asarray(lists.values)
            tokens = [values[p:q].view(np.uint64) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            keep = np.zeros(len(key), bool)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                at = np.uint64(int(token[s]) % (1 << 64))
                if e - s <= SMALL:
                    pairs = [(i, j) for i in range(s, e) for j in range(s, e) if low[i] and high[j] and (i < j or not (low[j] and high[i]))]
                    keep[list(few(int(at), n, level, tokens, signatures, pairs, percent))] = True
                    continue
                order = s + np.argsort(n[s:e], kind="stable")
                left, right = order[low[order]], order[high[order]]
                same = bool((low[s:e] & high[s:e]).all())
                for p in range(0, len(left), BLOCK):
                    for q in range(p if same else 0, len(right), BLOCK):
                        i, j = matched(at, n, level, tokens, signatures, left[p : p + BLOCK], right[q : q + BLOCK], percent)
                        own = i != j
                        keep[i[own]] = keep[j[own]] = True
            out = g.select([0, 1, 2, 8]).filter(pa.array(keep))
            yield from out.to_batches()
        give_back()

    order = ("key", "low", "high", "token", "n", "level", "tokens", "signature", "sid")
    return rows.select(*order).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, low boolean, high boolean, sid long")


class Forest:
    """Which of the members of a group hang together."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.top.get(x, x)) != x:
            self.top[x] = x = self.top.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart so far."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.top[max(a, b)] = min(a, b)
        return a != b


def verified(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst: links that connect what links within the groups, by the members' whole sets."""

    def blocks(rows: np.ndarray, found: list[np.ndarray]):
        out, weight = [], 0
        for r in rows.tolist():
            if out and (len(out) == BLOCK or weight + len(found[r]) > 1 << 20):
                yield np.array(out)
                out, weight = [], 0
            out.append(r)
            weight += len(found[r])
        if out:
            yield np.array(out)

    def of(low: np.ndarray, high: np.ndarray, sid: np.ndarray, found: list[np.ndarray]):
        forest, n = Forest(), np.array([len(x) for x in found])
        left, right = np.flatnonzero(low), np.flatnonzero(high)
        for i in blocks(left, found):
            for j in blocks(right, found):
                if len({forest.root(int(x)) for x in (*sid[i], *sid[j])}) == 1:
                    continue
                if len(i) * len(j) <= SMALL * SMALL:
                    x, y = np.nonzero(linked(np.minimum(n[i][:, None], n[j]), n[i][:, None], n[j], percent) & (i[:, None] != j))
                    for a, b in zip(i[x].tolist(), j[y].tolist(), strict=True):
                        if forest.root(int(sid[a])) != forest.root(int(sid[b])) and linked(len(np.intersect1d(found[a], found[b], assume_unique=True)), n[a], n[b], percent):
                            forest.join(int(sid[a]), int(sid[b]))
                            yield int(sid[a]), int(sid[b])
                    continue
                shared = overlaps([found[k] for k in i], [found[k] for k in j])
                x, y = np.nonzero(linked(shared, n[i][:, None], n[j], percent))
                for a, b in zip(sid[i[x]].tolist(), sid[j[y]].tolist(), strict=True):
                    if forest.join(a, b):
                        yield a, b

    def run(batches):
        for g in whole_runs(batches):
            key, sid = np.asarray(g.column(0)), np.asarray(g.column(3))
            low, high = (g.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            links: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                found = [np.frombuffer(x, "<u8") for x in g.column(4).slice(s, e - s).to_pylist()]
                links += of(low[s:e], high[s:e], sid[s:e], found)
            both = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])
        give_back()

    rows = groups.join(sets, "sid").select("key", "low", "high", "sid", "hashes")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long").distinct()


def jaccard_classes(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every document."""
    sketched = cut(sketches(docs, words, percent), "sketches")
    facts = [F.first(c).alias(c) for c in ("n", "prefix")]
    unique = sketched.filter("n > 0").groupBy("sid").agg(F.min(F.struct("d", "th")).alias("at"), F.min("doc_id").alias("label"), *facts)
    unique = cut(unique, "unique")
    rows = replaced(sketched.select("doc_id", "sid", "n"), "rows", sketched)
    listed = postings(unique, percent)
    unique = replaced(unique.select("sid", "at", "label"), "names", unique)
    by_list = replaced(lists(several(listed, percent), percent), "lists", listed)
    pairs, rest = cut(enough(by_list), "pairs"), by_list.filter("other is null").drop("other")
    need = pairs.select("sid").union(pairs.select("other")).union(rest.select("sid")).distinct().join(unique.select("sid", "at.d", "at.th"), "sid")
    sets = cut(sets_of(docs, need, words), "sets")
    groups = cut(candidates(dealt(met(rest, sets)), percent), "groups").union(as_groups(pairs))
    links = cut(verified(groups, sets, percent), "links")
    found = components(unique.select(F.col("sid").alias("node"), "label"), links)
    named = unique.select("sid", "label").join(found.select(F.col("node").alias("sid"), F.col("label").alias("linked"), F.lit(True).alias("has_links")), "sid", "left")
    named = cut(named.select("sid", F.when(F.col("has_links"), F.col("linked")).otherwise(F.col("label")).alias("label")), "named")
    out = rows.select("doc_id", "sid", F.col("n").alias("n_shingles")).join(named, "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))


#: The same rows: pairs through shared shingles, then everything reachable over links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i : i + 2], ' ') FOR i IN range(1, len(words) - 1)]) END AS shingles FROM w),
c AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
p AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM p a JOIN p b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared s JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * s.n >= 90 * (a.n + b.n - s.n)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ends UNION SELECT r.x, b.y FROM reach r JOIN ends b ON r.y = b.x)
SELECT c.doc_id, c.n AS n_shingles, least(c.doc_id, coalesce(min(r.y), c.doc_id)) AS component_id
FROM c LEFT JOIN reach r ON r.x = c.doc_id GROUP BY c.doc_id, c.n
"""
