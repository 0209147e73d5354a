"""SimHash near-duplicates by anchor-point covering.

Fingerprints (64 bits) link when at most ``distance`` bits differ. Anchors are the words of a covering code: nine
Hamming (7,4) blocks and one free bit, of covering radius 9, 2^37 anchors. Two fingerprints that differ in at most two
bits have a point within one bit of both; the anchor that covers that point lies within radius + 1 of both. So each
fingerprint is replicated to every anchor that covers a point within one bit of it (about 25) and compared there with
the others. An anchor with over GROUP fingerprints compares them through those points instead: a point has at most 65
fingerprints within one bit, all of which link. Links are given as stars, so nothing grows with the square of a group,
and no group is capped.

Linked fingerprints then get the smallest doc_id that is reachable, by rounds of min-label hooking with contraction.
Only distinct fingerprints take part, so any number of copies costs one row per copy.

Null, empty and blank texts have fingerprint zero and link like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Repeated rows stay. A null doc_id stays a row, but names no component unless all are null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, give_back, remove, repeated, replaced, small, with_text

SEED = 42
#: Ranges of hashes of which sets keep the least, and by how much the similarity that those minima show may fall short:
#: six standard deviations, sqrt(0.8 * 0.2 / 256) each.
BINS, SLACK = 256, 0.15
#: Sets of one shingle compared in a task (more are dealt in pairs of parts), and sets and shingles of a block.
CROWD, BLOCK, BLOCK_SHINGLES = 8192, 512, 1 << 20
#: Documents sampled for frequent shingles, in how many of them those are, and how many shingles are kept at most.
SAMPLE, OFTEN, MOST_FREQUENT = 5000, 5, 1 << 16
#: Keys over which the pairs of one text are dealt.
SALTS = 64
#: Anchors with up to so many fingerprints compare them directly.
GROUP = 32


def key_of(docs: DataFrame) -> Column:
    """doc_id as a long, null as the least."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)).cast("long"))


def run_sizes(key: np.ndarray) -> np.ndarray:
    """For each row of sorted keys, how many rows have its key."""
    run = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    return np.bincount(run)[run]


def whole_runs(batches):
    """Arrow tables cut so that no run of equal values in the first column (they are sorted) is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first = np.asarray(b.column(0))
        last = int(np.searchsorted(first, first[-1], "left"))
        if last or held and np.asarray(held[-1].column(0))[-1] != first[0]:  # what came before the last run is whole
            if held or last:
                yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of the whole sequence where there are fewer words."""
    w = text.encode().lower().split()  # of bytes: A-Z only, and exactly the bytes 0x20 and 0x09 to 0x0D
    if not w:
        return np.zeros(0, "<u8")
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit k is set where it is set in more than half of the hashes. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and the fingerprint as a signed long. Row-wise."""

    def run(batches):
        for b in small(batches):
            texts = b.column(1).to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes), pa.array([fingerprint(t, words) for t in texts], pa.int64())], names=["doc_id", "th", "fp"])

    return with_text(docs).mapInArrow(run, "doc_id long, th long, fp long")


def _decoder() -> np.ndarray:
    """Number (0 to 15) of the Hamming (7,4) word within one bit of each 7-bit value."""
    value = np.arange(128)
    syndrome = np.zeros(128, np.int64)
    for b in range(7):
        syndrome ^= (value >> b & 1) * (b + 1)
    word = np.where(syndrome > 0, value ^ (1 << np.maximum(syndrome - 1, 0)), value)
    return np.searchsorted(np.unique(word), word)


NEAREST = _decoder()
#: The words next to a value's own: those that cover it once one of its bits is flipped (its own word where none).
BESIDE = np.array([(sorted({int(NEAREST[v ^ 1 << b]) for b in range(7)} - {int(NEAREST[v])}) + [int(NEAREST[v])] * 3)[:3] for v in range(128)])


def anchor(points: np.ndarray, bits: int = 64) -> np.ndarray:
    """The anchor that covers each point: the block's words, then the bits that no block holds as they are."""
    points, blocks = points.view(np.uint64), bits // 7
    out = (points >> np.uint64(7 * blocks)).astype(np.int64) << 4 * blocks
    for k in range(blocks):
        out |= NEAREST[(points >> np.uint64(7 * k) & np.uint64(127)).astype(np.int64)] << 4 * k
    return out


def anchors(fps: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors that cover a point within one bit of each fingerprint, each once."""
    own, rows, blocks = anchor(fps, bits), np.arange(len(fps)), bits // 7
    out_rows, out = [rows], [own]
    for free in range(bits - 7 * blocks):
        out_rows.append(rows)
        out.append(own ^ (1 << 4 * blocks + free))
    for k in range(blocks):
        value = (fps.view(np.uint64) >> np.uint64(7 * k) & np.uint64(127)).astype(np.int64)
        for j in range(3):
            other, mine = BESIDE[value, j], NEAREST[value]
            some = other != mine
            out_rows.append(rows[some])
            out.append((own ^ (other ^ mine) << 4 * k)[some])
    return np.concatenate(out_rows), np.concatenate(out)


def links(fps: DataFrame, bits: int = 64) -> DataFrame:
    """src, dst: links (src < dst) that connect exactly the fingerprints at most two bits apart.

    Bits from ``bits`` on are a tag: only fingerprints of one tag link.

    ``fps``: one column fp, distinct, best a written table. Linear in its rows: about 25 replicas each, and up to 65
    points for those that share an anchor with many others.
    """

    flips = np.array([0] + [1 << b for b in range(bits)], np.uint64)

    def replicate(batches):
        for b in batches:
            fp = np.asarray(b.column(0))
            rows, found = anchors(fp, bits)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[rows])], names=["anchor", "fp"])
        give_back()

    def points(batches):
        for b in batches:
            at, fp = np.asarray(b.column(0)), np.asarray(b.column(1))
            for i in range(0, len(fp), 4096):
                near = fp[i : i + 4096].view(np.uint64)[:, None] ^ flips
                own = anchor(near.ravel(), bits).reshape(near.shape) == at[i : i + 4096, None]
                row = np.nonzero(own)[0]
                yield pa.RecordBatch.from_arrays([pa.array(near[own].view(np.int64)), pa.array(fp[i : i + 4096][row])], names=["point", "fp"])

    def compare(batches):
        held_at, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            at = np.concatenate([held_at, np.asarray(b.column(0))])
            fp = np.concatenate([held_fp, np.asarray(b.column(1))])
            done = int(np.searchsorted(at, at[-1], "left")) if len(at) else 0  # the last anchor may go on
            held_at, held_fp = at[done:], fp[done:]
            yield from per_anchor(at[:done], fp[:done])
        yield from per_anchor(held_at, held_fp)
        give_back()

    cover = fps.select("fp").mapInArrow(replicate, "anchor long, fp long")
    found = cover.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "anchor long, src long, dst long")
    found = cut(found, "pairs")
    near = found.filter("dst is null").select("anchor", F.col("src").alias("fp")).mapInArrow(points, "point long, fp long")
    groups = near.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("members")).filter(F.size("members") > 1)
    pairs = groups.select(F.col("members")[0].alias("src"), F.explode(F.expr("slice(members, 2, size(members))")).alias("dst"))
    return found.filter("dst is not null").select("src", "dst").union(pairs).distinct()


def per_anchor(at: np.ndarray, fp: np.ndarray):
    """(anchor, src, dst) of the fingerprints of each anchor (sorted), one link for all but the first of a component.

    Anchors of more than GROUP fingerprints are passed on with dst null, to be compared by points.
    """
    if not len(at):
        return
    new = np.append(True, at[1:] != at[:-1])
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    large, some = size > GROUP, (size > 1) & (size <= GROUP)
    a, f = at[some], fp[some]
    top = np.arange(len(a))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for lag in range(1, GROUP):
        near = a[lag:] == a[:-lag]
        if not near.any():
            break
        near &= np.bitwise_count((f[lag:] ^ f[:-lag]).view(np.uint64)) <= 2
        for i in np.flatnonzero(near).tolist():
            x, y = root(i), root(i + lag)
            top[max(x, y)] = min(x, y)
    lower = np.flatnonzero(top != np.arange(len(a)))
    src = f[[root(int(i)) for i in lower]] if len(lower) else f[:0]
    out = [np.concatenate([at[large], a[lower]]), np.concatenate([fp[large], src]), np.concatenate([fp[large], f[lower]])]
    none = np.concatenate([np.ones(int(large.sum()), bool), np.zeros(len(lower), bool)])
    if len(out[0]):
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], mask=none)], names=["anchor", "src", "dst"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root, label: the smallest label reachable over the edges, for the nodes that have edges.

    ``nodes``: node, label; ``edges``: src, dst. In each round every node hooks onto its least neighbour, pointers jump
    to their trees' roots, and trees contract to one node: links inside a tree go, equal ones merge. So a round's
    links are those between trees that are left, and a large group's links are read once, not in every round.
    """
    live = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    live = cut(live, "links")
    ends = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
    names = cut(nodes.join(ends, "node").select("node", "label"), "nodes")
    state = None
    while live.limit(1).count():
        both = live.select("src", "dst").union(live.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("low"))
        trees = cut(least.select(F.col("src").alias("node"), F.least("src", "low").alias("root"), F.lit(True).alias("moved")), "trees")
        while trees.filter("moved").limit(1).count():
            up = trees.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            jumped = trees.join(up, F.col("root") == F.col("mid")).select("node", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved"))
            trees = replaced(jumped, "trees", trees)
        tops = trees.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if state is None:
            state = cut(names.select("node", F.col("node").alias("root")).join(tops, "root").select("node", F.col("top").alias("root")), "roots")
        else:
            state = replaced(state.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots", state)
        ends = live.join(trees.select(F.col("node").alias("src"), F.col("root").alias("a")), "src")
        ends = ends.join(trees.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst").filter("a <> b")
        live = replaced(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links", live)
        remove(live.sparkSession, trees.written_to)
    if state is None:
        return names.select("node", F.col("node").alias("root"), "label")
    least = state.join(names, "node").groupBy("root").agg(F.min("label").alias("label"))
    return state.join(least, "root").select("node", "root", "label")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, th, fp, root (a fingerprint that stands for the component) and component_id of every document.

    component_id is the smallest doc_id reachable over links of at most two bits.
    """
    rows = cut(fingerprints(docs, words), "fingerprints")
    unique = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("label")), "unique")
    found = components(unique.select(F.col("fp").alias("node"), "label"), links(unique))
    named = found.select(F.col("node").alias("fp"), F.col("root").alias("top"), F.col("label").alias("linked"))
    labels = unique.join(named, "fp", "left").select("fp", F.coalesce("top", "fp").alias("root"), F.when(F.col("top").isNull(), F.col("label")).otherwise(F.col("linked")).alias("component_id"))
    return rows.join(labels, "fp").select("doc_id", "th", "fp", "root", "component_id")


def set_of(text: str, words: int) -> np.ndarray:
    """A text's distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words))


def minima(h: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS equal ranges, as a byte (0: none). ``h``: sorted, distinct."""
    if not len(h):
        return np.zeros(BINS, np.uint8)
    at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    some = at < np.append(at[1:], len(h))
    return np.where(some, h[np.minimum(at, len(h) - 1)] % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)


def least_overlap(n: int, similarity: float) -> int:
    """How many of n shingles another set must share to be that similar."""
    return math.ceil(similarity * n - 1e-9)


def alike(n: np.ndarray, bins: np.ndarray, v, others, similarity: float, slack: float = SLACK) -> np.ndarray:
    """Whether v's and the others' sizes and minima allow the similarity (``slack`` below it, by the minima's estimate)."""
    x, y = bins[v], bins[others]
    same = ((x == y) & (y > 0)).sum(-1)
    either = ((x | y) > 0).sum(-1)
    sizes = np.minimum(n[v], n[others]) >= similarity * np.maximum(n[v], n[others]) - 1e-9
    return sizes & (same >= (similarity - slack) * either)


def forest(n: np.ndarray, bins: np.ndarray, similarity: float, slack: float = SLACK) -> list[tuple[int, int]]:
    """Links that connect what chains of ``alike`` connect: from each member reached, to all not reached before."""
    out, left = [], np.arange(len(n))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            v = reached.pop()
            ok = alike(n, bins, v, left, similarity, slack)
            hit = left[ok].tolist()
            out += [(v, x) for x in hit]
            reached += hit
            left = left[~ok]
    return out


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many documents, sorted, by a sample. They only decide which prefixes are short to compare, never what links."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches):
        for b in small(batches):
            found = [set_of(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, "<u8")]).view(np.int64))], names=["h"])

    text = F.coalesce("text", F.lit(""))
    some = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    often = some.distinct().mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    rows = often.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """One row per distinct set of shingles, and one per document: (unique, rows).

    ``unique``: sid (a hash of the set), at (least document: d, th), n, fp (fingerprint of the set), bins, prefix.
    """
    often = frequent(docs, words)

    def run(batches):
        for b in small(batches):
            texts = b.column(1).to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], "<u8").view(np.int64)
            sets = [set_of(t, words) for t in texts]
            sids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], "<u8").view(np.int64)
            prefixes = []
            for h in sets:
                at = np.searchsorted(often, h) if len(often) else np.zeros(len(h), int)
                common = often[np.minimum(at, len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
                ordered = np.concatenate([h[~common], h[common]]).view(np.int64)
                prefixes.append(ordered[: len(h) - least_overlap(len(h), similarity) + 1])
            columns = [
                b.column(0), pa.array(hashes), pa.array(sids), pa.array([len(h) for h in sets], pa.int32()), pa.array([majority(h) for h in sets], pa.int64()),
                pa.array([minima(h).tobytes() for h in sets], pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "th", "sid", "n", "fp", "bins", "prefix"])

    rows = docs.select(key_of(docs).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "d long, th long, sid long, n int, fp long, bins binary, prefix array<long>")


def prefix_links(unique: DataFrame, similarity: float, slack: float) -> DataFrame:
    """a, b: links that connect all sets which share a prefix shingle and are ``alike``. Linear in the prefixes.

    A shingle with over CROWD sets is dealt in pairs of parts, so that no task compares more than two parts.
    """

    def near(batches):
        for g in whole_runs(batches):
            key, sid, n = (np.asarray(g.column(k)) for k in range(3))
            bins = np.frombuffer(b"".join(g.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            size, start = run_sizes(key), np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            two = start[size[start] == 2]
            two = two[alike(n, bins, two, two + 1, similarity, slack)] if len(two) else two
            a, b = [sid[two]], [sid[two + 1]]
            for i in start[size[start] > 2].tolist():
                j = i + int(size[i])
                found = np.array(forest(n[i:j], bins[i:j], similarity, slack), np.int64).reshape(-1, 2) + i
                a.append(sid[found[:, 0]])
                b.append(sid[found[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        give_back()

    tokens = unique.select(F.explode("prefix").alias("token"), "sid")
    found = cut(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(repeated, "token long, sid long"), "shared")
    found = found.join(found.groupBy("token").agg(F.count("*").alias("size")), "token")
    parts, own = F.ceil(F.col("size") / CROWD), F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / CROWD))
    other = F.explode(F.when(F.col("size") <= CROWD, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = found.select("token", "sid", "size", own.alias("own"), other.alias("other"))
    key = F.when(F.col("size") <= CROWD, F.col("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(key.alias("key"), "sid").join(unique.select("sid", "n", "bins"), "sid").select("key", "sid", "n", "bins")
    return dealt.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(near, "a long, b long").distinct()


def covering_links(unique: DataFrame) -> DataFrame:
    """a, b: links that connect the sets whose fingerprints differ in at most two bits, by anchor-point covering."""
    heads = cut(unique.groupBy("fp").agg(F.min("sid").alias("head")), "heads")
    same = unique.join(heads, "fp").filter("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    near = links(heads).join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src")
    return near.join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst").select("a", "b").union(same)


def sets_of(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """sid and its set (little-endian unsigned 64-bit, sorted), made from one document each. ``need``: sid, d, th."""

    def run(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_of(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["sid", "hashes"])

    text = F.coalesce("text", F.lit(""))
    texts = docs.select(key_of(docs).alias("d"), F.xxhash64(text).alias("th"), text.alias("text")).join(need, ["d", "th"])
    return texts.dropDuplicates(["sid"]).select("sid", "text").mapInArrow(run, "sid long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """src, dst: the pairs (a, b) whose sets have the Jaccard similarity. a's many pairs are dealt over SALTS keys."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    first = dealt.select("a", "salt").distinct().join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a")
    both = dealt.join(first, ["a", "salt"]).join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for b in small(batches, 256):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["src", "dst"])

    return both.mapInArrow(run, "src long, dst long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right, by products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float64)
    value, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for begin in range(0, len(value), columns):
        i, j = np.searchsorted(at, [begin, begin + columns])
        m = np.zeros((len(left) + len(right), columns), np.float32)
        m[row[i:j], at[i:j] - begin] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def rest_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """src, dst: links between roots of one family whose members have the similarity, found without listing pairs.

    ``members``: family, sid, root, n. A family's sets are dealt into blocks of about BLOCK sets (fewer, if they are
    large): a root with more than a block has blocks of its own, the others share some. Each pair of blocks is one
    group, compared by a matrix product, unless both are of one root. Only links that join different roots come out.
    """
    weight = F.greatest(F.lit(1.0), F.col("n") / BLOCK_SHINGLES * BLOCK)
    roots = members.groupBy("family", "root").agg(F.sum(weight).alias("weight"))
    mixed = roots.groupBy("family").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("weight") <= BLOCK, F.col("weight")).otherwise(0)).alias("pool")).filter("roots > 1")
    roots = roots.join(mixed, "family")
    large = F.col("weight") > BLOCK
    roots = cut(roots.select("family", "root", large.alias("large"), F.ceil(F.when(large, F.col("weight")).otherwise(F.col("pool")) / BLOCK).alias("parts")), "roots")
    tag = F.when(F.col("large"), F.col("root"))
    part = F.pmod(F.when(F.col("large"), F.xxhash64("sid")).otherwise(F.xxhash64("root")), F.col("parts"))
    dealt = members.join(roots, ["family", "root"]).select("family", "sid", "root", F.struct(tag.alias("tag"), part.alias("part")).alias("block"))
    dealt = cut(dealt, "dealt")
    blocks = dealt.groupBy("family").agg(F.collect_set("block").alias("blocks"))
    rows = dealt.join(blocks, "family").select("family", "sid", "root", "block", F.explode("blocks").alias("other"))
    one = F.col("block.tag").isNotNull() & F.col("block.tag").eqNullSafe(F.col("other.tag"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.filter(~one).select(F.xxhash64("family", low, high).alias("pair"), (F.col("block") == low).alias("is_low"), (F.col("block") == high).alias("is_high"), "sid", "root")
    rows = rows.join(sets, "sid").select("pair", "is_low", "is_high", "root", "hashes")

    def joined(roots: np.ndarray, low: np.ndarray, high: np.ndarray, found: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that connect the roots of a pair of blocks (both the same block, where all rows are low and high)."""
        left, right = np.flatnonzero(low), np.flatnonzero(high)
        if not len(left) or not len(right):
            return []
        shared = overlaps([found[i] for i in left], [found[i] for i in right])
        n = np.array([len(x) for x in found], float)
        ok = shared >= similarity * (n[left][:, None] + n[right] - shared) - 1e-9
        ok &= roots[left][:, None] != roots[right]
        x, y = np.nonzero(ok)
        a, b = roots[left[x]], roots[right[y]]
        top: dict[int, int] = {}

        def root(i: int) -> int:
            while top.get(i, i) != i:
                i = top[i]
            return i

        out = []
        for p, q in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).tolist():
            p0, q0 = root(p), root(q)
            if p0 != q0:
                top[max(p0, q0)] = min(p0, q0)
                out.append((p, q))
        return out

    def compare(batches):
        for g in whole_runs(batches):
            pair, roots = np.asarray(g.column(0)), np.asarray(g.column(3))
            low, high = (g.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            links: list[tuple[int, int]] = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=True):
                if j - i > 1:
                    found = [np.frombuffer(x, "<u8") for x in g.column(4).slice(i, j - i).to_pylist()]
                    links += joined(roots[i:j], low[i:j], high[i:j], found)
            both = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])
        give_back()

    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "src long, dst long").distinct()


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, slack: float = SLACK) -> DataFrame:
    """d (doc_id, null as the least), th, root: documents that chains of similar texts join have one root.

    Texts link if their sets of shingles have at least this Jaccard similarity. Equal sets are one. First, sets whose
    fingerprints differ in at most two bits are linked by anchor-point covering. Two bits of 64 are far less than
    that similarity allows (about ten differ at 0.8), so candidates are completed by shingles: sets so similar share
    one among the first n - ceil(similarity * n) + 1 of each, in any order common to all (shingles of many documents
    come last). Minima of the sets rule out pairs far below the similarity (``slack``, by default six standard deviations). Links that
    connect all candidates are verified by the sets themselves and contracted. Where a family of candidates then still
    has several roots, all its sets of different roots are compared, block by block: each set moves once for each block of
    its family, so a family of N sets moves N * N / BLOCK of them. No pairs are listed. A pair whose minima mislead is lost
    by ``slack``, unless that is 1: then all that share a prefix shingle are compared, and none is lost.
    """
    with batches_of(docs.sparkSession, 512):
        return _similar(docs, words, similarity, slack)


def _similar(docs: DataFrame, words: int, similarity: float, slack: float) -> DataFrame:
    rows = cut(sketches(docs, words, similarity), "sketches")
    facts = [F.first(x).alias(x) for x in ("n", "fp", "bins", "prefix")]
    unique = cut(rows.groupBy("sid").agg(F.min(F.struct("d", "th")).alias("at"), *facts), "unique")
    near = cut(prefix_links(unique, similarity, slack), "near")
    pairs = cut(near.union(covering_links(unique).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "candidates")
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(unique.select("sid", "at.d", "at.th"), "sid")
    sets = cut(sets_of(docs, need, words), "sets")
    nodes = unique.select(F.col("sid").alias("node"), F.col("sid").alias("label"))
    alike_pairs = cut(verified(pairs, sets, similarity), "verified")
    found = cut(components(nodes, alike_pairs).select(F.col("node").alias("sid"), "root"), "joined")
    families = components(nodes, near.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("sid"), F.col("root").alias("family"))
    members = families.join(found, "sid", "left").join(unique.select("sid", "n"), "sid").select("family", "sid", F.coalesce("root", "sid").alias("root"), "n")
    more = cut(rest_links(cut(members, "families"), sets, similarity), "more")
    if more.limit(1).count():
        top = components(nodes, more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        single = more.select(F.col("src").alias("sid")).union(more.select("dst")).distinct().join(found, "sid", "left_anti")
        found = found.union(single.select("sid", F.col("sid").alias("root")))
        found = cut(found.join(top, "root", "left").select("sid", F.coalesce("top", "root").alias("root")), "joined")
    return rows.join(found, "sid", "left").select("d", "th", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents' rows without near-duplicates: of each group of similar ones the smallest doc_id, one row of it."""
    found = cut(similar(docs, words, similarity), "similar")
    stay = cut(found.groupBy("root").agg(F.min(F.struct("d", "th")).alias("first")).select("first.d", "first.th"), "kept")
    rows = docs.select(F.struct("*").alias("row"), key_of(docs).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.join(stay, ["d", "th"], "left_semi")
    repeated = found.groupBy("d", "th").count().filter("count > 1").limit(1).count()
    if repeated:
        rows = rows.dropDuplicates(["d", "th"])
    return rows.select("row.*")
