"""Conversation prefix trie: what conversations share, as a balanced-parentheses tree per shard.

Conversations become paths of turn keys (16 bytes of a digest of role and text). Distinct paths are dealt by range, so
each task has a run of the trie in order and cuts it into shards of about SHARD turns. A shard is one sequence of
parentheses, a pair per node:

* excess after each parenthesis, its minima in blocks of BLOCK and in a tree of ranges over the blocks: findclose goes
  forward in the block, up and down the tree, then forward in one block, for all nodes at once;
* findclose delimits subtrees. The rank of leaf pairs "()" at both ends counts leaves; cumulative arrays over preorder
  give members and savings; ranges of powers of two give the least member.

Nodes on a shard's first or last path (its spines) may go on in the next shard: they come out with what hangs below
them apart from spines, equal ones are added up, and they are dealt, cut and encoded again, until one shard holds them.
All other nodes are whole, and final but for the parent's name where that is on a spine.

Memory: one shard. A spine of depth d is written as d paths of up to 16 d bytes. The SHA-256 of a node's member list is
made from a sorted stream, held nowhere.

Conversations are told apart by conv_id; rows with a null conv_id belong to none and are left out. Null role and text
are empty. Rows of equal turn are ordered by role, then text; repeated rows are turns of their own. An empty table has no
conversation and no node, not even the root. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, small

KEY = 16
BLOCK = 64
#: Turns of a shard, about.
SHARD = 1 << 18
FAR = (1 << 63) - 1
PATHS = "path binary, sizes binary, depth int, n long, low long, kids long, leaves long, saved long, ends string"
NODES = PATHS + ", parent_low long, parent_path binary, whole boolean"


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text."""
    named = rows.filter("conv_id is not null")
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    named = named.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return named.select("conv_id", F.row_number().over(order).alias("place"), "role", "text")


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, path, sizes: every conversation as the first turns of its base, then its own turns from there on.

    ``path`` joins the turns' keys, ``sizes`` their texts' UTF-8 bytes as big-endian 64-bit integers.
    """
    # the length of the role comes first, so that no other role and text give the same bytes
    digest = F.substring(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256), 1, 2 * KEY)
    keyed = cut(turns(rows).select("conv_id", "place", digest.alias("key"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    named = keyed.select("conv_id").distinct().select("conv_id", borrowed(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    first = keyed.filter("place <= 8 and conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "place", "key", "bytes")
    taken = named.join(first, "base").filter("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "key", "bytes")
    own = keyed.filter(F.col("place") > borrowed(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "place", "key", "bytes")
    none = named.select("conv_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("bytes"))
    rows = taken.union(own).union(none)
    turn = F.struct("part", "place", "key", "bytes")
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), turn))).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    size = F.unhex(F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["bytes"]), 16, "0")), ""))
    return listed.select("conv_id", path.alias("path"), size.alias("sizes"))


def id_digests(rows: DataFrame) -> DataFrame:
    """path_key, ends: SHA-256 of the decimal conv_ids of each path, ascending, joined by commas. Streams a sorted run."""

    def run(batches):
        key, sha = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(str(c).encode())
                else:
                    sha.update(b",%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["path_key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["path_key", "ends"])

    return rows.select("path_key", "conv_id").repartition("path_key").sortWithinPartitions("path_key", "conv_id").mapInArrow(run, "path_key binary, ends string")


def paths(conversations: DataFrame) -> DataFrame:
    """PATHS: each distinct path once, with the conversations that end there. ``conversations``: as from ``rebuilt``."""
    rows = cut(conversations.withColumn("path_key", F.unhex(F.md5("path"))), "conversations")
    one = rows.groupBy("path_key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    one = one.join(id_digests(rows), "path_key")
    none = F.lit(0).cast("long")
    return one.select("path", "sizes", (F.octet_length("path") / KEY).cast("int").alias("depth"), "n", "low", none.alias("kids"), none.alias("leaves"), none.alias("saved"), "ends")


class Parentheses:
    """A tree as a balanced sequence (+1 opens, -1 closes) with a tree of range minima over blocks of its excess."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.excess = np.cumsum(sequence, dtype=np.int64)
        self.opens = np.flatnonzero(sequence > 0)
        blocks = 1 << max(0, -(-len(sequence) // BLOCK) - 1).bit_length()
        padded = np.full(blocks * BLOCK, FAR)
        padded[: len(sequence)] = self.excess
        self.blocks = padded.reshape(-1, BLOCK)
        self.least = [self.blocks.min(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))
        leaf = np.zeros(len(sequence), np.int64)
        leaf[:-1] = (sequence[:-1] > 0) & (sequence[1:] < 0)
        self.pairs = np.append(0, np.cumsum(leaf))
        self.close = np.concatenate([self._find_close(self.opens[i : i + 4096]) for i in range(0, len(self.opens), 4096)])

    def _find_close(self, at: np.ndarray) -> np.ndarray:
        """The first place after each opening one whose excess is below its own."""
        below = self.excess[at]
        inside = self.blocks[at // BLOCK]
        hit = (inside < below[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        found = hit.any(1)
        out = np.where(found, at // BLOCK * BLOCK + hit.argmax(1), -1)
        rest = np.flatnonzero(~found)
        node, level = at[rest] // BLOCK + 1, np.full(len(rest), -1)
        for h, least in enumerate(self.least):  # up: a right neighbour that goes low enough
            for _ in range(2):
                look = (level < 0) & (node < len(least))
                low = look & (least[np.minimum(node, len(least) - 1)] < below[rest])
                level[low] = h
                node += (level < 0) & (node % 2 == 0)  # a left child's sibling is looked at on the same level
            node = np.where(level < 0, (node + 1) // 2, node)
        for h in range(len(self.least) - 1, 0, -1):  # down: the first child that goes low enough
            at_h = level == h
            left = np.minimum(2 * node, len(self.least[h - 1]) - 1)
            node = np.where(at_h, left + (self.least[h - 1][left] >= below[rest]), node)
            level[at_h] = h - 1
        if len(rest):
            out[rest] = node * BLOCK + (self.blocks[node] < below[rest][:, None]).argmax(1)
        return out

    def sizes(self) -> np.ndarray:
        """Nodes of each node's subtree, in preorder."""
        return (self.close - self.opens + 1) // 2

    def leaf_pairs(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        return self.pairs[close] - self.pairs[at]


def range_min(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of values[first : first + size], from minima over ranges of powers of two."""
    levels, span = [values], 1
    while 2 * span <= len(values):
        levels.append(np.minimum(levels[-1][:-span], levels[-1][span:]))
        span *= 2
    level = np.frexp(size.astype(float))[1] - 1
    out = np.empty(len(first), values.dtype)
    for h, x in enumerate(levels):
        some = level == h
        out[some] = np.minimum(x[first[some]], x[first[some] + size[some] - (1 << h)])
    return out


def common_keys(a: bytes, b: bytes) -> int:
    """How many leading keys two paths share."""
    n = min(len(a), len(b)) // KEY
    same = np.frombuffer(a, f"V{KEY}", n) == np.frombuffer(b, f"V{KEY}", n)
    return n if same.all() else int(same.argmin())


def encoded(shard: list[tuple], final: bool, named_all: bool):
    """The nodes of one shard (rows of PATHS, in order of path) as columns of NODES. ``named_all``: whole nodes keep their path.

    ``n``, ``low``, ``leaves``, ``saved`` and ``kids`` of a whole node are those of its subtree; those of a spine leave
    out the spines below it.
    """
    k = len(shard)
    depth = np.array([r[2] for r in shard])
    shared = np.array([-1] + [common_keys(shard[i - 1][0], shard[i][0]) for i in range(1, k)])  # the root opens with the first path
    opened = depth - shared
    closed = np.append(np.append(0, depth[:-1] - shared[1:]), depth[-1] + 1)
    signs = np.tile(np.array([-1, 1], np.int8), k + 1)[: 2 * k + 1]
    tree = Parentheses(np.repeat(signs, np.stack([closed, np.append(opened, 0)], axis=1).ravel()[: 2 * k + 1]))
    of = np.repeat(np.arange(k), opened)  # the path that opened each node
    last = np.cumsum(opened) - 1  # each path's own node
    node_depth = tree.excess[tree.opens] - 1
    m, size, at = len(of), tree.sizes(), np.arange(len(of))
    weight = np.concatenate([np.append(0, np.frombuffer(r[1], ">i8"))[r[2] + 1 - o :] for r, o in zip(shard, opened.tolist(), strict=True)]).astype(np.int64)

    def own(column: int, fill: int = 0) -> np.ndarray:
        out = np.full(m, fill, np.int64)
        out[last] = [r[column] for r in shard]
        return out

    def below(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[at + size] - total[at]

    parent = np.full(m, -1)
    if m > 1:  # the last node before, one level up: its subtree is the smallest that holds the node
        order = np.lexsort((at, node_depth))
        place = np.searchsorted(node_depth[order] * m + at[order], (node_depth - 1) * m + at) - 1
        parent = np.where(node_depth > 0, order[np.maximum(place, 0)], -1)
    spine = np.zeros(m, bool)
    if not final:
        spine[: opened[0]] = True  # the first path
        up = int(last[-1])
        while up >= 0 and not spine[up]:
            spine[up] = True
            up = int(parent[up])
    members, low = below(own(3)), range_min(own(4, FAR), at, size)
    kids = own(5) + np.bincount(parent[1:], minlength=m)
    # leaf pairs of the sequence, but for those with children in shards before, whose leaves come with them
    hidden = own(6) - ((size == 1) & (own(5) > 0))
    leaves = tree.leaf_pairs(tree.opens, tree.close) + below(hidden)
    saving = np.where(spine, 0, (members - 1) * weight) + own(7)
    saved = below(saving)
    if spine.any():  # what hangs below spines, without spines
        hanging = ~spine & (parent >= 0)
        hanging &= spine[np.maximum(parent, 0)]
        up = parent[hanging]
        for values, first in ((members, own(3)), (leaves, own(6)), (saved, own(7)), (kids, own(5))):
            part = first.copy()
            np.add.at(part, up, 1 if values is kids else values[hanging])
            values[spine] = part[spine]
        part = own(4, FAR)
        np.minimum.at(part, up, low[hanging])
        low[spine] = part[spine]
    ends: list = [None] * m
    for i, r in zip(last.tolist(), shard, strict=True):
        ends[i] = r[8]
    named = (parent >= 0) & ~spine[np.maximum(parent, 0)]
    kept = spine | named_all
    path = [shard[p][0] if k or not n else None for p, k, n in zip(of.tolist(), kept.tolist(), named.tolist(), strict=True)]
    cut_at = (node_depth * KEY).tolist()
    return [
        pa.array([p[:c] if k else None for p, c, k in zip(path, cut_at, kept.tolist(), strict=True)], pa.binary()),
        pa.array([shard[p][1][: c // KEY * 8] if s else None for p, c, s in zip(of.tolist(), cut_at, spine.tolist(), strict=True)], pa.binary()),
        pa.array(node_depth, pa.int32()), pa.array(members), pa.array(low, mask=low == FAR), pa.array(kids), pa.array(leaves), pa.array(saved), pa.array(ends, pa.string()),
        pa.array(low[np.maximum(parent, 0)], mask=~named | spine),
        pa.array([p[: c - KEY] if not s and not n and c else None for p, c, s, n in zip(path, cut_at, spine.tolist(), named.tolist(), strict=True)], pa.binary()),
        pa.array(~spine),
    ]


def cost(depth, spines: bool):
    """What a path counts in a shard: its turns, or about a node for a spine's, whose other nodes are paths of their own."""
    return depth // 16 + 1 if spines else depth + 1


def level(rows: DataFrame, shard: int, spines: bool, final: bool) -> DataFrame:
    """NODES of the trie of ``rows`` (PATHS, distinct paths): whole nodes, and spines where it takes several shards."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches):
        held: list[tuple] = []
        turns = 0
        for b in small(batches):
            columns = [b.column(i).to_pylist() for i in range(9)]
            for r in zip(*columns, strict=True):
                held.append((*r[:4], FAR if r[4] is None else r[4], *r[5:]))
                turns += cost(r[2], spines)
                if turns >= shard and not final:
                    yield pa.RecordBatch.from_arrays(encoded(held, final, spines), names=names)
                    held, turns = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(encoded(held, final, spines), names=names)
        give_back()

    rows = rows.select(*(c.split()[0] for c in PATHS.split(", ")))
    placed = rows.coalesce(1) if final else rows.repartitionByRange("path")
    return placed.sortWithinPartitions("path").mapInArrow(run, NODES)


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Every node of the trie of the conversations' paths: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. ``conversations``: conv_id, path, sizes.

    Where cutting leaves more than half to merge (paths about as long as a shard), the rest is one shard.
    """
    rows, done, spines = cut(paths(conversations), "paths"), [], False
    size = _size(rows, spines)
    while True:
        final = size <= shard
        nodes = cut(level(rows, shard, spines, final), "nodes")
        done.append(nodes.filter("whole"))
        if final:
            break
        facts = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
        merged = nodes.filter("not whole").groupBy("path").agg(F.first("sizes").alias("sizes"), F.first("depth").alias("depth"), F.min("low").alias("low"), F.max("ends").alias("ends"), *facts)
        rows, spines, before = cut(merged, "spines"), True, size
        size = _size(rows, spines)
        if 2 * size > before:
            shard = size
    whole = reduce(DataFrame.union, done).withColumn("top", F.col("parent_low"))
    if len(done) > 1:
        tops = reduce(DataFrame.union, done[1:]).select(F.col("path").alias("parent_path"), F.col("low").alias("top"))
        apart = whole.filter("parent_path is not null").drop("top").join(tops, "parent_path")
        whole = whole.filter("parent_path is null").unionByName(apart)
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("top").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )


def _size(rows: DataFrame, spines: bool) -> int:
    depth = F.col("depth")
    return rows.agg(F.sum(F.floor(depth / 16) + 1 if spines else depth + 1)).head()[0] or 0


#: CRC-32 of a decimal number's digits, by eight shifts a byte.
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || [i::BIGINT FOR i IN range(8)], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT i.conv_id, 0 AS part, place, role, text FROM ids i JOIN t ON t.conv_id = base AND place <= h
  UNION ALL SELECT i.conv_id, 1, place, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND place > h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, strlen(text) AS bytes, sha256(length(role) || chr(10) || role || text) AS turn FROM r),
m AS (
  SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS path, NULL AS up FROM ids
  UNION ALL SELECT conv_id, depth, bytes, string_agg(turn, '') OVER w, coalesce(string_agg(turn, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT path, any_value(up) AS up, depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS members FROM m GROUP BY path, depth),
kids AS (SELECT up AS path, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path),
under AS (
  SELECT a.path, sum((u.members - 1) * u.bytes) AS saved, count(*) FILTER (WHERE k.kids IS NULL) AS leaves
  FROM nodes u JOIN m a ON a.conv_id = u.conv_id AND a.depth <= u.depth LEFT JOIN kids k ON k.path = u.path GROUP BY a.path)
SELECT v.conv_id::BIGINT AS conv_id, v.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, v.members::BIGINT AS n_convs,
  coalesce(k.kids, 0)::BIGINT AS n_children, under.leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes v JOIN under ON under.path = v.path LEFT JOIN nodes p ON p.path = v.up LEFT JOIN kids k ON k.path = v.path LEFT JOIN ends e ON e.path = v.path
"""
