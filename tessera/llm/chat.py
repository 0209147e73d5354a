"""Chat formatting over reply trees, in DataFrame expressions only.

``tree``: thread, node, parent (null at a root), role, text, score. Of rows with the same thread and node the first by
parent, role, text and score stays; a row without a node takes no part. Ancestor
tables double their reach with each self-join (1, 2, 4, ... replies up), so a path of any length takes as many joins
as its length has binary digits. Branches of a tree are ranked by the mean score of their messages, ties to the
smaller leaf; each chosen leaf then gathers its ancestors through the same tables, every one exactly once.

A turn is written as ``<|im_start|>role, newline, text<|im_end|>`` and a newline. Control strings inside roles and
texts are escaped reversibly. The loss mask is the list of character spans that hold the assistants' texts.

Null role and text count as empty, a null thread is a thread, messages of equal turn are ordered by role and text, an
empty table gives no conversations. A parent that does not exist makes its reply a root. Where messages answer each
other in a circle, the one of the least node becomes a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates give a meaning. None contains another one or a backslash.
CONTROL = [START, END, "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>"]
CODES = [("\\", "\\b"), *((c, f"\\{k}") for k, c in enumerate(CONTROL))]


def escape(text: Column) -> Column:
    """Backslashes and control strings as a backslash with one character; no control string is left."""
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    """As ``escape``, and newlines too: the first newline of a turn ends its role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def replies(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the row before it."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(order).cast("long")
    return rows.select(F.col("conv_id").alias("thread"), node.alias("node"), "role", "text").select(
        "thread", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def _on(a: DataFrame, x: str, b: DataFrame, y: str, how: str = "inner") -> DataFrame:
    return a.join(b, a["thread"].eqNullSafe(b["_thread"]) & (a[x] == b[y]), how).drop("_thread")


def one_each(tree: DataFrame) -> DataFrame:
    """Without repeated and missing nodes."""
    rank = F.row_number().over(W.partitionBy("thread", "node").orderBy("parent", "role", "text", "score"))
    return tree.filter("node is not null").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def without_circles(known: DataFrame, circling: DataFrame) -> DataFrame:
    """``known`` with each circle cut above its least node: the one that is the least of its own ancestors."""
    least = circling.filter("low = node").select(F.col("thread").alias("_thread"), F.col("node").alias("_node"), F.lit(True).alias("_cut"))
    rows = _on(known, "node", least, "_node", "left").withColumn("_name", F.when(F.col("_cut").isNull(), F.col("_name")))
    return rows.drop("_node", "_cut")


def best_paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """thread, leaf, node, distance (0 at the leaf) of the ``branches`` best paths of each tree.

    ``tree`` should be a written table. Takes two joins for each binary digit of the longest path.
    """
    names = tree.select(F.col("thread").alias("_thread"), F.col("node").alias("_name"))
    known = _on(tree.select("thread", "node", "parent", "score"), "parent", names, "_name", "left")
    tables, state, longest = [], None, None
    while True:
        if state is None:
            own = (F.col("_name").alias("up"), F.col("_name").alias("low"), F.lit(1).cast("long").alias("steps"))
            state = known.select("thread", "node", *own, F.coalesce("score", F.lit(0.0)).alias("total"), F.coalesce("_name", "node").alias("root"))
        state = cut(state, "ancestors")
        going = state.filter("up is not null")
        if not going.limit(1).count():
            break
        if 2 ** len(tables) >= 64 and longest is None:
            longest = tree.groupBy("thread").count().agg(F.max("count")).first()[0]
        if longest is not None and 2 ** len(tables) > longest:  # a path longer than its thread
            known, tables, state = cut(without_circles(known, going), "known"), [], None
            continue
        tables.append(going.select(F.col("thread").alias("_thread"), F.col("node").alias("_node"), "up"))
        # Only messages that have not reached their root take part in the next join.
        above = state.select(F.col("thread").alias("_thread"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("low").alias("_low"), F.col("steps").alias("_steps"), F.col("total").alias("_total"), F.col("root").alias("_root"))
        sums = ((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("steps", "total"))
        higher = _on(going, "up", above, "_node").select("thread", "node", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), *sums, F.col("_root").alias("root"))
        state = higher.union(state.filter("up is null"))
    parents = known.filter("_name is not null").select(F.col("thread").alias("_thread"), "_name").distinct()
    leaves = _on(state, "node", parents, "_name", "left_anti")
    rank = F.row_number().over(W.partitionBy("thread", "root").orderBy(F.desc(F.col("total") / F.col("steps")), "node"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches)
    found = chosen.select("thread", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(tables))):
        found = cut(found, "paths")
        higher = _on(found, "node", tables[k], "_node").select("thread", "leaf", F.col("up").alias("node"), (F.col("distance") + 2**k).alias("distance"))
        found = found.union(higher)
    return found


def format_paths(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """thread, leaf, formatted, loss_spans (start, end in characters, in order): one row per path."""
    texts = tree.select(F.col("thread").alias("_thread"), F.col("node").alias("_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = _on(paths, "node", texts, "_node").select("thread", "leaf", (-F.col("distance")).alias("at"), "role", escape(F.col("text")).alias("body"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = F.sum(F.length("piece")).over(W.partitionBy("thread", "leaf").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    span = F.when(F.col("role") == "assistant", F.struct("start", "end"))
    rows = turns.select("thread", "leaf", F.struct("at", "piece", span.alias("span")).alias("turn"))
    grouped = rows.groupBy("thread", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return grouped.select("thread", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_trees(tree: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """The formatted conversations of all trees. ``unique``: nodes are known to be present and unique in their threads."""
    tree = cut(tree if unique else one_each(tree), "tree")
    return format_paths(tree, best_paths(tree, branches))


def read_back(formatted: DataFrame) -> DataFrame:
    """The rows with ``turns`` (role, text) and ``loss_text``, both from the formatted text and its mask alone."""
    parts = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != ""),
        lambda x: F.substring(x, len(START) + 1, 1 << 30),
    )
    turns = F.transform(parts, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.instr(x, F.lit("\n")) + 1, F.length(x))).alias("text")))
    text = F.col("formatted")
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: turns, the text under the loss mask, and the formatted length."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("thread").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def escaped_length_sql(column: str) -> str:
    """DuckDB SQL for the length of an escaped text, for the comparison query."""
    sql = column
    for plain, code in CODES:
        sql = f"replace({sql}, '{plain}', '{code}')"
    return f"length({sql})"


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END) + 1} + {escaped_length_sql("replace(role, chr(10), '~~')")} + {escaped_length_sql("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
