"""Quality rules: text statistics, and a decision list learned from labelled documents by sequential covering.

All of it is DataFrame expressions. Statistics are array functions on a document's own words: row-wise, no shuffle.
A word is a run of bytes other than 0x20 and 0x09 to 0x0D. The list is grown and pruned on the driver over the
statistics of at most ``sample`` labelled documents, taken by the order of a hash of doc_id; it ends up as one ordered
``CASE WHEN`` over threshold conjunctions. Documents that fail a base rule are rejected whatever the list says.

Null text has no words (so it fails the base rule). Labels that are null or repeated with both values are not learned
from. Without labels of both kinds the list is empty and keeps what the base rules keep. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are told apart by a 64-bit hash of their three words. Only where some hash repeats are hashes sorted with
    their places; each repeated window covers three words less its overlap with the next one.
    """

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        return F.filter(pairs, lambda x, i: ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | same(x, i + 1))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        places = let(pairs, lambda p: F.sort_array(F.transform(repeated(p), lambda x: x["at"])))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    def hashes(w: Column) -> Column:
        n = F.size(w) - 2
        return F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, lambda w: let(hashes(w), count)))


def dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their statistics under fixed names; columns of the input with such a name are replaced, _words goes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": count(SYMBOLS),
            "n_dup_lines": dup_lines(text).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
            "n_marks": count("[!?]"),
            "n_upper": count(r"\p{Lu}"),
            "n_digits": count("[0-9]"),
        }
    ).drop("_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test, as ratios that do not depend on a document's length."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "chars_per_word": per("word_chars", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "dup_lines_per_word": per("n_dup_lines", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    """``feature >= threshold``, or ``<`` where ``above`` is false."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= self.threshold if self.above else x < self.threshold

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        x = data[self.feature]
        return x >= self.threshold if self.above else x < self.threshold


def _all(tests: list[Test], data: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(data.values()))), bool)
    for t in tests:
        out &= t.holds(data)
    return out


def grow(data: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 40, most: int = 4) -> list[Test]:
    """Add the test of the highest information gain until no good document is covered."""
    tests: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most and (~bad[inside]).any():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, gain = None, 0.0
        for name, x in data.items():
            for c in np.unique(np.quantile(x[inside], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    held = inside & ((x >= c) if above else (x < c))
                    p1 = int((held & bad).sum())
                    if not p1:
                        continue
                    g = p1 * (np.log2(p1 / (p1 + int((held & ~bad).sum()))) - np.log2(p / (p + n)))
                    if g > gain + 1e-9:
                        best, gain = Test(name, above, float(c)), g
        if best is None:
            break
        tests.append(best)
        inside &= best.holds(data)
    return tests


def prune(tests: list[Test], data: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """The leading tests for which the rule is worth most on documents it was not grown on."""

    def worth(k: int) -> float:
        held = _all(tests[:k], data)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / max(p + n, 1)

    return tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]


def learn(data: dict[str, np.ndarray], bad: np.ndarray, rules: int = 12, precision: float = 0.98) -> list[list[Test]]:
    """Sequential covering: rules are grown on two thirds and pruned on the rest, and what one covers leaves.

    A rule enters the list only if, on the pruning part, at least ``precision`` of what it rejects is labelled bad.
    """
    part = np.arange(len(bad)) % 3 == 0
    out: list[list[Test]] = []
    left = np.ones(len(bad), bool)
    for _ in range(rules):
        pick = lambda m: {k: x[m] for k, x in data.items()}
        g, h = left & ~part, left & part
        if bad[g].sum() < 5 or bad[h].sum() < 2:
            break
        tests = grow(pick(g), bad[g])
        if not tests:
            break
        tests = prune(tests, pick(h), bad[h])
        held = _all(tests, pick(h))
        covered = int(held.sum())
        if covered < 2 or int((held & bad[h]).sum()) < precision * covered:
            break
        out.append(tests)
        left &= ~_all(tests, data)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> list[list[Test]]:
    """A decision list from at most ``sample`` labelled documents (quality 0: bad), by the order of a hash of doc_id."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_top"))
    known = known.filter("quality = _top and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Written first: else the filter below would move under the join and compute statistics of every document.
    chosen = cut(docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "quality")), "doc_id"), "sample")
    found = statistics(chosen).filter(~base_failed())
    got = found.select("quality", *(c.alias(n) for n, c in features().items())).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not got:
        return []
    bad = np.array([r["quality"] == 0 for r in got])
    return learn({n: np.array([r[n] for r in got], float) for n in features()}, bad)


def verdict(rules: list[list[Test]]) -> Column:
    """The decision list as one ordered conditional expression: false for the first rule that holds, else true."""
    out = F.when(base_failed(), F.lit(False))
    for tests in rules:
        both = tests[0].column()
        for t in tests[1:]:
            both = both & t.column()
        out = out.when(both, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows with statistics, base_failed and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))
