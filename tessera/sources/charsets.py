"""Bytes to text: the declared charset, the one that the page names, or the likeliest one.

Valid UTF-8 is decoded by expressions. What is left is decoded in Arrow batches: by the declared charset, by byte-order
mark, by zeros at every other byte, by the charset that a meta tag names, and else by the sum of log-likelihoods of pairs
of characters, under a model that is counted over texts of the languages expected (``pair_counts``, ``model``).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import mapped

#: What undeclared bytes may be, in the order in which ties go.
CANDIDATES = ["windows-1251", "koi8-r", "cp866", "iso-8859-5", "windows-1252"]
MARKS = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
NAMED = re.compile(rb"""(?is)<(?:meta|\?xml)[^>]{0,200}?(?:charset|encoding)\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""")
#: How far into a page its own word for its charset is looked for.
HEAD = 4096
#: Letters that pairs are counted of as they are (in either case), and the classes of all other characters.
LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
CLASSES = {"a": "[a-z]", "A": "[A-Z]", "ä": "[ß-ÿœšž]", "Ä": "[À-ÞŒŠŽ]", "0": "[0-9]", " ": r"\s", ".": r"[!-/:-@\[-`{-~]", "«": "[«»№„“”–—…’§°©®]"}
#: About how many characters share a class: each is that much less likely than its class.
SHARED = {"a": 26, "A": 26, "ä": 34, "Ä": 34, "0": 10, " ": 4, ".": 50, "«": 50, "?": 60}
#: What a pair costs that was never seen, a pair of capitals besides that of its letters, and a capital before a small one.
UNSEEN, CAPITALS, CAPITAL = -9.0, -1.0, -0.2
#: How much the share of Cyrillic letters counts where plain ones outnumber them.
MIXED = 2.0


def kind_of(ch: str) -> str:
    """A Cyrillic letter itself, else the class of the character."""
    if ch.lower() in LETTERS:
        return ch
    return next((kind for kind, pattern in CLASSES.items() if re.fullmatch(pattern, ch)), "?")


def pair_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """pair, n: how often two kinds of characters stand side by side in all texts, in either case. Partial counts per batch."""

    def run(batches):
        kinds: dict[str, str] = {}
        for b in batches:
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                found.update(zip(t, t[1:], strict=False))
            pairs: Counter = Counter()
            for (a, b), n in found.items():
                for ch in (a, b):
                    if ch not in kinds:
                        kinds[ch] = kind_of(ch)
                a, b = kinds[a], kinds[b]
                if not (a.islower() and b.isupper() and a in LETTERS):
                    pairs[(a.lower() if a.lower() in LETTERS else a) + (b.lower() if b.lower() in LETTERS else b)] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

    rows = texts.select(F.coalesce(column, F.lit("")).alias("t"))
    return rows.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> dict[str, float]:
    """Log-likelihood of each pair given its first kind. ``counts``: as from ``pair_counts``, at most (33 + 9)^2 rows."""
    rows = [(r["pair"], r["n"]) for r in counts.collect()]
    first: Counter = Counter()
    for pair, n in rows:
        first[pair[0]] += n
    return {pair: max(UNSEEN, math.log(n / first[pair[0]])) for pair, n in rows}


def plain_model() -> dict[str, float]:
    """Without counts: letters of a script follow each other, and scripts don't mix. (Texts in capitals alone need counts.)"""
    small, marks = [*LETTERS], [" ", ".", "«"]
    out = {a + b: -3.0 for a in small for b in small}
    out |= {x: -3.0 for a in small for m in marks for x in (a + m, m + a)}
    out |= {a + b: -1.0 for a in ("a", "A", "ä", "Ä", *marks) for b in ("a", "A", "ä", "Ä", *marks)}
    return out


class Guess:
    """Tables of bytes to kinds and of kinds to log-likelihoods, one per candidate; scores of whole texts by look-ups."""

    def __init__(self, pairs: dict[str, float], candidates: list[str] = CANDIDATES) -> None:
        kinds = [*LETTERS, *LETTERS.upper(), *CLASSES, "?"]
        at = {k: i for i, k in enumerate(kinds)}
        low = lambda k: k.lower() if k.lower() in LETTERS else k
        self.score = np.full((len(kinds), len(kinds)), 2 * UNSEEN)
        for a in kinds:
            for b in kinds:
                large = [x.lower() in LETTERS and x.isupper() for x in (a, b)]
                if large[1] and not large[0] and a in LETTERS:
                    continue  # a capital within a word
                cost = CAPITALS if all(large) else CAPITAL if any(large) else 0.0
                self.score[at[a], at[b]] = max(UNSEEN, pairs.get(low(a) + low(b), UNSEEN) + cost) - math.log(SHARED.get(b, 1))
        self.candidates, self.kinds, self.cyrillic = candidates, [], 2 * len(LETTERS)
        for name in candidates:
            chars = [bytes([b]).decode(name, "replace") for b in range(256)]
            shown = lambda c: c in "\t\n\r" or c.isprintable() and c != "\ufffd" or c == "\xa0"
            self.kinds.append(np.array([at[kind_of(c) if shown(c) else "?"] for c in chars]))

    def best(self, raw: bytes) -> str:
        """The candidate under which the pairs with a byte beyond ASCII are likeliest. Counts of byte pairs: any length.

        A word that repeats says nothing new, so each counts once. Pairs don't reach across blanks, so lone letters among
        plain words would go to whichever script has more of them: see ``_mixture``.
        """
        b = np.frombuffer(b" %b " % b" ".join(sorted(set(raw.split()))), np.uint8).astype(np.int64)
        high = (b[1:] > 127) | (b[:-1] > 127)
        pair, n = np.unique(b[:-1][high] * 256 + b[1:][high], return_counts=True)
        plain = (b | 32 >= 97) & (b | 32 <= 122)
        odds = [self._mixture(k[b] < self.cyrillic, plain) for k in self.kinds]
        scores = [float((self.score[k[pair // 256], k[pair % 256]] * n).sum()) for k in self.kinds]
        if max(odds) > -math.inf:
            scores = [s + o for s, o in zip(scores, odds, strict=True)]
        return self.candidates[int(np.argmax(scores))]

    @staticmethod
    def _mixture(letters: np.ndarray, plain: np.ndarray) -> float:
        """Log-odds of Cyrillic letters among plain ones: none where they are no fewer, else by their share.

        Words of three Cyrillic letters must outnumber the places where the scripts touch.
        """
        few, many = np.count_nonzero(letters), np.count_nonzero(plain)
        if not 0 < few < many:
            return 0.0
        three = letters[:-2] & letters[1:-1] & letters[2:]
        if np.count_nonzero(three[1:] & ~three[:-1]) <= np.count_nonzero(letters[1:] & plain[:-1] | letters[:-1] & plain[1:]):
            return -math.inf
        return MIXED * math.log(few / many)


def known(name: str | None) -> bool:
    """Whether Python knows a charset of texts by this name."""
    try:
        return bool(name) and "".encode(name) is not None
    except (LookupError, ValueError):
        return False


def charset_of(raw: bytes, declared: str | None, guess: Guess) -> str:
    """The declared charset if the bytes are valid in it; then marks, UTF-16 without one, UTF-8, the page's own word, the guess."""

    def valid(name: str) -> bool:
        try:
            raw.decode(name)
        except UnicodeError:
            return False
        return True

    if known(declared) and valid(declared):
        return declared
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    if len(raw) >= 8 and len(raw) % 2 == 0:  # in UTF-16 every other byte is 0 or the Cyrillic block's 4, the rest hardly ever
        even, odd = (sum(map(half.count, (0, 4))) / len(half) for half in (raw[::2], raw[1::2]))
        if max(even, odd) > 0.9 and min(even, odd) < 0.5 and valid(name := "utf-16-le" if odd > even else "utf-16-be"):
            return name
    if valid("utf-8"):
        return "utf-8"
    if (found := NAMED.search(raw[:HEAD])) and known(name := found[1].decode("ascii")) and valid(name):
        return name
    return guess.best(raw)


def decoded(content: Column, declared: Column, pairs: dict[str, float] | None = None) -> Column:
    """Text of bytes: null bytes are the empty text, bytes that no charset fits are replaced one by one.

    Valid UTF-8 without another declared charset never leaves the JVM. ``pairs``: as from ``model``, else ``plain_model()``.
    """
    table = pairs or plain_model()

    @F.arrow_udf("string")
    def run(raw: pa.Array, name: pa.Array) -> pa.Array:
        guess = Guess(table)
        return mapped(lambda x, n: None if x is None else x.decode(charset_of(x, n, guess), "replace"), pa.string(), raw, name)

    content = F.coalesce(content, F.lit(b"").cast("binary"))
    named = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    plain = named.isin("", "utf-8", "utf8", "ascii", "us-ascii") & F.is_valid_utf8(content.cast("string")) & ~F.startswith(content, F.lit(b"\xef\xbb\xbf")) & ~F.contains(content, F.lit(b"\x00"))
    return F.when(plain, content.cast("string")).otherwise(run(F.when(~plain, content), F.when(~plain, declared)))
