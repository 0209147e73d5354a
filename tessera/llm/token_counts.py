"""Exact token counts at every prefix of a text, by prefix dynamic programming.

A text's table has one part for each pre-token: the tokens before it, and the prefix dynamic programme's count after
each of its bytes (:class:`tessera.llm.bpe.Vocabulary`). White space has parts of its own, because the pattern splits it by
what follows it: a head that ends in white space has the whole run as one pre-token. So the count of every prefix is
one entry of the table, and lengths, truncation and budgets are looked up. Counts are not monotone (half a word may
take more tokens than the whole), so a budget's longest prefix is searched from the table's end.

All of it is row-wise: no shuffle, and a task holds one Arrow batch. Null and empty texts have no tokens. Repeated
rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_ENTRIES, Units, Vocabulary, split_special, splitter
from .common import small, with_text


#: What the pattern takes whole before it looks at letters.
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


@functools.cache
def blank() -> "regex.Pattern":
    return regex.compile(r"\s*")


class Counter:
    """Per worker: prefix counts of pre-tokens, and total counts of units, for one vocabulary."""

    def __init__(self, path: str):
        self.vocab = Vocabulary.load(path)
        self.pieces: dict[str, bytes | list[int]] = {}
        self.units = Units(self._total)
        self.find = splitter().findall

    def piece(self, text: str):
        """Counts after every byte of a pre-token (bytes where they fit: a tenth of the memory)."""
        got = self.pieces.get(text)
        if got is None:
            if len(self.pieces) > CACHE_ENTRIES:
                self.pieces.clear()
            got = self.vocab.prefix_counts(text.encode())
            if got[-1] < 256:
                got = bytes(got)
            self.pieces[text] = got
        return got

    def _total(self, text: str) -> int:
        return sum(self.piece(p)[-1] for p in self.find(text))

    def count(self, text: str) -> int:
        return sum(1 if known is not None else sum(self.units.of(part, self._total)) for part, known in split_special(text, self.vocab.special))

    def inside(self, piece: str) -> list[int]:
        """Tokens of every prefix of ``piece`` that is encoded as one pre-token, by characters (0 for none)."""
        counts = self.piece(piece)
        if len(counts) == len(piece):
            return [0, *counts]
        out, at = [0], 0
        for c in piece:
            at += len(c.encode())
            out.append(counts[at - 1])
        return out

    def heads(self, piece: str, joint: str | None) -> list[int]:
        """Tokens of every prefix of a part: of one pre-token, or (``joint``) of a special string after other text.

        A head that ends inside a special string is split with what stands before it.
        """
        if joint is not None:
            return [0, *(self._total(joint + piece[:k]) for k in range(1, len(piece))), self._total(joint) + 1]
        if piece in CONTRACTIONS:
            return [0, *(self._total(piece[:k]) for k in range(1, len(piece))), self.piece(piece)[-1]]
        return self.inside(piece)

    def parts(self, text: str):
        """(begin, before, piece, joint, first, least): the table's parts, in order; ``heads`` has a part's counts.

        The first begin + k characters have before + heads[k] tokens, for k from ``first`` to the piece's end.
        Together the parts hold every prefix once. No later part has a count under ``least``.
        """
        at = total = begun = before = 0
        for part, known in split_special(text, self.vocab.special):
            if known is not None:
                yield at, before, part, text[begun:at], 1, before
                total, at = total + 1, at + len(part)
                begun, before = at, total
                continue
            begin, run_end, begun, before = at, 0, at, total
            for m in splitter().finditer(part):
                a, piece = m.start(), m.group()
                if a >= run_end and piece[0].isspace() and (run_end := blank().match(part, a).end()) > a:
                    yield begin + a, total, part[a:run_end], None, 1, before
                z = a + len(piece)
                if z > run_end:
                    begun, before = begin + a, total
                    yield begun, total, piece, None, max(run_end - a, 0) + 1, before
                total += self.piece(piece)[-1]
            at += len(part)

    def table(self, text: str) -> list[int]:
        """The token count of the first k characters, for every k from 0 on."""
        out = [0]
        for _, before, piece, joint, first, _ in self.parts(text):
            out += [before + n for n in self.heads(piece, joint)[first:]]
        return out

    def at(self, text: str, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes alone (cut back to a whole character)."""
        k = len(text.encode()[:n_bytes].decode("utf-8", "ignore"))
        for begin, before, piece, joint, first, _ in self.parts(text) if k else ():
            if begin + first <= k <= begin + len(piece):
                return before + self.heads(piece, joint)[k - begin]
        return 0

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix whose own count stays within the budget.

        Pre-tokens are read up to where none can fit any more; from there back, the first entry that fits is it. Units
        of the text (see ``Units``) whose totals stay within the budget are stepped over, but for the last one.
        """
        begin, total = self.near(text, budget)
        if begin:
            return begin + self.within_part(text[begin:], budget - total)
        return self.within_part(text, budget)

    def near(self, text: str, budget: int) -> tuple[int, int]:
        """(characters, tokens) before the unit that comes before the one in which the budget is spent."""
        if any(s in text for s in self.vocab.special):
            return 0, 0
        first, *rest = text.replace("\n", " \n").split(" ", budget + 2)  # each unit has a token or more
        if not first or first[0].isspace():
            return 0, 0
        at, total, before = len(first), self._total(first), (0, 0)
        try:
            for unit in rest:
                if total > budget:
                    break
                before, unit_total = (at, total), self.units[unit]
                at += len(unit) + (unit[0] != "\n")
                total += unit_total
        except KeyError:  # white space side by side: the pattern has to see it
            return 0, 0
        return before

    def within_part(self, text: str, budget: int) -> int:
        """``within`` without stepping over anything."""
        seen = []
        for part in self.parts(text):
            seen.append(part)
            if part[-1] > budget:
                break
        for begin, before, piece, joint, first, _ in reversed(seen):
            if before <= budget:
                counts = self.heads(piece, joint)
                for k in range(len(counts) - 1, first - 1, -1):
                    if before + counts[k] <= budget:
                        return begin + k
        return 0

    def truncate(self, text: str, budget: int) -> str:
        """The longest run of whole characters from the start whose own count stays within the budget."""
        return text[: self.within(text, budget)]


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def _map(df: DataFrame, schema: str, row):
    def run(batches):
        for b in small(batches):
            out = [row(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), chars_in_limit of every document.

    ``chars_in_limit``: the longest prefix, in characters, of at most ``limit`` tokens.
    """

    def row(i, t):
        n = counter(path).count(t)
        kept = counter(path).within(t, limit) if n > limit else len(t)
        return {"doc_id": i, "n_bytes": len(t.encode()), "n_tokens": n, "over_limit": n > limit, "chars_in_limit": kept}

    return _map(with_text(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long", row)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and prefix_tokens: the token count of the first k characters at index k, from 0 to the whole text."""
    return _map(with_text(docs), "doc_id long, text string, prefix_tokens array<int>", lambda i, t: {"doc_id": i, "text": t, "prefix_tokens": counter(path).table(t)})


def truncate(table: DataFrame, budget: int) -> DataFrame:
    """doc_id, text cut to at most ``budget`` tokens, and n_tokens of what is left; looked up in a ``prefix_table``."""
    good = F.transform("prefix_tokens", lambda n: n <= budget)
    kept = F.size("prefix_tokens") - F.array_position(F.reverse(good), True).cast("int")
    cut = table.withColumn("_kept", kept)
    return cut.select("doc_id", F.substring("text", F.lit(1), F.col("_kept")).alias("text"), F.get("prefix_tokens", F.col("_kept")).cast("long").alias("n_tokens"))
