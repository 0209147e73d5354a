"""Byte-level BPE on one pre-token, prefix dynamic programming over it, and fast exact pre-tokenisation.

Vocabularies are read from files whose path is a parameter; workers keep one instance per path.
"""

from __future__ import annotations

import base64
import functools
import json

import ahocorasick
import regex

#: Fixed value: the public pattern that splits text before merges.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
#: Entries in each of the two generations of a worker's cache; bounds a worker's memory, never changes results.
CACHE_ENTRIES = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes with merge ranks. ``ids`` maps bytes to ids, ``ranks`` maps bytes to merge order."""

    def __init__(self, ids: dict[bytes, int], ranks: dict[bytes, int], special: dict[str, int] | None = None):
        self.ids, self.ranks, self.special = ids, ranks, special or {}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._alone: dict[bytes, bool] = {}

    @classmethod
    @functools.cache
    def load(cls, path: str) -> "Vocabulary":
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            return cls(ranks, ranks)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks: dict[bytes, int] = {}
        for n, (a, b) in enumerate(merges):
            ranks.setdefault(raw(a) + raw(b), n)
        return cls(ids, ranks, special)

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Plain greedy merging until ``stop`` parts are left; only used on single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            ranks = [self.ranks.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:], strict=False)]
            best = ranks.index(min(ranks))
            if ranks[best] == 1 << 60:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self._halves:
            parts = self.merge(token, 2) if len(token) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def alone(self, token: bytes) -> bool:
        """Whether encoding the token's bytes gives that token back."""
        if token not in self._alone:
            self._alone[token] = self.merge(token) == [token]
        return self._alone[token]

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether merging a+b leaves exactly the tokens a and b.

        Greedy merging would join across the border only if, at some time, the parts that touch it have a merge that
        comes before the merges that made them part of a and b. So the younger of the two is undone step by step.
        """
        if not a:
            return self.alone(b)
        rank, x, y = self.ranks.get, a, b
        limit = 1 << 60
        while True:
            if (r := rank(x + y)) is not None and r < limit:
                return False
            rx, ry = (rank(x, -1) if len(x) > 1 else -1), (rank(y, -1) if len(y) > 1 else -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:  # x was made last: before that its right half touched y
                limit, x = rx, self.halves(x)[1]
            else:  # on equal ranks the left one is merged first, so y's left half stood beside x
                limit, y = ry + 1, self.halves(y)[0]

    @functools.cached_property
    def matcher(self):
        """Finds all tokens that end at each byte, the longest first; bytes stand as the characters 0 to 255."""
        found = ahocorasick.Automaton()
        for t, i in self.ids.items():
            found.add_word(t.decode("latin-1"), (len(t), i, t))
        found.make_automaton()
        return found.iter

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of every prefix of a pre-token, by dynamic programming over the last token.

        The encoding of a prefix ends in the one token t for which the prefix before t ends in a token that
        merging keeps apart from t; so count[i] = count[i - len(t)] + 1.
        """
        n = len(piece)
        last, count, text = [-1] * (n + 1), [0] * (n + 1), [b""] * (n + 1)
        pairs = self._pairs
        for end, (size, i, t) in self.matcher(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start and last[start] < 0:
                raise ValueError("a byte is missing from the vocabulary")
            key = (last[start] + 1 << 24) + i
            good = pairs.get(key)
            if good is None:
                if len(pairs) > 4 * CACHE_ENTRIES:
                    pairs.clear()
                good = pairs[key] = self.apart(text[start], t)
            if good:
                last[end], count[end], text[end] = i, count[start] + 1, t
        if last[n] < 0:
            raise ValueError("a byte is missing from the vocabulary")
        return count[1:]


@functools.cache
def splitter() -> "regex.Pattern":
    return regex.compile(PATTERN)


class Units(dict):
    """Cache from a unit of text to ``value(unit)``; irregular units raise KeyError.

    A text is cut before each single space or newline that a visible character follows. Such a place is always a
    pre-token boundary, and the pattern matches alike on either side of it, so each unit can be split and encoded
    alone. Where white space lies side by side, the pattern has to see the whole text. Keys are what split(' ')
    leaves: the space before a unit is implied, a newline is kept.
    """

    def __init__(self, value, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.value, self.limit, self.old = value, limit, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            body = key[1:] if key[:1] == "\n" else key
            if not body or body[0].isspace():
                raise KeyError(key)
            got = self.value(key if key[0] == "\n" else " " + key)
        if len(self) >= self.limit:  # what was not asked for since the last time goes
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got

    def of(self, text: str, whole):
        """The values of a text's units in order; ``whole(text)`` where units can't be cut."""
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[0].isspace():
            return [whole(text)]
        try:
            return [self.value(first), *map(self.__getitem__, rest)]
        except KeyError:
            return [whole(text)]


def split_special(text: str, special: dict[str, int]) -> list[tuple[str, int | None]]:
    """Parts of a text between special strings, and the special ids themselves."""
    parts: list[tuple[str, int | None]] = [(text, None)]
    for name, i in special.items():
        if name in text:
            cut: list[tuple[str, int | None]] = []
            for part, known in parts:
                if known is not None:
                    cut.append((part, known))
                    continue
                for k, piece in enumerate(part.split(name)):
                    cut += [(name, i)] * bool(k) + [(piece, None)] * bool(piece)
            parts = cut
    return parts
