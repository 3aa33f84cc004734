"""Ids of whole texts by way of their distinct space-separated units, so that a task encodes each unit once."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space beside other white space or at an end of the text: there a cut before the space is not safe.
_ODD = re.compile(r"(?:\A|\s) | (?:\s|\Z)")
#: Bytes of units, tokens and ids in a worker's tables; beyond it new ones are begun, which take over from the last what is met again.
#: Longer units are not kept.
CACHED_BYTES = 64 << 20
LONGEST = 100


class Units:
    """Texts to the bytes of their ids, little-endian unsigned 32-bit integers.

    The common split pattern of byte-level vocabularies never matches across the place between a
    character that is not white space and a single space before another such character. So a text cut there has
    the ids of its parts. ``split`` gives the tokens of a part, ``encode`` the ids of tokens, as bytes; parts and tokens
    that were met before are looked up.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]]):
        self.split, self.encode = split, encode
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], ...] = ({}, {}, {})
        self.held = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.held > CACHED_BYTES:
            self.older, self.held = (self.first, self.after, self.tokens), 0
            self.first, self.after, self.tokens = {}, {}, {}
        parts = [t.split(" ") if not _ODD.search(t) else cut(t) for t in texts]
        heads, rest = {p[0] for p in parts}, set()
        for p in parts:
            rest.update(p[1:])
        fresh_heads = self._take(self.first, 0, heads)
        fresh_rest = self._take(self.after, 1, rest)
        split = [self.split(x) for x in fresh_heads] + [self.split(" " + x) for x in fresh_rest]
        fresh = self._take(self.tokens, 2, set().union(*split))
        self._add(self.tokens, fresh, self.encode(fresh))
        found = [b"".join(map(self.tokens.__getitem__, s)) for s in split]
        self._add(self.first, fresh_heads, found[: len(fresh_heads)])
        self._add(self.after, fresh_rest, found[len(fresh_heads) :])
        out = [self.first[p[0]] + b"".join(map(self.after.__getitem__, p[1:])) for p in parts]
        for table, fresh_units in ((self.tokens, fresh), (self.first, fresh_heads), (self.after, fresh_rest)):
            for unit in [u for u in fresh_units if len(u) > LONGEST]:
                self.held -= len(unit) + len(table.pop(unit)) + 150
        return out

    def _take(self, table: dict[str, bytes], which: int, units: set[str]) -> list[str]:
        """The units that neither ``table`` nor the one before it has; what only the latter has moves on."""
        units.difference_update(table)
        again = units.intersection(self.older[which])
        self._add(table, again, map(self.older[which].__getitem__, again))
        return list(units.difference(again))

    def _add(self, table: dict[str, bytes], units, ids) -> None:
        for u, i in zip(units, ids):
            table[u] = i
            self.held += len(u) + len(i) + 150


def cut(text: str) -> list[str]:
    """Split at the safe spaces only."""
    return re.split(r"(?<=\S) (?=\S)", text)
