"""Ids of whole texts under a BPE with word ends, by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Bytes of words and ids in a worker's table; beyond it a new one is begun, which takes over from the last what is met again. Longer
#: words are not kept.
CACHED_BYTES = 64 << 20
LONGEST = 64
#: Words encoded in one call.
TOGETHER = 200

_ASCII_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
# What Python splits at and the library does not count as white space.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
# Letters, then signs: two tokens of the split pattern. The apostrophe starts tokens of its own.
_HEAD_TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class WordEnds:
    """Texts to the bytes of their ids, little-endian unsigned 32-bit integers.

    The tokenizer drops white space, and neither its normaliser nor its split pattern looks beyond it. So the ids of a text
    are those of its words. Words of letters are one token of the split pattern each; many go to the library in one
    text and are cut apart behind the ids that end words. Texts that may name a special token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.held > CACHED_BYTES:
            self.older, self.table, self.held = self.table, {}, 0
        get, read, fresh = self.table.get, [], set()
        for t in texts:
            if "<|" in t:
                read.append((None, [self._whole([t])[0]]))
                continue
            words = _ASCII_BLANKS.split(t) if _SEPARATORS.search(t) else t.split()
            got = list(map(get, words))
            if None in got:
                fresh.update([w for w, g in zip(words, got) if g is None])
                read.append((words, got))
            else:
                read.append((None, [b"".join(got)]))
        again = fresh.intersection(self.older)
        found = self._words(fresh - again) | {w: self.older[w] for w in again}
        out = [b"".join(got if words is None else [g if g is not None else found[w] for w, g in zip(words, got)]) for words, got in read]
        for w in [w for w in found if len(w) > LONGEST]:
            del found[w]
        self.table.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + 150 * len(found)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: set[str]) -> dict[str, bytes]:
        rest = [w for w in words if not w.isalpha()]
        split, other = {}, []
        for w in rest:
            # A letter whose lower case is more than letters would join the signs behind it.
            if (m := _HEAD_TAIL.fullmatch(w)) and m[1].lower().isalpha():
                split[w] = m.groups()
            else:
                other.append(w)
        plain = set(words.difference(rest))
        plain.update([h for h, _ in split.values() if h not in self.table])
        tails = [t for t in {t for _, t in split.values()} if t not in self.table]
        out = dict(zip(other + tails, self._whole(other + tails)))
        plain = list(plain)
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(some):  # each word has one end at least, so some word is more than one token to the library
                out.update(zip(some, self._whole(some)))
                continue
            raw = ids.tobytes()
            out.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        for w, (h, t) in split.items():
            out[w] = (out[h] if h in out else self.table[h]) + (out[t] if t in out else self.table[t])
        return out


@lru_cache(maxsize=2)
def word_ends(path: str) -> WordEnds:
    return WordEnds(path)
