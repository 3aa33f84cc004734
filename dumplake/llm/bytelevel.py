"""Ids of whole Arrow columns of texts under a byte-level BPE of the tokenizers library, each distinct token encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from dumplake.llm import pretokens
from dumplake.llm.bpe import byte_characters

#: Bytes of text that are cut and looked up together; a longer text goes alone.
STRETCH = 32 << 20
#: Strings that are told apart together at first.
PIECE = 1 << 17
#: Tokens encoded in one call.
TOGETHER = 500

_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}]"
#: As in ``pretokens``: a space beside other white space or at an end of the text.
_ODD = rf"(?:\A|{_BLANK}) | (?:{_BLANK}|\z)"
#: What Arrow's pattern library does not split here: characters on which pattern libraries may differ, white space in a row.
_HARD = r"[^\n -~\x{a1}-\x{24f}]|[\n ][\n ]"
_BEYOND_LATIN = r"[^\x{0}-\x{24f}]"
_MARK = "\x01"
#: How the split pattern ends. Where no two white spaces meet, each of them that no word takes along is a token.
_TAIL = r"\s+(?!\S)|\s+"
_PLAIN = re.compile(r" ?\S+")


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one after the other, and where each begins, with the end of the last."""
    before = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=before[1:])
    small = max(len(values), int(before[-1])) < 2**31
    at = np.repeat((starts - before[:-1]).astype(np.int32 if small else np.int64), lengths)
    at += np.arange(len(at), dtype=at.dtype)
    return values[at], before


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _flatten(lists: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct strings of all lists, the place of each string among them, and where each list begins, with the end of the last.

    Strings are told apart within short pieces first, whose tables are small, then those of all pieces.
    """
    first = _offsets(np.concatenate([_numbers(pc.list_value_length(x)) for x in lists]))
    every = [x.flatten() for x in lists]
    pieces = [x.slice(at, PIECE).dictionary_encode() for x in every for at in range(0, len(x), PIECE)]
    if not pieces:
        return pa.array([], pa.string()), np.empty(0, np.int32), first
    merged = pa.concat_arrays([x.dictionary for x in pieces]).dictionary_encode()
    places, before = merged.indices.to_numpy(), _offsets([len(x.dictionary) for x in pieces])
    return merged.dictionary, np.concatenate([places[at:][x.indices.to_numpy()] for at, x in zip(before.tolist(), pieces)]), first


def _back(last: np.ndarray) -> np.ndarray:
    """Where rows are after those that ``last`` marks were put behind the others."""
    place = np.empty(len(last), np.int64)
    place[np.concatenate((np.flatnonzero(~last), np.flatnonzero(last)))] = np.arange(len(last))
    return place


def _list_column(lists: list[list[str]]) -> pa.Array:
    return pa.array(lists, pa.list_(pa.string()))


class Table:
    """Distinct tokens and their ids, as columns."""

    def __init__(self, tokens: pa.Array | None = None, ids: np.ndarray | None = None, begins: np.ndarray | None = None):
        self.tokens = pa.array([], pa.string()) if tokens is None else tokens
        self.ids = np.empty(0, np.uint32) if ids is None else ids
        self.begins = np.zeros(1, np.int64) if begins is None else begins

    def __len__(self) -> int:
        return len(self.tokens)

    @property
    def held(self) -> int:
        return sum(b.size for b in self.tokens.buffers() if b) + self.ids.nbytes + self.begins.nbytes

    def take(self, which: np.ndarray) -> Table:
        ids, begins = _ragged(self.ids, self.begins[which], self.begins[which + 1] - self.begins[which])
        return Table(self.tokens.take(pa.array(which)), ids, begins)

    def add(self, other: Table) -> Table:
        begins = np.concatenate((self.begins, self.begins[-1] + other.begins[1:]))
        return Table(pa.concat_arrays([self.tokens, other.tokens]), np.concatenate((self.ids, other.ids)), begins)

    def places(self, tokens: pa.Array) -> np.ndarray:
        """Where each token is, -1 where it is not."""
        return _numbers(pc.fill_null(pc.index_in(tokens, value_set=self.tokens), -1)).astype(np.int64)


class ByteLevel:
    """Whole texts by the tokenizers library: split at safe spaces, distinct units split into tokens, distinct tokens encoded.

    ``pattern`` is the split pattern of the tokenizer file. Tokens of Latin letters and signs, which are one match of it
    each, go to the library as the characters that stand for their bytes; it splits them at line feeds and merges them by the
    file's model. Units with characters beyond the Latin ranges, where Unicode versions of pattern libraries may differ, go
    to it unsplit, texts with the name of a special token go to it whole. Of a call, only the table of tokens stays; beyond
    ``pretokens.CACHED_BYTES`` a new one is begun, which takes over from the last what is met again.
    """

    #: No tables of units are kept.
    first = after = ()

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.matches = regex.compile(pattern).findall
        self.columns = pattern.removesuffix(_TAIL) + r"\s" if pattern.endswith(_TAIL) else None
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        self.widths[list(vocab.values())] = [len(t) for t in vocab]
        # The byte 255, which no UTF-8 text has, divides tokens.
        shown = byte_characters() | {255: "\n"}
        self.shown = np.array([ord(shown[b]) for b in range(256)], "<u4")
        self.table, self.older = Table(), Table()

    @property
    def tokens(self) -> list[str]:
        return self.table.tokens.to_pylist()

    @property
    def held(self) -> int:
        return self.table.held

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit integers."""
        out = []
        for ids, starts, ends in self.stretches(pa.array(texts, pa.string())):
            out += [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        return out

    def stretches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of stretches of the texts, in order, with where each text's ids start and end there."""
        before = _offsets(_numbers(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(before, before[at] + STRETCH, side="right")) - 1)
            yield self._column(texts.slice(at, end - at))
            at = end

    def _column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        named = np.zeros(len(texts), bool)
        for s in self.special:
            named |= _numbers(pc.match_substring(texts, s))
        odd = _numbers(pc.match_substring_regex(texts, _ODD)) & ~named
        rows = [np.flatnonzero(~named & ~odd), np.flatnonzero(odd), np.flatnonzero(named)]
        lists = [pc.split_pattern(texts.take(pa.array(rows[0])), " ")]
        if len(rows[1]):
            lists.append(_list_column([pretokens.cut(t) for t in texts.take(pa.array(rows[1])).to_pylist()]))
        units, which, first = self._distinct(lists)
        ids, begins = self._units(units)
        out, before = _ragged(ids, begins[which], (begins[1:] - begins[:-1])[which])
        starts, ends = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        cuttable = np.concatenate(rows[:2])
        starts[cuttable], ends[cuttable] = before[first[:-1]], before[first[1:]]
        if len(rows[2]):
            whole, begins = self._whole(texts.take(pa.array(rows[2])).to_pylist())
            starts[rows[2]], ends[rows[2]] = len(out) + begins[:-1], len(out) + begins[1:]
            out = np.concatenate((out, whole))
        return out, starts, ends

    def _distinct(self, lists: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units, with the space before them unless they head a text; the place of every unit among them; where each text's begin."""
        every, which, first = _flatten(lists)
        heads = first[:-1]
        head = every.take(pa.array(which[heads])).dictionary_encode()
        which[heads] = -1
        used = np.zeros(len(every), bool)
        used[which[which >= 0]] = True
        which[heads] = len(used) + head.indices.to_numpy()
        after = pc.if_else(pa.array(used), pc.binary_join_element_wise("", every, " "), "")
        return pa.concat_arrays([after, head.dictionary]), which, first

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in a row, and where each begins."""
        hard = _numbers(pc.match_substring_regex(units, _HARD)) if self.columns else np.ones(len(units), bool)
        marked = pc.replace_substring_regex(units.filter(pa.array(~hard)), self.columns or "", r"\0" + _MARK)
        split = [self.matches(u) if _latin(u) else [u] for u in units.filter(pa.array(hard)).to_pylist()]
        tokens, which, first = _flatten([pc.split_pattern(marked, _MARK), _list_column(split)])
        found = self._look_up(tokens)
        ids, before = _ragged(found.ids, found.begins[which], (found.begins[1:] - found.begins[:-1])[which])
        order = _back(hard)
        return _ragged(ids, before[first[:-1]][order], (before[first[1:]] - before[first[:-1]])[order])

    def _look_up(self, tokens: pa.Array) -> Table:
        """Distinct tokens with their ids, from the table, the one before it or the library."""
        if self.held > pretokens.CACHED_BYTES:
            self.older, self.table = self.table, Table()
        known = self.table.places(tokens)
        missing = np.flatnonzero(known < 0)
        again = self.older.places(tokens.take(pa.array(missing)))
        old = self.older.take(again[again >= 0])
        new = self._encode(tokens.take(pa.array(missing[again < 0])))
        met = old.add(new)
        place = np.empty(len(tokens), np.int64)
        place[known >= 0] = known[known >= 0]
        place[np.concatenate((missing[again >= 0], missing[again < 0]))] = len(self.table) + np.arange(len(met))
        every = self.table.add(met)
        kept = np.flatnonzero(_numbers(pc.utf8_length(met.tokens)) <= pretokens.LONGEST)
        self.table = every if len(kept) == len(met) else self.table.add(met.take(kept))
        return every.take(place)

    def _encode(self, tokens: pa.Array) -> Table:
        beyond = _numbers(pc.match_substring_regex(tokens, _BEYOND_LATIN))
        latin, others = tokens.filter(pa.array(~beyond)), tokens.filter(pa.array(beyond))
        return Table(latin, *self._tokens(latin)).add(Table(others, *self._unsplit(others.to_pylist()))).take(_back(beyond))

    def _tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Single matches of the split pattern. The widths of the ids say where each token ends."""
        widths = _numbers(pc.binary_length(tokens)).astype(np.int64)
        before, data = _offsets(widths), tokens.buffers()[2]
        offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        if not len(tokens):
            return np.empty(0, np.uint32), before
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        joined = np.full(len(raw) + len(tokens), 255, np.uint8)
        joined[np.arange(len(raw)) + np.repeat(np.arange(len(tokens)), widths)] = raw
        parts = []
        for at in range(0, len(tokens), TOGETHER):
            end = min(at + TOGETHER, len(tokens))
            some = self.shown[joined[before[at] + at : before[end] + end]].tobytes().decode("utf-32-le")
            parts.append(np.array(self.model.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(parts)
        reached = _offsets(self.widths[ids])
        begins = np.searchsorted(reached, before)
        if reached[-1] != before[-1] or (reached[begins] != before).any():
            return self._whole(tokens.to_pylist())
        return ids, begins

    def _unsplit(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that the library splits. Those without inner white space go together, divided by line feeds, each of which is one id of its own."""
        if len(self.feed) != 1 or not all(map(_PLAIN.fullmatch, units)):
            return self._whole(units)
        parts, lengths = [np.empty(0, np.uint32)], []
        for at in range(0, len(units), 10_000):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(units[at : at + 10_000])], add_special_tokens=False)[0].ids, np.uint32)
            feeds = ids == self.feed[0]
            lengths.append(np.diff(np.concatenate(([-1], np.flatnonzero(feeds), [len(ids)]))) - 1)
            parts.append(ids[~feeds])
        return np.concatenate(parts), _offsets(np.concatenate(lengths or [np.empty(0, np.int64)]))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *got]), _offsets([len(x) for x in got])


def _latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0250"
