"""Cut VALUES lists into tuples and literals on the bytes of whole Arrow columns, without a loop over rows.

Which bytes lie in a quoted string follows from the quotes alone: each is a function on three states (outside, in a single-, in a
double-quoted string), and functions are composed along a text. Nesting follows from the parentheses outside strings. So a
text that starts in the middle of a list needs only its state and depth there, which a summary of the texts before it gives.
Marks take many times the memory of their text, so callers go along a column in stretches and one long text is cut in stretches too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Classes of bytes.
_SINGLE, _DOUBLE, _OPEN, _CLOSE, _COMMA, _SLASH, _OTHER, _BLANK = 1, 2, 3, 4, 5, 6, 7, 0
_CLASS = np.full(256, _OTHER, np.uint8)
for _byte, _kind in zip(b"'\"(),\\", (_SINGLE, _DOUBLE, _OPEN, _CLOSE, _COMMA, _SLASH)):
    _CLASS[_byte] = _kind
_CLASS[list(b" \t\n\r\x0b\x0c\0")] = _BLANK

_CLASS_OF = _CLASS.tobytes()

# Bytes of text that are looked at in one go.
STRETCH_BYTES = 2 << 20

# NEXT[kind][state]: state after an unescaped quote.
_NEXT = np.array([[0, 1, 2], [1, 0, 2], [2, 1, 0]], np.int8)


def _after_quotes(kinds: np.ndarray, first: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """State after each quote of ``kinds`` (1 or 2). ``first`` marks the first quote of a row, ``entry`` the state its row starts in."""
    n = len(kinds)
    if not n:
        return np.empty(0, np.int8)
    if not (kinds == _DOUBLE).any() and not entry.any():
        run = np.arange(1, n + 1)
        start = np.maximum.accumulate(np.where(first, run, 0))
        return ((run - start + 1) & 1).astype(np.int8)
    maps = _NEXT[kinds]
    maps[first] = _NEXT[kinds[first], entry[first]][:, None]
    # The first of a row gives one state whatever came before, so stretches longer than a row's quotes need no look.
    longest = int(np.diff(np.append(np.flatnonzero(first), n)).max())
    step = 1
    while step < longest:  # compose with the function that ends just before, over doubling stretches
        at = np.arange(3 * step, 3 * n, 3)[:, None] + maps[:-step]
        maps[step:] = maps.ravel()[at]
        step *= 2
    return maps[:, 0]


@dataclass
class _Marks:
    """Positions of the bytes that matter, outside strings, in a column of texts laid end to end."""

    data: np.ndarray
    starts: np.ndarray   # first byte of each row
    ends: np.ndarray     # one past its last byte
    at: np.ndarray       # parentheses and commas outside strings
    kind: np.ndarray
    row: np.ndarray      # row of each of them
    level: np.ndarray    # depth after each of them
    bad: np.ndarray      # count, up to each byte, of bytes outside strings that no list has between tuples
    exit_state: np.ndarray


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _marks(column: pa.Array, entry_state: np.ndarray, entry_depth: np.ndarray) -> _Marks:
    data, bounds = _bytes_of(column)
    starts, ends = bounds[:-1], bounds[1:]
    kinds = np.frombuffer(bytearray(data).translate(_CLASS_OF), np.uint8)
    slashes = np.flatnonzero(kinds == _SLASH)
    if len(slashes):
        # Every second backslash of a run, from its first, escapes the byte after it.
        fresh = np.ones(len(slashes), bool)
        fresh[1:] = np.diff(slashes) != 1
        nth = np.arange(len(slashes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))
        escaped = slashes[nth % 2 == 0] + 1
        escaped = escaped[escaped < len(data)]
        kinds[np.setdiff1d(escaped, starts)] = _OTHER
        kinds[kinds == _SLASH] = _OTHER
    at = np.flatnonzero((kinds - np.uint8(_SINGLE)) <= _COMMA - _SINGLE)
    kind = kinds[at]
    row = np.searchsorted(ends, at, side="right")
    quote = kind <= _DOUBLE
    q_at, q_row = at[quote], row[quote]
    first = np.ones(len(q_at), bool)
    first[1:] = np.diff(q_row) != 0
    after = _after_quotes(kind[quote], first, entry_state[q_row])
    # State before each mark: after the last quote before it in its row, else that of its row.
    n_quotes = np.cumsum(quote)
    last = np.where(quote, n_quotes - 2, n_quotes - 1)
    known = last >= 0
    state = entry_state[row].astype(np.int8)
    if len(q_at):
        same = known & (q_row[np.maximum(last, 0)] == row)
        state[same] = after[last[same]]
    # Bytes inside strings: between a quote that opens and the one that closes, both included.
    inside = np.zeros(len(data) + 1, np.int8)
    if len(q_at):
        before = state[quote]
        opens, closes = (before == 0), (after == 0) & (before != 0)
        inside[q_at[opens]] += 1
        inside[q_at[closes] + 1] -= 1
    exit_state = entry_state.astype(np.int8).copy()
    if len(q_at):
        exit_state[q_row] = after  # the last of a row stays
    open_in = np.flatnonzero(entry_state)
    np.add.at(inside, starts[open_in], 1)
    np.add.at(inside, ends[np.flatnonzero(exit_state)], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    keep = ~quote & (state == 0)
    at, kind, row = at[keep], kind[keep], row[keep]
    change = np.where(kind == _OPEN, 1, np.where(kind == _CLOSE, -1, 0))
    total = np.cumsum(change)
    base = np.zeros(len(starts), np.int64)
    head = np.searchsorted(row, np.arange(len(starts)))
    some = head > 0
    base[some] = total[np.minimum(head[some], len(total)) - 1] if len(total) else 0
    level = total - base[row] + entry_depth[row]
    # In a string, quotes included, every byte is other; between tuples only blanks and one comma may stand.
    inside |= (kinds == _OTHER) | (kinds == _SINGLE) | (kinds == _DOUBLE)
    bad = np.cumsum(inside, dtype=np.int32)
    return _Marks(data, starts, ends, at, kind, row, level, bad, exit_state)


def _between(counts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Count in bytes lo..hi-1 of a running count."""
    return np.where(hi > 0, counts[np.maximum(hi - 1, 0)], 0) - np.where(lo > 0, counts[np.maximum(lo - 1, 0)], 0) if len(counts) else np.zeros_like(lo)


def _tuples(m: _Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Open and close marks of the complete tuples of each row's list, their rows, and where each list ends."""
    opens = np.flatnonzero((m.kind == _OPEN) & (m.level == 1))
    closes = np.flatnonzero((m.kind == _CLOSE) & (m.level == 0))
    # In order within a row they alternate up to the first fault.
    below = np.flatnonzero((m.kind == _CLOSE) & (m.level < 0))
    both = np.concatenate([opens, closes, below])
    order = np.argsort(both, kind="stable")
    mark, is_open, is_below = both[order], order < len(opens), order >= len(opens) + len(closes)
    row = m.row[mark]
    new_row = np.ones(len(mark), bool)
    new_row[1:] = row[1:] != row[:-1]
    previous = np.where(new_row, m.starts[row], m.at[mark[np.maximum(np.arange(len(mark)) - 1, 0)]] + 1) if len(mark) else mark
    commas = np.concatenate([[0], np.cumsum(m.kind == _COMMA)])
    gap_bad = (_between(m.bad, previous, m.at[mark]) > 0) | (commas[mark] - commas[np.searchsorted(m.at, previous)] > 1)
    follows = np.zeros(len(mark), bool)
    follows[1:] = is_open[:-1] & ~new_row[1:]
    wrong = np.where(is_open, gap_bad | follows, ~follows) | is_below
    fault = np.cumsum(wrong)
    start = np.maximum.accumulate(np.where(new_row, np.arange(len(mark)), 0)) if len(mark) else mark
    clean = (fault - fault[start] + wrong[start]) == 0 if len(mark) else wrong
    good = np.flatnonzero(~is_open & clean)
    stops = m.starts.copy()
    np.maximum.at(stops, row[good], m.at[mark[good]] + 1)
    return mark[good - 1], mark[good], row[good], stops


def _literals(m: _Marks) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The literals of each tuple, the row of each tuple, and where the list of each row ends."""
    opened, closed, row, stops = _tuples(m)
    # Separators of literals: the commas at depth one inside the tuples.
    tuple_of = np.searchsorted(opened, np.arange(len(m.at)), side="right") - 1
    inner = (m.kind == _COMMA) & (m.level == 1) & (tuple_of >= 0)
    inner[inner] = np.flatnonzero(inner) < closed[tuple_of[inner]]
    cuts = np.flatnonzero(inner)
    first, last = m.at[opened] + 1, m.at[closed]
    # Bytes of literals, laid end to end without what stands between them.
    change = np.zeros(len(m.data) + 1, np.int8)
    change[first] += 1
    change[last] -= 1
    kept = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    kept[m.at[cuts]] = False
    text = m.data[kept]
    begins, ends = np.sort(np.concatenate([first, m.at[cuts] + 1])), np.sort(np.concatenate([m.at[cuts], last]))
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    per_tuple = np.bincount(tuple_of[cuts], minlength=len(opened)) + 1 if len(opened) else np.empty(0, np.int64)
    items = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_tuple)]).astype(np.int32)), items), row, stops


def _one_text(data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data))


def _cut_long(column: pa.Array, stretch: int) -> tuple[pa.Array, pa.Array]:
    """``cut_lists`` of one long text. After a whole tuple the rest is a list like any other, so each look starts where the last tuple ended."""
    data, at, step, found = _bytes_of(column)[0], 0, stretch, []
    while True:
        one = np.zeros(1, np.int64)
        tuples, _, stops = _literals(_marks(_one_text(data[at : at + step]), one, one))
        found.append(tuples)
        whole, at = at + step >= len(data), at + int(stops[0])
        if whole:
            break
        step = stretch if stops[0] else 2 * step  # no tuple ends here: look further
    tuples = pa.concat_arrays(found)
    return pa.ListArray.from_arrays(pa.array([0, len(tuples)], pa.int32()), tuples), _one_text(data[at:]).cast(pa.string())


def cut_lists(column: pa.Array, stretch: int = STRETCH_BYTES) -> tuple[pa.Array, pa.Array]:
    """For texts that start with a VALUES list: the literals of each tuple, and what follows the list.

    A list ends where something other than blanks and one comma stands between tuples, or where a tuple stays open.
    """
    if len(column) == 1 and (pc.binary_length(column)[0].as_py() or 0) > stretch:
        return _cut_long(column, stretch)
    zero = np.zeros(len(column), np.int64)
    m = _marks(column, zero, zero)
    tuples, row, stops = _literals(m)
    n_rows = len(m.starts)
    per_row = np.bincount(row, minlength=n_rows)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), tuples)
    lengths = m.ends - stops
    left = np.flatnonzero(lengths)
    after_kept = np.zeros(len(m.data) + 1, np.int8)
    after_kept[stops[left]] += 1
    after_kept[m.ends[left]] -= 1
    rest = m.data[np.cumsum(after_kept[:-1], dtype=np.int8).astype(bool)]
    after = pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(rest))
    return lists, after.cast(pa.string())


# --- parts of one list ----------------------------------------------------------------------------

def summarise(text: bytes) -> list[tuple[int, int, int, list[int]]]:
    """What a part of a list does, for each of the three states it may start in.

    (state after it, change of depth, lowest change on the way, the changes at which something that ends a list stands outside
    strings while no lower change came before).
    """
    column, out = pa.array([text], pa.large_binary()), []
    for state in range(3):
        m = _marks(column, np.array([state]), np.zeros(1, np.int64))
        others = _outside_others(m)
        level_at = np.concatenate([[0], m.level])[np.searchsorted(m.at, others)]
        lowest = np.minimum.accumulate(np.concatenate([[0], m.level]))
        ends = np.unique(level_at[level_at == lowest[np.searchsorted(m.at, others)]])
        delta, low = (int(m.level[-1]), int(lowest[-1])) if len(m.level) else (0, 0)
        out.append((int(m.exit_state[0]), delta, low, ends.tolist()))
    return out


def _outside_others(m: _Marks) -> np.ndarray:
    """Positions of bytes that may not stand between tuples (a string's own bytes count at its opening depth)."""
    return np.flatnonzero(np.diff(m.bad, prepend=0) > 0)


def advance(summary: list[tuple[int, int, int, list[int]]], state: int, depth: int) -> tuple[int, int, bool]:
    """State and depth after a part, and whether the list ended inside it."""
    after, delta, low, ends = summary[state]
    return after, depth + delta, depth + low < 0 or -depth in ends


def cut_part(text: bytes, state: int, depth: int) -> tuple[bytes, bytes, bytes, bytes]:
    """A part of a list cut at its tuples: the rest of the tuple it starts in, its whole tuples, a tuple it leaves open, what follows the list.

    A part inside one tuple is all first piece.
    """
    m = _marks(pa.array([text], pa.large_binary()), np.array([state]), np.array([depth]))
    lead = 0
    if depth > 0:
        closes = np.flatnonzero((m.kind == _CLOSE) & (m.level == 0))
        if not len(closes):
            return text, b"", b"", b""
        lead = int(m.at[closes[0]]) + 1
    rest = text[lead:]
    r = _marks(pa.array([rest], pa.large_binary()), np.zeros(1, np.int64), np.zeros(1, np.int64))
    stop = int(_tuples(r)[3][0])
    tail = rest[stop:]
    start = len(tail) - len(tail.lstrip(b" \t\n\r\x0b\x0c\0,"))
    left_open = tail[start : start + 1] == b"(" and not len(np.flatnonzero((r.at >= stop) & (r.level <= 0)  & (r.kind == _CLOSE)))
    return text[:lead], rest[:stop], tail[start:] if left_open else b"", b"" if left_open else tail[start:]
