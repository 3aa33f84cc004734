"""Small helpers for Arrow batches that stream through a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def segments(batch: pa.RecordBatch):
    """Stretches of one (file, block) within a batch, in order."""
    files = pc.dictionary_encode(batch.column("file"))
    index = files.indices.to_numpy(zero_copy_only=False)
    block = batch.column("block").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(index) != 0) | (np.diff(block) != 0)) + 1
    bounds = [0, *cuts.tolist(), len(block)]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            yield (files.dictionary[index[lo]].as_py(), int(block[lo])), batch.slice(lo, hi - lo)


def as_text(values: list[bytes | None]) -> pa.Array:
    """A string column of exactly these bytes, valid UTF-8 or not."""
    return pa.array(values, pa.binary()).view(pa.string())


def as_bytes(column: pa.Array, i: int) -> bytes:
    """The bytes of one value of a string column."""
    return column.slice(i, 1).cast(pa.binary())[0].as_py()


def stretches(batch: pa.RecordBatch, column: int, most: int):
    """The batch in slices whose texts in ``column`` have at most ``most`` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
