"""Token ids as range asymmetric numeral systems: sections with a shared frequency table, independent blocks, checkpoints.

File format, all numbers little-endian. A file is a row of sections, each followed by a line feed. A section is

* ``RANS``, then as 64-bit numbers: bytes of the section, number of the part, number within the part, documents, ids, blocks,
  bits of the frequencies, symbols, bytes of the packed table, crc32 of all that stands before the blocks after this header;
* the ids of its documents (signed 64-bit; the smallest long is null) and their lengths (unsigned 32-bit);
* the zlib-packed table: the symbols that occur, ascending, then their frequencies, which add up to two to the power of the bits;
* for every block, as 64-bit numbers: ids, 32-bit words, checkpoints, crc32 of its ids as unsigned 32-bit integers;
* the blocks: the 64-bit states of all lanes, for each checkpoint the step, the word it reads next and the states there,
  then the words.

Id ``i`` of a block belongs to lane ``i mod LANES``; all lanes read one stream of words, in the order of the lanes within a step. The
table is shared by the blocks of a section; a section holds a bounded number of ids, so a lost task repeats only its
own part, and a block decodes without any other, from its start or from a checkpoint.

Defined results: a null text is an empty text and has the end id alone; documents go in ascending order of ids, null ids first; rows
that share an id all stay, in the order of the table; an empty table gives files without sections and no rows back.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumplake.llm.bytelevel import ByteLevel
from dumplake.llm.frames import text_or_empty

LANES = 2048
BLOCK = 1 << 20
#: Steps of all lanes between two checkpoints of a block.
CHECKPOINT = 256
#: Ids of a section; one document with more ids is a section of its own.
SECTION = 1 << 21
#: Text of a part, and sections in a file: what one task holds when it writes and when it reads.
PART_BYTES = 24 << 20
FILE_SECTIONS = 4
#: Below it ids are counted in an array instead of sorted.
DENSE = 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4s10Q")
_NULL = -(2**63)


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols that occur, their frequencies (at least 1, a power of two in all), and the bits of that power."""
    if ids.max() < DENSE:
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts = every[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    bits = max(16, int(len(symbols)).bit_length() + 3)
    whole = 1 << bits
    freq = np.maximum(1, counts * whole // counts.sum())
    over = int(freq.sum()) - whole
    if over < 0:
        freq[np.argmax(freq)] -= over
    for at in np.argsort(-freq, kind="stable"):
        if over <= 0:
            break
        take = min(over, int(freq[at]) // 2)
        freq[at] -= take
        over -= take
    return symbols.astype(np.uint32), freq.astype(np.uint64), bits


def encode_block(places: np.ndarray, freq: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, list, np.ndarray]:
    """First states of the decoder, checkpoints (step, next word, states), and the words. ``places`` index the table."""
    f, c, n = freq[places], low[places], len(places)
    states, shift, top = np.full(LANES, _LOW), np.uint64(bits), np.uint64(63 - bits)
    steps = -(-n // LANES)
    words, saved = [np.empty(0, np.uint32)] * steps, []
    for t in range(steps - 1, -1, -1):
        at = t * LANES
        ft = f[at : at + LANES]
        x = states[: len(ft)]
        full = x >= (ft << top)
        words[t] = x[full].astype(np.uint32)
        x[full] >>= _WORD
        q = x // ft
        states[: len(ft)] = (q << shift) + (x - q * ft) + c[at : at + LANES]
        if t and t % CHECKPOINT == 0:
            saved.append((t, states.copy()))
    before = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    return states, [(t, int(before[t]), s) for t, s in reversed(saved)], np.concatenate(words) if words else np.empty(0, np.uint32)


def decode_steps(states: np.ndarray, words: np.ndarray, n: int, table, bits: int) -> tuple[np.ndarray, bool]:
    """``n`` table places from these states on, and whether all lanes end as they began when they were encoded.

    ``words`` starts with the word that is read next.
    """
    slots, freq, low = table
    states, mask, shift, at = states.copy(), np.uint64((1 << bits) - 1), np.uint64(bits), 0
    out = np.empty(n, slots.dtype)
    for start in range(0, n, LANES):
        k = min(LANES, n - start)
        x = states[:k]
        slot = x & mask
        s = slots[slot]
        out[start : start + k] = s
        x = freq[s] * (x >> shift) + slot - low[s]
        need = np.flatnonzero(x < _LOW)
        more = words[at : at + len(need)]
        if len(more) < len(need):
            return out, False
        x[need] = (x[need] << _WORD) | more
        at += len(need)
        states[:k] = x
    return out, bool((states == _LOW).all()) and at == len(words)


def encode_section(part: int, number: int, keys: list[int], ids: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in ids], np.uint32)
    every = np.concatenate(ids).astype(np.uint32)
    symbols, freq, bits = table_of(every)
    low = np.cumsum(freq) - freq
    if symbols[-1] < DENSE:
        at = np.zeros(int(symbols[-1]) + 1, np.int64)
        at[symbols] = np.arange(len(symbols))
        places = at[every]
    else:
        places = np.searchsorted(symbols, every)
    packed = zlib.compress(symbols.tobytes() + freq.astype("<u4").tobytes())
    directory, blocks = [], []
    for at in range(0, len(every), BLOCK):
        states, saved, words = encode_block(places[at : at + BLOCK], freq, low, bits)
        part_ids = every[at : at + BLOCK]
        directory += [len(part_ids), len(words), len(saved), zlib.crc32(part_ids.astype("<u4").tobytes())]
        blocks.append(states.astype("<u8").tobytes())
        blocks += [struct.pack("<QQ", t, w) + s.astype("<u8").tobytes() for t, w, s in saved]
        blocks.append(words.astype("<u4").tobytes())
    front = np.array(keys, "<i8").tobytes() + lengths.astype("<u4").tobytes() + packed + np.array(directory, "<u8").tobytes()
    body = b"".join(blocks)
    size = _HEAD.size + len(front) + len(body)
    return _HEAD.pack(b"RANS", size, part, number, len(keys), len(every), len(directory) // 4, bits, len(symbols), len(packed), zlib.crc32(front)) + front + body


class Section:
    """A section of a file, opened but not decoded."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.size, self.part, self.number, n_docs, self.n_ids, n_blocks, self.bits, n_symbols, packed, crc = _HEAD.unpack_from(data, at)
        if magic != b"RANS":
            raise ValueError(f"no section at byte {at}")
        front = at + _HEAD.size
        self.keys = np.frombuffer(data, "<i8", n_docs, front)
        self.lengths = np.frombuffer(data, "<u4", n_docs, front + 8 * n_docs)
        table = front + 12 * n_docs
        self.directory = np.frombuffer(data, "<u8", 4 * n_blocks, table + packed).reshape(-1, 4).astype(np.int64)
        end = table + packed + 32 * n_blocks
        if zlib.crc32(data[front:end]) != crc:
            raise ValueError(f"the section at byte {at} is damaged")
        raw = zlib.decompress(data[table : table + packed])
        self.symbols, freq = np.frombuffer(raw, "<u4", n_symbols), np.frombuffer(raw, "<u4", n_symbols, 4 * n_symbols).astype(np.uint64)
        self.table = (np.repeat(np.arange(n_symbols, dtype=np.int32), freq.astype(np.int64)), freq, np.cumsum(freq) - freq)
        sizes = 8 * LANES + self.directory[:, 2] * (16 + 8 * LANES) + 4 * self.directory[:, 1]
        self.data, self.starts = data, end + np.concatenate(([0], np.cumsum(sizes)))

    def block(self, b: int, checkpoint: int | None = None) -> np.ndarray:
        """Ids of block ``b``, verified; with a checkpoint only those from there on, verified by the last states alone."""
        n, n_words, n_saved, crc = (int(x) for x in self.directory[b])
        at = int(self.starts[b])
        states, word, first = np.frombuffer(self.data, "<u8", LANES, at), 0, 0
        if checkpoint is not None:
            saved = at + 8 * LANES + checkpoint * (16 + 8 * LANES)
            step, word = struct.unpack_from("<QQ", self.data, saved)
            states, first = np.frombuffer(self.data, "<u8", LANES, saved + 16), step * LANES
        words = np.frombuffer(self.data, "<u4", n_words, at + 8 * LANES + n_saved * (16 + 8 * LANES))[word:]
        places, whole = decode_steps(states, words, n - first, self.table, self.bits)
        ids = self.symbols[places] if whole else places
        if not whole or checkpoint is None and zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {b} of section {self.part}/{self.number} is damaged")
        return ids

    def documents(self) -> list[np.ndarray]:
        every = np.concatenate([self.block(b) for b in range(len(self.directory))]) if len(self.directory) else np.empty(0, np.uint32)
        return np.split(every, np.cumsum(self.lengths.astype(np.int64))[:-1]) if len(self.lengths) else []


def sections(data: bytes):
    at = 0
    while at < len(data):
        section = Section(data, at)
        yield section
        at += section.size + 1


# --- tokens -----------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def tokenizer_units(path: str, pattern: str) -> ByteLevel:
    """One for each worker process; the tokenizer file is at the same path on every executor."""
    return ByteLevel(path, pattern)


def _row(section: bytes) -> pa.RecordBatch:
    return pa.record_batch({"value": pa.array([section], pa.binary())})


def write_ids(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0) -> None:
    """Tokenise whole texts and write their ids, ``end_id`` after each, to ``path`` in ascending order of ids.

    Texts are dealt by ranges of their id once; a task then tokenises and encodes its range in order.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.monotonically_increasing_id().alias("r"), text_or_empty().alias("text"))
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    end = np.array([end_id], np.uint32)

    def encode(batches):
        units, part, number = tokenizer_units(tokenizer, pattern), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0
        for batch in batches:
            of = iter(batch.column(0).to_pylist())
            for every, starts, ends in units.stretches(batch.column(1).cast(pa.string())):
                for a, b in zip(starts.tolist(), ends.tolist()):
                    keys.append(next(of))
                    ids.append(np.concatenate((every[a:b], end)))
                    held += len(ids[-1])
                    if held >= SECTION:
                        yield _row(encode_section(part, number, keys, ids))
                        keys, ids, held, number = [], [], 0, number + 1
        if keys:
            yield _row(encode_section(part, number, keys, ids))

    # The row number splits the rows of one hot id, too.
    ranged = rows.repartitionByRange(int(parts), "k", "r").sortWithinPartitions("k", "r").select("k", "text")
    ranged.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value")).write.option(
        "lineSep", "\n").option("maxRecordsPerFile", FILE_SECTIONS).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``part, section, place, doc_id, n_tokens, ids``: the documents of all files, decoded and verified.

    ``place`` is the number of ids before a document in its section, ``ids`` are unsigned 32-bit integers.
    """

    def decode(batches):
        for pdf in batches:
            for data in pdf["content"]:
                for s in sections(bytes(data)):
                    docs = s.documents()
                    place = np.cumsum(s.lengths.astype(np.int64)) - s.lengths
                    for at in range(0, len(docs), 500):
                        some = docs[at : at + 500]
                        yield pd.DataFrame({
                            "part": s.part, "section": s.number, "place": place[at : at + 500], "key": s.keys[at : at + 500],
                            "n_tokens": [len(x) for x in some], "ids": [x.astype("<u4").tobytes() for x in some]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(
        decode, "part long, section long, place long, key long, n_tokens long, ids binary")
    return rows.withColumn("doc_id", F.when(F.col("key") != _NULL, F.col("key"))).drop("key")


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_ids`` with ``start``: ids of all documents before. Adds up one row per section, then one per part."""
    each = rows.groupBy("part", "section").agg(F.sum("n_tokens").alias("n"))
    parts = each.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = each.select("part", "section", (F.sum("n").over(Window.partitionBy("part").orderBy("section")) - F.col("n")).alias("inside"))
    starts = inner.join(parts, "part").select("part", "section", (F.col("before") + F.col("inside")).alias("first"))
    return rows.join(starts, ["part", "section"]).withColumn("start", F.col("first") + F.col("place")).drop("first")
