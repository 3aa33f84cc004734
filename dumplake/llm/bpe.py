"""Byte-level BPE encoding and decoding with a sentencepiece model made straight from a rank file.

The model is written field by field: every token becomes a normal piece of byte-mapped characters (the usual
printable stand-ins for bytes) whose score is its negative rank, the normaliser is the identity, and nothing is added
to a text. Merging the pair with the highest score first is then merging by lowest rank. Each match of the split
pattern is encoded on its own; a match that is a token as a whole is that token. Decoding maps the
characters of the pieces back to bytes.

Defined results: a null text is an empty text, which has no ids and decodes to no bytes; repeated rows give a
row each. Columns of the input stay, except those that an output of the same name replaces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import text_or_empty, without
from dumplake.llm.pretokens import Units


def byte_characters() -> dict[int, str]:
    """Printable characters stand for themselves, other bytes for the characters from 256 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a length and bytes, a float, or a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the places of the tokens in rank order; the last piece is unknown."""
    shown = byte_characters()
    tokens = sorted(ranks, key=ranks.get)
    pieces = [_field(1, "".join(shown[b] for b in t).encode()) + _field(2, float(-ranks[t])) for t in tokens]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))  # BPE, size, place of the unknown piece
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.order = sorted(ranks.values())
        self.whole = {t: struct.pack("<I", r) for t, r in ranks.items()}
        shown = byte_characters()
        self.to_piece = {b: c for b, c in shown.items()}
        back = {c: b for b, c in shown.items()}
        self.bytes_of = {r: bytes(back[c] for c in self.model.id_to_piece(i)) for i, r in enumerate(self.order)}
        self.units = Units(regex.compile(pattern).findall, self._encode)

    def _encode(self, tokens: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        out = [self.whole.get(r) for r in raw]
        left = [i for i, x in enumerate(out) if x is None]
        order = self.order
        pieces = [raw[i].decode("latin-1").translate(self.to_piece) for i in left]
        for i, got in zip(left, self.model.encode(pieces, num_threads=1)):
            out[i] = struct.pack(f"<{len(got)}I", *[order[x] for x in got])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.units.ids(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process; the rank file is at the same path on every executor."""
    return Codec(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit integers)."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(codec(path, pattern).encode(list(texts)), dtype=object)

    return without(docs, "ids").withColumn("ids", encode(text_or_empty()))


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` with ``decoded`` (binary) from ``ids``."""

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        to = codec(path, pattern)
        return pd.Series([to.decode(x) for x in ids], dtype=object)

    return without(rows, "decoded").withColumn("decoded", decode(F.coalesce("ids", F.lit(b""))))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, decoded from the ids, and both hashed in one pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        to = codec(path, pattern)
        ids = to.encode(list(texts))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": map(sha, ids), "decoded_sha256": [sha(to.decode(x)) for x in ids]})

    return docs.select("doc_id", both(text_or_empty()).alias("d")).select("doc_id", "d.*")
