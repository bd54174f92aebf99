"""Operator 6: byte-level BPE through sentencepiece, from a rank file alone.

A sentencepiece model is serialised straight from the vocabulary: every token's bytes are written in the usual
printable alphabet of byte-level BPE, its score is its negative rank, and the normaliser is the identity.  Pre-tokens
are encoded one by one; a pre-token that is itself in the vocabulary is that token.  Decoding maps ids back to bytes.

Null is the empty text and has no ids.  Encoding then decoding gives the text's UTF-8 bytes for every text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text
from .pretokens import PieceCache


def printable_bytes() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has a visible one, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f))))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError(f"{path}: ranks have gaps")
    return [t for _, t in rows]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """The serialised model.  Ids are ranks; one unknown piece follows them, as the format wants one."""
    alphabet = printable_bytes()
    piece = lambda text, score, kind: _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("".join(alphabet[b] for b in token), -float(rank), 1) for rank, token in enumerate(vocabulary)]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(vocabulary))  # BPE, its size, the unknown piece's id
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)  # no dummy prefix, no space rules
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.vocabulary = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.vocabulary)}
        self.alphabet = printable_bytes()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.vocabulary))
        self.cache = PieceCache(self._encode)

    def _encode(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        if (rank := self.whole.get(data)) is not None:
            return struct.pack("<I", rank)
        ids = self.pieces.encode("".join([self.alphabet[b] for b in data]))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids, packed as little-endian unsigned 32-bit integers."""
        return b"".join(self.cache.values_of(text))

    def decode(self, packed: bytes) -> bytes:
        vocabulary = self.vocabulary
        return b"".join([vocabulary[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return map_text(docs, lambda ids, texts: [ids, [np.frombuffer(p, "<u4").astype("i4") for p in map(codec(path).encode, texts)]], "doc_id long, ids array<int>", arrow)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the packed ids, decoded_sha256 of the bytes that they decode to."""

    def digests(ids: list, texts: list[str]) -> list:
        bpe, out = codec(path), ([], [], [])
        for packed in map(bpe.encode, texts):
            out[0].append(len(packed) // 4)
            out[1].append(hashlib.sha256(packed).hexdigest())
            out[2].append(hashlib.sha256(bpe.decode(packed)).hexdigest())
        return [ids, *out]

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_text(docs, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow)
