"""Operator 4: best-fit-decreasing packing of token sequences into windows.

Documents are tokenised, closed with one end id and cut into full windows; what is left of each document (shorter
than a window) is packed best-fit decreasing: a segment tree over the remaining capacities finds the tightest open
window.  Pieces, not texts, are shuffled.  Each partition packs its own pieces in bounded chunks, so no window spans
two tasks and nothing is gathered in one place.

Null and empty texts are one end id.  The string of a special token
inside a text is that token, as the tokenizers library reads it.  Rows with the same doc_id are separate documents.  An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import printable_bytes
from .common import map_text
from .pretokens import PieceCache

WINDOW = 1024
END_ID = 0
#: Pieces a task packs at once.
CHUNK = 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
_PACKED_ARROW = pa.schema([*_ARROW, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])

_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """Whole texts to packed ids (little-endian unsigned 32-bit), by a file of the tokenizers library.

    For a byte-level BPE with the usual split, texts are split here and the library's model merges each new pre-token;
    texts that hold the string of an added token, and any other tokenizer, are left to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        by_piece = made["model"]["type"] == "BPE" and not made["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cache = PieceCache(self._piece) if by_piece else None
        added = sorted(t["content"] for t in made.get("added_tokens") or [])
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = dict(enumerate(printable_bytes()))

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.merge(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.cache is None:
            return [self._whole(t) for t in texts]
        return [self._whole(t) if self.added and self.added.search(t) else b"".join(self.cache.values_of(t)) for t in texts]

    def _whole(self, text: str) -> bytes:
        """By the library's own reading, which knows the strings of added tokens."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(tokenizer_file: str) -> TextEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = TextEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


class CapacityTree:
    """Open windows by remaining capacity 0..size: a segment tree of counts over stacks of window numbers."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest open window with at least ``least`` left: (capacity, window)."""
        count, at = self.count, least + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces must be 1..window long.  Ties keep their given order."""
    order = np.argsort(-lengths, kind="stable")
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == window).sum())
    numbers[order[:full]] = np.arange(full)
    tree, used = CapacityTree(window), full
    for at, n in zip(order[full:].tolist(), lengths[order[full:]].tolist(), strict=True):
        if got := tree.take(n):
            left, number = got
        else:
            left, number, used = window, used, used + 1
        numbers[at], offsets[at] = number, window - left
        if left > n:
            tree.put(left - n, number)
    return numbers, offsets


def pieces(docs: DataFrame, tokenizer_file: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of at most ``window`` ids: full windows first, then the rest of the document."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(ids: list, texts: list[str]) -> list:
        out = ([], [], [], [], [])
        for doc_id, packed in zip(ids, encoder(tokenizer_file).encode_all(texts), strict=True):
            data = memoryview(packed + end)
            n = len(data) // 4
            for start in range(0, n, window):
                part = data[4 * start : 4 * (start + window)]
                for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                    column.append(value)
        return list(out)

    return map_text(docs, cut, PIECES, _ARROW)


def pack_pieces(cut: DataFrame, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """Adds sequence_id (partition number * 2**40 + window number) and offset.

    Pieces are dealt by a hash of document and start, and sorted by it, so that a task run again packs alike.
    """
    names = [f.name for f in _ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, held, rows
            all_rows = pa.Table.from_batches(held).combine_chunks()
            numbers, offsets = best_fit_decreasing(all_rows.column("length").to_numpy(), window)
            whole = pa.Table.from_arrays([*[all_rows.column(n) for n in names], pa.array(numbers + base), pa.array(offsets)], schema=_PACKED_ARROW)
            base, held, rows = base + int(numbers.max()) + 1, [], 0
            yield from whole.to_batches(max_chunksize=20_000)

        for batch in batches:
            held.append(batch.select(names))
            rows += batch.num_rows
            if rows >= chunk:
                yield from packed()
        if rows:
            yield from packed()

    key = F.xxhash64("doc_id", "start")
    return cut.withColumn("_k", key).repartition("_k").sortWithinPartitions("_k", "doc_id", "start", "ids_crc32").drop("_k").mapInArrow(run, PACKED)


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW) -> DataFrame:
    return pack_pieces(pieces(docs, tokenizer_file, window), window)
