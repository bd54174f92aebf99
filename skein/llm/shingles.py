"""Sets of word shingles of many texts at once, as sorted arrays of 64-bit hashes, and min-hash bands over them.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z lower
cased.  A batch's bytes are hashed together: a word's hash is a difference of prefix sums of a polynomial modulo 2**64,
brought back to the word's start and mixed; a shingle's hash mixes its words' hashes in order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_LOWER = bytes(32 if b in b"\t\n\v\f\r " else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed together; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = constants(WORDS + 1, 11)


@lru_cache(maxsize=1)
def _inverse() -> int:
    return pow(_BASE, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them."""
    if base not in _powers or len(_powers[base]) < n:
        grown = np.full(max(n, BATCH_BYTES + 1024), np.uint64(base), "u8")
        grown[0] = 1
        out = np.cumprod(grown, dtype="u8")
        if n > 4 * BATCH_BYTES:
            return out
        _powers[base] = out
    return _powers[base]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts).translate(_LOWER) + b" ", "u1")
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    inside = np.concatenate([[False], data != 32, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[0::2], turns[1::2]
    sums = np.empty(len(data) + 1, "u8")
    sums[0] = 0
    np.cumsum((data.astype("u8") + np.uint64(1)) * powers(_BASE, len(data))[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_inverse(), len(data))[starts]
    hashes = mix(hashes ^ ((ends - starts).astype("u8") * _M2))
    at = np.searchsorted(starts, ends_of)
    return hashes, np.diff(at, prepend=0)


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    n = max(len(hashes) - WORDS + 1, 0)
    long = _PLACES[WORDS] * np.uint64(WORDS) + sum((hashes[k : k + n] * _PLACES[k] for k in range(WORDS)), np.zeros(n, "u8"))
    long, out, at = mix(long), [], 0
    for count in counts.tolist():
        if count >= WORDS:
            out.append(np.unique(long[at : at + count - WORDS + 1]))
        elif count:
            whole = _PLACES[WORDS] * np.uint64(count) + (hashes[at : at + count] * _PLACES[:count]).sum(dtype="u8")
            out.append(mix(np.array([whole], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
        at += count
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words each, or the whole of a shorter text."""
    out, batch, size = [], [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            if batch and size + len(text) > BATCH_BYTES // 2:
                out += _sets_of(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        return out + (_sets_of(batch) if batch else [])


class Bands:
    """Min-hash bands: ``rows`` minima make a key.  Two sets of Jaccard j share a band's key with chance j**rows."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.turn, self.factor = constants(bands * rows, 23), constants(bands * rows, 37)
        self.place = constants(bands, 53)

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """(len(sets), bands) keys; the sets must not be empty."""
        with np.errstate(over="ignore"):
            flat, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
            out = np.zeros((len(sets), self.bands), "u8")
            for k in range(self.bands * self.rows):
                least = np.minimum.reduceat((flat ^ self.turn[k]) * self.factor[k], at)
                out[:, k // self.rows] = mix(out[:, k // self.rows] + least + self.place[k // self.rows])
            return out


LEAST_BITS, MOST_BITS = 256, 1 << 22


def bits_for(size: int) -> int:
    """The width of the bitmap of a set: the next power of two over three bits a token."""
    return min(max(LEAST_BITS, 1 << (3 * size).bit_length()), MOST_BITS)


def bitmap(tokens: np.ndarray, bits: int | None = None) -> bytes:
    """The bits of a set's hashes modulo the width."""
    bits = bits or bits_for(len(tokens))
    flags = np.zeros(bits, bool)
    flags[(tokens & np.uint64(bits - 1)).astype("i8")] = True
    return np.packbits(flags).tobytes()


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(tokens))
        a = mix(np.array([tokens.sum(dtype="u8") + n * _M1], "u8"))
        b = mix(np.array([mix(tokens ^ _M2).sum(dtype="u8") + n], "u8"))
    return int(a.view("i8")[0]), int(b.view("i8")[0])
