"""Splitting text into the pre-tokens of a byte-level BPE, and exact per-worker caches of their ids.

The split is that of ``public_tokenizers.PATTERN``.  Texts whose code points all lie below U+0250 go through the
standard library's ``re`` with the letter and number classes written out from the Unicode categories; any other
text goes through the ``regex`` module.  Both give the same pieces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

LATIN_END = 0x250
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Entries a worker's cache holds before it starts afresh; a limit of memory, never of results.
CACHE_ENTRIES = 250_000


def _latin_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, regex.Pattern, re.Pattern]:
    tail = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
    latin = tail.format(L=_latin_class("L"), N=_latin_class("N"), S=SPACES)
    full = tail.format(L=r"\p{L}", N=r"\p{N}", S=SPACES)
    return re.compile(latin), regex.compile(full), re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")


def split(text: str) -> list[str]:
    """The pre-tokens of ``text``, in order; together they are the text."""
    latin, full, beyond = _patterns()
    return (full if beyond.search(text) else latin).findall(text)


class PieceCache(dict):
    """pre-token -> value, made by ``encode`` when first asked for; bounded in entries, long pre-tokens are not kept."""

    def __init__(self, encode: Callable[[str], object], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str):
        value = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = value
        return value

    def values_of(self, text: str) -> list:
        """The values of a text's pre-tokens, in order: one text at a time, while its pieces are still in the CPU's cache."""
        return [self[p] for p in split(text)]
