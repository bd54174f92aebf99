"""Character sets of files that are neither marked nor UTF-8.

Each multi-byte set that decodes a file without error is scored by the share of its frequent rows among the characters
beyond ASCII; such characters stand beside each other in real text, while Latin letters with accents stand alone.  Then
come Cyrillic sets, if most words beyond ASCII are wholly Cyrillic, and else Latin-1.
"""

from __future__ import annotations

import re

#: Least share of characters of frequent rows, and of characters that stand beside another.
FREQUENT, BESIDE = 0.8, 0.5
COMMON = frozenset("的一是不了在有人我他这中大来上国个到说们为子和你地出道也时年的這個來國說們為時們會對")
_KANA = re.compile("[ぁ-ヿ]")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_WORD = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile("[А-Яа-яЁё]+")
#: Lead bytes of frequent rows, then of punctuation and letters of other scripts; least trail byte.
ROWS = {
    "euc_jp": ((0xB0, 0xCF), (0xA1, 0xA6), 0xA1),
    "cp932": ((0x88, 0x97), (0x81, 0x84), 0x40),
    "cp949": ((0xB0, 0xC8), (0xA1, 0xA3), 0xA1),
    "gb18030": ((0xB0, 0xD7), (0xA1, 0xA3), 0xA1),
    "big5": ((0xA4, 0xC6), (0xA1, 0xA3), 0x40),
}


def _score(text: str, name: str) -> float:
    """The share of frequent characters, with bonuses for what only one language has; 0 if they stand alone."""
    odd = [c for c in text if c > "\x7f"]
    if sum(map(len, _RUN.findall(text))) < BESIDE * len(odd):
        return 0.0
    (low, high), (first, last), least = ROWS[name]
    coded = [c.encode(name) for c in odd]
    fits = sum(len(b) == 2 and (low <= b[0] <= high or first <= b[0] <= last) and b[1] >= least for b in coded) / len(odd)
    if fits < FREQUENT:
        return 0.0
    kana, common = len(_KANA.findall(text)) / len(odd), sum(c in COMMON for c in odd) / len(odd)
    if name in ("euc_jp", "cp932"):
        return fits + kana if kana >= 0.1 else 0.0
    korean = sum("가" <= c <= "힣" for c in odd) / len(odd)
    return fits + (0.3 * korean if name == "cp949" else min(2 * common, 0.6))


def _cyrillic(text: str) -> float:
    """The share of words beyond ASCII that are Cyrillic in lower case but for the first letter, or in capitals."""
    words = [w for w in _WORD.findall(text) if not w.isascii()]
    if not words or sum(map(len, words)) < 2 * len(words):
        return 0.0
    return sum(bool(_CYRILLIC.fullmatch(w)) and (w[1:].islower() or len(w) == 1 or 0.9 * w.isupper()) for w in words) / len(words)


def charset(data: bytes) -> str:
    best = (0.0, "iso-8859-1")
    for name in ROWS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if (score := _score(text, name)) > best[0]:
            best = score, name
    if best[0]:
        return best[1]
    scores = [(_cyrillic(data.decode(name, "replace")), -n, name) for n, name in enumerate(("cp1251", "koi8_r"))]
    return max(scores)[2] if max(scores)[0] > 0.5 else "iso-8859-1"


def text_of(data: bytes) -> str:
    return data.decode(charset(data), "replace")
