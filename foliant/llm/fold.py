"""Loose folding of texts by table lookup: base letters, small, without marks.

Whole batches are folded as arrays of code points, a few nanoseconds a character.
"""

from __future__ import annotations

import re
import unicodedata as ud

import numpy as np

from .charforms import _INVISIBLE_RANGES, ONE_FORM

_SIZE = 0x20000
#: code point -> folded code point; 0 where the character is dropped
BASE = np.arange(0x110000, dtype=np.uint32)


def _fill() -> None:
    for cp in [*range(0x41, 0x3400), *range(0xA640, 0xA800), *range(0xAC00, 0xAC01), *range(0xF900, 0x10000)]:
        c = chr(cp)
        cat = ud.category(c)
        if cat in ("Cs", "Co", "Cn"):
            continue
        if cat in ("Mn", "Me") or cat == "Cf":
            BASE[cp] = 0
            continue
        c = ONE_FORM.get(c, c)
        d = ud.normalize("NFKD", c)[:1].lower()[:1] or c
        d = ONE_FORM.get(d, d)[:1].lower()
        d = ud.normalize("NFKD", d)[:1] or d
        BASE[cp] = ord(d) if len(d) == 1 else cp
    for d in range(0x660, _SIZE):
        if ud.category(chr(d)) == "Nd":
            BASE[d] = ord(str(ud.digit(chr(d))))
    for a, b in _INVISIBLE_RANGES:
        BASE[a : b + 1] = 0
    BASE[:32] = 32
    BASE[10] = 10
    BASE[0x7F:0xA1] = 32


_fill()
#: ligatures and other signs of several letters, spelled out before the lookup
SPELLED = {k: v for k, v in ONE_FORM.items() if len(v) > 1 and ("ﬀ" <= k <= "ﬆ" or "Ⅰ" <= k <= "ⅿ" or k in "…‥")}
_SPELLED_RE = re.compile("[" + "".join(map(re.escape, SPELLED)) + "]")


def codes_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spell(text: str) -> str:
    """The text with signs of several letters spelled out."""
    return _SPELLED_RE.sub(lambda m: SPELLED[m.group()], text)


def fold(text: str) -> str:
    """The text folded, dropped characters removed."""
    out = BASE[codes_of(spell(text))]
    return out[out > 0].tobytes().decode("utf-32-le", "surrogatepass")


#: scripts written without blanks, whose signs are words by themselves
SIGN_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """code point -> 0 blank, 1 part of a word, 2 a word by itself."""
    if not _KINDS:
        import regex

        every = "".join(chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c <= 0xDFFF and not 0xE000 <= c <= 0xF8FF and c < 0xF0000)
        t = np.zeros(0x110000, dtype=np.uint8)
        for n, found in ((1, regex.findall(r"[\p{L}\p{M}]", every)), (2, regex.findall(rf"[{SIGN_SCRIPTS}]", every))):
            t[[ord(c) for c in found]] = n
        _KINDS.append(t)
    return _KINDS[0]


def worded(text: str) -> str:
    """The words of the folded text with blanks between them: runs of letters, and each sign of a script without blanks."""
    out = BASE[codes_of(spell(text))]
    out = out[out > 0]
    kind = _kinds()[out]
    alone = kind == 2
    end = np.cumsum(np.where(alone, 3, 1))
    spaced = np.full(end[-1] if len(end) else 0, 32, dtype=np.uint32)
    words = kind > 0
    spaced[(end - np.where(alone, 2, 1))[words]] = out[words]
    return spaced.tobytes().decode("utf-32-le", "surrogatepass")
