"""Character tables shared by the text operators.

The tables are built from Unicode properties at import time; only look-alike
letters, which Unicode data does not hold, are listed.
"""

from __future__ import annotations

import unicodedata as ud

# Letters of other scripts drawn like Latin ones, "other -> Latin".
LOOKALIKE = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "Ӏ": "I", "Һ": "H",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ү": "y", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Cherokee-free set and IPA
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "ɡ": "g", "ɩ": "i", "ո": "n",
}

# Hyphens and slashes drawn like the ASCII sign.
SIGN_TWINS = {"‐": "-", "‑": "-", "⁄": "/", "∕": "/", "∶": ":", "꞉": ":", "․": "."}

# Fixed ranges: characters without any shape of their own (format characters,
# joiners, direction marks, variation selectors, fillers).
_INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
INVISIBLE_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a != b else f"\\x{{{a:X}}}" for a, b in _INVISIBLE_RANGES)
INVISIBLE_PY = "".join(
    (chr(a) if a == b else f"{chr(a)}-{chr(b)}") for a, b in _INVISIBLE_RANGES
)

_FOLDED_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _compat_same_shape(cp: int) -> bool:
    """<compat> characters whose expansion is drawn alike: ligatures, Roman numerals, radicals, leaders, spaces, digraphs."""
    return (
        0xFB00 <= cp <= 0xFB4F
        or 0x2160 <= cp <= 0x217F
        or 0x2E80 <= cp <= 0x2FDF
        or 0x2000 <= cp <= 0x200A
        or cp in (0x2025, 0x2026, 0x205F, 0x3000)
        or 0x0132 <= cp <= 0x0133
        or 0x01C4 <= cp <= 0x01CC
        or 0x01F1 <= cp <= 0x01F3
        or 0x3131 <= cp <= 0x318E
        or 0xFE19 <= cp <= 0xFE6F
    )


def _one_form() -> dict[str, str]:
    out: dict[str, str] = {}
    for cp in [*range(0x80, 0x3400), *range(0xF900, 0x10000)]:
        c = chr(cp)
        if cat_is(c, "Cn", "Cs", "Co"):
            continue
        d = ud.decomposition(c)
        if d.startswith("<"):
            kind, _, rest = d.partition(" ")
            target = "".join(chr(int(x, 16)) for x in rest.split())
            if kind in _FOLDED_KINDS or (kind == "<compat>" and _compat_same_shape(cp)):
                full = ud.normalize("NFKC", target) if kind != "<compat>" else target
                if len(full) == 1 or kind == "<compat>" and target[0] != " ":
                    out[c] = full
        elif ud.category(c) == "Zs":
            out[c] = " "
    out |= SIGN_TWINS | LOOKALIKE
    # composed letters over a look-alike base (for example a dotted Cyrillic e)
    for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        c = chr(cp)
        n = ud.normalize("NFD", c)
        if len(n) > 1 and n[0] in LOOKALIKE:
            out[c] = ud.normalize("NFC", LOOKALIKE[n[0]] + n[1:])
    out["\t"] = " "
    out["\u2028"] = out["\u2029"] = out["\x85"] = "\n"
    for a, b in _INVISIBLE_RANGES:
        for cp in range(a, b + 1):
            out.pop(chr(cp), None)
    return out


def cat_is(c: str, *cats: str) -> bool:
    """Whether the general category of a character is one of those given."""
    return ud.category(c) in cats


#: character -> the form all its look-alikes share
ONE_FORM: dict[str, str] = _one_form()
#: the same, for str.translate, one code point to one (positions stay)
KEEP_LENGTH: dict[int, str] = {ord(k): v for k, v in ONE_FORM.items() if len(v) == 1}
