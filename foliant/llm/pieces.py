"""Splitting oversized texts at natural boundaries, with an exact overlap.

Separator hierarchy: section heading, paragraph, sentence, clause, word, then
character. Pieces are packed greedily: the last boundary of the highest kind
within reach (the second half of the limit) is the cut, and the next piece begins
exactly ``overlap`` before it. Only rows beyond the limit leave the JVM.

Defined results: null, empty and fitting texts give no piece; a text without any
boundary is cut at the limit, never inside a combining sequence if avoidable;
repeated rows each give their own pieces.
"""

from __future__ import annotations

import re
import unicodedata as ud
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import _HEADING, split_spans

LIMIT, OVERLAP = 1600, 100
_PARAGRAPH = re.compile(r"\s*\n[^\S\n]*\n\s*")
_LINE = re.compile(r"[^\n]+")
_CLAUSE = re.compile(r"[;；，、,:：](?=\s|[⺀-鿿])")
_WORD = re.compile(r"(?<=\S)(?=\s)")


def _section_ends(text: str) -> list[int]:
    """Ends of the text before each heading line."""
    out = []
    for m in _LINE.finditer(text):
        line = m.group().strip()
        if m.start() and len(line) <= 48 and _HEADING.match(line):
            e = m.start()
            while e and text[e - 1].isspace():
                e -= 1
            out.append(e)
    return out


def cut_points(text: str) -> list[list[int]]:
    """Ascending end positions of each kind of boundary, highest kind first."""
    return [
        _section_ends(text),
        [m.start() for m in _PARAGRAPH.finditer(text)],
        [e for _, e in split_spans(text)],
        [m.end() for m in _CLAUSE.finditer(text)],
        [m.start() for m in _WORD.finditer(text)],
    ]


def _joined(text: str, e: int) -> bool:
    """Whether the characters before and behind a place make one sign: marks, joiners, variation selectors, skin tones, flags."""
    a, b = text[e - 1], text[e]
    if ud.category(b)[0] == "M" or "\u200d" in (a, b) or "\U0001f3fb" <= b <= "\U0001f3ff" or "\U000e0020" <= b <= "\U000e007f":
        return True
    if not ("\U0001f1e6" <= a <= "\U0001f1ff" and "\U0001f1e6" <= b <= "\U0001f1ff"):
        return False
    k = e
    while k and "\U0001f1e6" <= text[k - 1] <= "\U0001f1ff":
        k -= 1
    return (e - k) % 2 == 1


def _whole_sign(text: str, far: int, near: int) -> int:
    """The last place up to ``far`` that parts no sign, if there is one from ``near`` on."""
    e = far
    while e > near and _joined(text, e):
        e -= 1
    return far if _joined(text, e) else e


def cut(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text longer than ``limit``; none otherwise."""
    if text is None or len(text) <= limit:
        return []
    kinds, n, out, s = cut_points(text), len(text), [], 0
    while n - s > limit:
        far, near = s + limit, s + max(limit // 2, overlap + 1)
        for ends in kinds:
            k = bisect_right(ends, far)
            if k and ends[k - 1] >= near:
                e = ends[k - 1]
                break
        else:
            e = _whole_sign(text, far, near)
        out.append((s, e))
        s = e - overlap
    out.append((s, n))
    return out


_SCHEMA = pa.schema(
    [("ord", pa.int64()), ("piece_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("piece_text", pa.string())]
)


def oversized_pieces(
    df: DataFrame, id_col: str = "ord", text_col: str = "chunk_text", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """(ord, piece_no from 0, start_at, end_at, piece_text) of each text longer than ``limit``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be shorter than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (o, k, s, e, t[s:e])
                for o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for k, (s, e) in enumerate(cut(t, limit, overlap))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    long = df.select(df[id_col].cast("bigint").alias("ord"), df[text_col].alias("t")).where(F.length("t") > limit)
    return long.mapInArrow(run, "ord bigint, piece_no int, start_at int, end_at int, piece_text string")
