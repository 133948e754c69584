"""Several values packed in one field, one row per value with its position.

Dictionary-guided segmentation. Delimiters outside quotes and brackets cut a
field into atoms; a multi-pattern automaton finds the known whole values that
hold a delimiter themselves, and dynamic programming picks the cheapest cover of
the atoms by single atoms and known values, so that a delimiter inside a
legitimate value stays. The dictionary is learnt from the column: values whose
borders are certain (quoted values, elements of JSON lists) and that hold a
delimiter; other values cannot change any cover and stay out of it. Up to
DICTIONARY_ROWS such values, as counted, go to the workers as an automaton. More are
joined: the spans of the fields that could be known values meet the dictionary by
shuffle, and the same dynamic programming covers each field with what was found.

Defined results: null, empty and blank fields and empty slots give no row;
positions count values, not slots; unbalanced quotes and brackets are plain text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import cut_lineage

#: values of the dictionary that are sent to the workers; more of them are joined
DICTIONARY_ROWS = 200_000

# Delimiters. Words count between blanks, Han conjunctions between Han signs.
_SIGNS = ";；|｜/／&＆\n\r\t　、,，•"
_QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", '"': '"'}
_BRACKETS = {"(": ")）", "（": "）)", "[": "]", "【": "】"}
_WORD_DELIMITER = re.compile(r"\s+(?:-|–|—|e|E|y|and|et|und|\+)\s+")
_HAN_DELIMITER = re.compile(r"\s*[及與和暨跟]\s*|\s+")
_NUMBER = re.compile(r"\s*(?:\(\d{1,2}\)|（\d{1,2}）|\d{1,2}\.[ºª°]|\d{1,2}[.)、．）])\s*")
_LETTER = re.compile(r"[^\W\d_]")


def _han(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def atoms(field: str) -> list[tuple[int, int, bool]]:
    """(start, end, quoted) of the parts between delimiters, quotes and brackets protected."""
    n, out, s, i = len(field), [], 0, 0
    numbered = bool(_NUMBER.match(field))

    def put(a: int, z: int) -> None:
        while a < z and field[a].isspace():
            a += 1
        while z > a and field[z - 1].isspace():
            z -= 1
        if numbered and (m := _NUMBER.match(field, a, z)):
            a = m.end()
        if a < z:
            q = field[a] in _QUOTES and z - a > 1 and field[z - 1] == _QUOTES[field[a]]
            out.append((a, z, q))

    while i < n:
        c = field[i]
        if c in _QUOTES and not field[s:i].strip():
            j = _closing(field, i, _QUOTES[c])
            if j:
                i = j
                continue
        elif c in _BRACKETS:
            j = next((k for k in range(i + 1, n) if field[k] in _BRACKETS[c]), 0)
            if numbered and (m := _NUMBER.match(field, i)) and not field[s:i].strip():
                i = m.end()
                continue
            if j:
                i = j + 1
                continue
        elif c in _SIGNS:
            put(s, i)
            s = i = i + 1
            continue
        elif c.isspace() and (m := _WORD_DELIMITER.match(field, i)):
            put(s, i)
            s = i = m.end()
            continue
        if numbered and i > s and c.isspace() and (m := _NUMBER.match(field, i)) and m.group().strip():
            put(s, i)
            s = i + len(m.group()) - len(m.group().lstrip())
            i = m.end()
            continue
        if i > s and (c.isspace() or c in "及與和暨跟") and (m := _HAN_DELIMITER.match(field, i)):
            before, after = field[i - 1], field[m.end()] if m.end() < n else ""
            if after and (_han(before) or before in ")）") and _han(after):
                put(s, i)
                s = i = m.end()
                continue
        i += 1
    put(s, n)
    return out


def _closing(field: str, i: int, mark: str) -> int:
    """Position after the closing quote, doubled quotes skipped; 0 if it is missing or inside a word."""
    k = i + 1
    while (k := field.find(mark, k)) >= 0:
        if mark == '"' and field[k + 1 : k + 2] == '"':
            k += 2
            continue
        rest = field[k + 1 :].lstrip(" ")
        return k + 1 if not rest or rest[0] in _SIGNS or _WORD_DELIMITER.match(field, k + 1) or _han(rest[0]) else 0
    return 0


def _plain(field: str, a: int, z: int, quoted: bool) -> str:
    if quoted:
        mark = field[z - 1]
        return field[a + 1 : z - 1].replace(mark * 2, mark).strip()
    return field[a:z].strip()


def _json(field: str) -> list[str] | None:
    if field.startswith("[") and field.endswith("]"):
        try:
            got = json.loads(field)
        except ValueError:
            return None
        if isinstance(got, list) and all(x is None or isinstance(x, str) for x in got):
            return [x.strip() for x in got if x and x.strip()]
    return None


def certain_values(field: str | None) -> list[str]:
    """Values of a field with certain borders that hold a delimiter."""
    if not field or not field.strip():
        return []
    field = field.strip()
    got = _json(field)
    if got is None:
        got = [_plain(field, a, z, q) for a, z, q in atoms(field) if q]
    return [v for v in got if len(atoms(v)) > 1]


class Segmenter:
    """Splits fields with the help of known whole values."""

    def __init__(self, known: list[str]) -> None:
        import ahocorasick

        self.automaton = None
        if known:
            self.automaton = ahocorasick.Automaton()
            for v in set(known):
                self.automaton.add_word(v, len(v))
            self.automaton.make_automaton()

    def _whole(self, field: str, parts: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
        """(first, last) atoms of the known values that cover several atoms exactly."""
        first = {a: k for k, (a, _, _) in enumerate(parts)}
        last = {z: k for k, (_, z, _) in enumerate(parts)}
        found = ((e + 1 - n, e + 1) for e, n in self.automaton.iter(field))
        return [(first[a], last[z]) for a, z in found if a in first and z in last and first[a] < last[z]]

    def split(self, field: str | None, spans: list[tuple[int, int]] | None = None) -> list[str]:
        """Values of a field in order; ``spans`` are the known ones where they were looked up elsewhere."""
        if not field or not field.strip():
            return []
        field = field.strip()
        listed = _json(field)
        if listed is not None:
            return listed
        parts = atoms(field)
        if not parts:
            return []
        if spans is None:
            spans = self._whole(field, parts) if self.automaton is not None and len(parts) > 1 else []
        whole: dict[int, list[int]] = {}
        for f, k in spans:
            whole.setdefault(k, []).append(f)
        # cost 2 for an atom by itself, 1 for a known value: the cheapest cover, the fewest values on a tie
        best: list[tuple[int, int]] = [(0, 0)]
        for k in range(len(parts)):
            choice = (best[k][0] + 2, k)
            for f in whole.get(k, ()):
                choice = min(choice, (best[f][0] + 1, f))
            best.append(choice)
        cuts, k = [], len(parts)
        while k:
            cuts.append((best[k][1], k))
            k = best[k][1]
        out = []
        for f, k in reversed(cuts):
            a, z = parts[f][0], parts[k - 1][1]
            v = _plain(field, a, z, parts[f][2] and k == f + 1)
            if _LETTER.search(v):
                out.append(v)
        return out


def dictionary(df: DataFrame, text_col: str) -> DataFrame:
    """Distinct values with certain borders that hold a delimiter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            fresh = {v for t in b.column(0).to_pylist() for v in certain_values(t)} - seen
            seen = fresh if len(seen) > 200_000 else seen | fresh
            yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh), pa.string())], ["value"])

    return df.select(text_col).where(F.length(text_col) > 0).mapInArrow(run, "value string").distinct()


def spans_of(field: str | None) -> list[tuple[int, int, str]]:
    """(first, last atom, text) of every run of several atoms of a field, each a possible value."""
    if not field or not field.strip() or _json(field.strip()) is not None:
        return []
    field = field.strip()
    parts = atoms(field)
    return [(i, k, field[parts[i][0] : parts[k][1]]) for i in range(len(parts)) for k in range(i + 1, len(parts))]


def split_values(df: DataFrame, id_col: str = "ord", text_col: str = "assistant_judges", value_col: str = "judge") -> DataFrame:
    """(ord, pos from 1, value) of every value in the field."""
    schema = pa.schema([("ord", pa.int64()), ("pos", pa.int32()), (value_col, pa.string())])
    ddl = f"ord bigint, pos int, {value_col} string"

    def put(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    src = df.select(df[id_col].cast("bigint").alias("ord"), df[text_col].alias("t")).where(F.length("t") > 0)
    words = cut_lineage(dictionary(df, text_col))
    if words.count() <= DICTIONARY_ROWS:
        known = [r[0] for r in words.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seg = Segmenter(known)
            for b in batches:
                rows = [(o, k, v) for o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, v in enumerate(seg.split(t), 1)]
                if rows:
                    yield put(rows)

        return src.mapInArrow(run, ddl)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, *s) for t in b.column(0).to_pylist() for s in spans_of(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["t", "i", "k", "value"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter([])
        for b in batches:
            rows = [
                (o, n, v)
                for o, t, met in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for n, v in enumerate(seg.split(t, [(m["i"], m["k"]) for m in met or []]), 1)
            ]
            if rows:
                yield put(rows)

    # equal fields are looked up once
    asked = src.select("t").distinct().mapInArrow(spans, "t string, i int, k int, value string")
    met = asked.join(words, "value").groupBy("t").agg(F.collect_list(F.struct("i", "k")).alias("met"))
    return src.join(met, "t", "left").select("ord", "t", "met").mapInArrow(cover, ddl)
