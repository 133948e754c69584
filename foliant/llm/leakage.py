"""Evaluation passages inside a corpus.

Texts are brought to templates: base letters without case, accents, blanks,
markup or shapeless characters, with typed placeholders for numbers, dates,
amounts of money, durations, measures (numbers with their units) and names.
Windows of a template (twenty signs, nine in Han script) are hashed. A hash join of
those that few items have with the windows of the documents gives the pairs to look
at: up to POSTINGS windows of items are sent to every partition of documents, more
are joined by shuffle, of the documents only what a bit table of fixed size over the
items' windows lets pass. Each document is brought to its template once in either
way. Of a pair all windows are then held against each other. Windows that meet on one diagonal form a stretch; a
stretch over a third of the item, dense enough and not made of passages that
several items share, is a leak. The figures (or else the names) of both stretches, the slots of the
template, are then compared: where few agree, the leak is a re-parameterised copy.

Names are capitalised words inside a sentence. A passage that has lost its case
keeps its names as letters, as does Han script, which marks no names; the density
of a stretch leaves room for that.

Defined results: null, empty and blank texts hold nothing; copies of a document
are each found; items too short for a window (20 signs, 9 in Han script) are met by
nothing; an item given twice is found twice; an empty table of items or documents
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import cut_lineage, spread, written

LATIN, HAN = 20, 9
#: least share of an item in one stretch, and of that stretch in matching windows
SHARE, DENSITY = 1 / 3, 0.3
#: least share of the item in windows that fewer than SHARED items have
OWN, SHARED = 0.15, 4
#: least part of the telling slots of the stretch that the item has; below it the stretch is another filling of the template
#: (copies with changed words agree in 0.4 or more, other fillings in single figures by chance)
SLOTS = 0.25
#: windows of items that are sent to the workers; more of them are joined by shuffle
POSTINGS = 500_000
#: slots of the bit table
BITS = 1 << 24
_BAND, _GAP = 64, 90
_ZERO = ord("0")
_B = np.uint64(0x9E3779B97F4A7C15)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&[a-z]{2,6};|\[([^\[\]]*)\]\([^()\s]*\)")

# Months, currencies and units as they stand in a template (small base letters, no blanks; 0 is any number).
_PT_MONTHS = "janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
_EN_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_CURRENCY = "mop|hkd|hk|rmb|usd|eur|澳門元|港元|港幣|人民幣"
_MONEY = "patacas?|euros?|dolares|dollars|澳門元|港元|元|圓"
_TIME = "anos?|meses|mes|semanas?|dias?|horas?|minutos?|years?|months?|weeks?|days?|hours?|minutes?|個月|月|年|日|天|小時|分鐘"
_MEASURE = "metrosquadrados|metros?|m0|km|kg|平方米|公里|公斤|米|porcento|percent"
#: what may stand behind a number, by the kind of placeholder the two make
_BEHIND = re.compile(
    rf"0(?:(?P<date>de(?:{_PT_MONTHS})(?:de0)?|(?:{_EN_MONTHS})0|年0月(?:0日)?)|(?P<money>(?:[萬億]0?)*(?:{_MONEY}))|(?P<time>{_TIME})|(?P<measure>{_MEASURE}))"
)
_MYRIADS = re.compile("0(?:[萬億]0?)*元?")
_BEFORE = tuple((m, "date") for m in _EN_MONTHS.split("|")) + tuple((m, "money") for m in _CURRENCY.split("|"))
_BEFORE_BY_END = {z: [(m, k) for m, k in _BEFORE if m[-1] == z] for z in {m[-1] for m, _ in _BEFORE}}
_BEGINNINGS = {u[0] for u in ["de", *_EN_MONTHS.split("|"), *_MONEY.split("|"), *_TIME.split("|"), *_MEASURE.split("|"), "萬", "億"]}
#: signs of the typed placeholders; 0 stands for a plain number
_SIGN_OF = {"date": 0xE001, "money": 0xE002, "time": 0xE003, "measure": 0xE004, "name": 0xE005}
_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_MONTH_NAMES = "|".join(m.capitalize() for m in f"{_PT_MONTHS}|{_EN_MONTHS}|março".split("|"))
_NAME = re.compile(
    rf"[{_UPPER}](?<=[{_LOWER},;][ \n][{_UPPER}])(?<!(?=(?:{_MONTH_NAMES})\b).)[{_LOWER}]++"
    rf"(?:[ \n](?:d[aeo]s?[ \n])?[{_UPPER}][{_LOWER}]++){{0,2}}+(?![ \n]+[{_UPPER}][{_LOWER}])"
)
_YEAR = re.compile(r"(?:19|20)\d\d$")
_NO_DIGIT = dict.fromkeys(map(ord, ".,:/ \n\t\r"))
_FIGURE = re.compile(r"\d+(?:(?:\s*\n\s*[.,]?|[.,]\s*\n\s*|[.,:/])\d+)*")


#: sign before each text of a batch
_EDGE = 0xE000


class Templates:
    """The templates of many texts in one array, each behind an edge sign.

    ``signs`` has one sign per number, ``typed`` one per typed placeholder, of which
    ``place`` tells where in ``signs`` it stands; ``start`` is the first place of each
    text. Slots are read on demand.
    """

    def __init__(self, texts: list[str]) -> None:
        from .fold import BASE, codes_of, spell

        plain = [spell(_TAG.sub(lambda m: m.group(1) or " ", t) if "<" in t or "](" in t or "&" in t else t).replace("\0", " ") for t in texts]
        whole = "\0" + "\0".join(plain)
        codes = codes_of(whole)
        self.base = base = BASE[codes]
        base[codes == 0] = _EDGE
        self.digit = digit = (base >= 48) & (base <= 57)
        self.raw_at = at = np.flatnonzero(digit | ((base >= 97) & (base <= 122)) | _letters()[base] | (base == _EDGE))
        self.text_at = np.flatnonzero(codes == 0)
        signs = np.where(digit[at], _ZERO, base[at])
        first = np.ones(len(at), dtype=bool)
        first[1:] = ~((signs[1:] == _ZERO) & (signs[:-1] == _ZERO))
        self.signs, self.at = signs, at = signs[first], at[first]
        self.start = np.flatnonzero(signs == _EDGE) + 1
        self.size = np.diff(np.append(self.start, len(signs) + 1)) - 1
        typed, keep = signs.copy(), np.ones(len(at), dtype=bool)
        spans = np.array([m.span() for m in _NAME.finditer(whole)], np.int64).reshape(-1, 2)
        self.names = np.searchsorted(at, spans)
        for a, z in self.names.tolist():
            if z > a:
                typed[a] = _SIGN_OF["name"]
                keep[a + 1 : z] = False
        zeros = np.flatnonzero(typed == _ZERO)
        tells_next, tells_before = _tells()
        zeros = zeros[tells_next[typed[np.minimum(zeros + 1, len(typed) - 1)]] | tells_before[typed[zeros - 1]]]
        string, free, dates = _string(typed), 0, []
        for p in zeros.tolist():
            if p < free:
                continue
            m, a = _BEHIND.match(string, p), p
            kind, z = (m.lastgroup, m.end()) if m else ("", p + 1)
            for word, k in _BEFORE_BY_END.get(string[p - 1], ()):
                if string.endswith(word, free, p):
                    kind, a = k, p - len(word)
                    z = _MYRIADS.match(string, p).end() if k == "money" else p + 1
                    break
            if kind:
                typed[a] = _SIGN_OF[kind]
                keep[a + 1 : z] = False
                free = z
                if kind == "date":
                    dates.append((a, z))
        self.dates = np.array(dates, np.int64).reshape(-1, 2)
        self.typed, self.place = typed[keep], np.flatnonzero(keep)

    def windows(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each width (hash, place) of the windows of so many signs, and of those of the typed signs that hold a placeholder.

        Windows over an edge are like none of a single text.
        """
        marks = (self.typed >= min(_SIGN_OF.values())) & (self.typed <= max(_SIGN_OF.values()))
        holders, out = np.concatenate([[0], np.cumsum(marks)]), {}
        for width, p, t in zip((HAN, LATIN), _windows(self.signs), _windows(self.typed), strict=True):
            j = np.flatnonzero(holders[width:] > holders[: len(holders) - width]) if len(t) else np.zeros(0, np.int64)
            out[width] = np.concatenate([p, t[j]]), np.concatenate([np.arange(len(p)), self.place[j]])
        return out

    def of(self, places: np.ndarray) -> np.ndarray:
        """Number of the text each place belongs to."""
        return np.searchsorted(self.start, places, "right") - 1

    def slots(self, i: int) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
        """(place in the text, value) of the telling figures and dates of a text, and of its names."""
        lo, hi = int(self.start[i]), int(self.start[i] + self.size[i])
        begin = int(self.text_at[i]) + 1
        end = int(self.text_at[i + 1]) if i + 1 < len(self.text_at) else len(self.base)
        figures = [(int(np.searchsorted(self.at, begin + p, "right")) - 1 - lo, f) for p, f in _figures(self.base[begin:end])]
        inside = lambda spans: spans[(spans[:, 0] >= lo) & (spans[:, 0] < hi)].tolist()
        for a, z in inside(self.dates):
            # the signs of a date with all figures
            x, y = np.searchsorted(self.raw_at, (self.at[a], self.at[z] if z < len(self.at) else len(self.base))).tolist()
            figures.append((a - lo, _string(self.base[self.raw_at[x:y]])))
        return figures, [(a - lo, _string(self.signs[a:z])) for a, z in inside(self.names) if z > a]


def _figures(base: np.ndarray) -> list[tuple[int, str]]:
    """Figures of four digits or more that are no year, as digits, joined over line breaks."""
    kept, out = np.flatnonzero(base), []
    for m in _FIGURE.finditer(_string(base[kept])):
        f = m.group()
        if len(f) >= 4:
            f = f.translate(_NO_DIGIT)
            if len(f) >= 4 and not _YEAR.match(f):
                out.append((int(kept[m.start()]), f))
    return out


def typed_signs(text: str) -> str:
    """The template of one text with its placeholders."""
    return _string(Templates([text]).typed[1:])


_TELLS: list[np.ndarray] = []


def _tells() -> list[np.ndarray]:
    """Signs that may begin what stands behind a number, and end what stands before it, of a placeholder."""
    if not _TELLS:
        for chars in (_BEGINNINGS, _BEFORE_BY_END):
            t = np.zeros(0x110000, dtype=bool)
            t[[ord(c) for c in chars]] = True
            _TELLS.append(t)
    return _TELLS


def _string(signs: np.ndarray) -> str:
    return signs.tobytes().decode("utf-32-le", "surrogatepass")


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        t = np.zeros(0x110000, dtype=bool)
        t[[c for c in range(0x80, 0x20000) if chr(c).isalpha()]] = True
        t[0x20000:0x32000] = True
        t[0xE000:0xF900] = False
        _LETTERS.append(t)
    return _LETTERS[0]


def _is_han(signs: np.ndarray) -> np.ndarray:
    return ((signs >= 0x2E80) & (signs <= 0x9FFF)) | (signs >= 0x20000)


def _windows(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of HAN and of LATIN signs that begin at each place."""
    none = np.zeros(0, np.uint64)
    if len(signs) < HAN:
        return none, none
    with np.errstate(over="ignore"):
        h1 = (signs.astype(np.uint64) + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)
        h1 ^= h1 >> np.uint64(29)
        p = {1: _B}
        for k in (2, 4, 8):
            p[k] = p[k // 2] * p[k // 2]
        h2 = h1[:-1] * p[1] + h1[1:]
        h4 = h2[:-2] * p[2] + h2[2:]
        h8 = h4[:-4] * p[4] + h4[4:]
        h9 = (h8[:-1] * _B + h1[8:]) ^ np.uint64(0x5555)
        if len(signs) < LATIN:
            return h9, none
        h16 = h8[:-8] * p[8] + h8[8:]
        return h9, h16[:-4] * p[4] + h4[16:]


def same_figure(f: str, g: str) -> bool:
    """Equal figures, a torn one with its whole, or one with a digit lost; dates in words must be equal."""
    if f == g or not (f.isdigit() and g.isdigit()):
        return f == g
    if (len(f) >= 4 and (g.startswith(f) or g.endswith(f))) or (len(g) >= 4 and (f.startswith(g) or f.endswith(g))):
        return True
    if abs(len(f) - len(g)) != 1:
        return False
    long, short = (f, g) if len(f) > len(g) else (g, f)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TEXTS, _PLACES, _HASHES = pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())
_ITEM_SCHEMA = pa.schema(
    [("item", pa.int64()), ("item_id", pa.int64()), ("template", pa.int64()), ("size", pa.int32()), ("win", pa.int32()), ("item_figures", _TEXTS), ("item_names", _TEXTS), ("h", _HASHES), ("q", _PLACES)]
)
_DOC = [("doc_id", pa.int64()), ("figures", _TEXTS), ("names", _TEXTS), ("figures_at", _PLACES), ("names_at", _PLACES), ("hs", _HASHES), ("ks", _PLACES)]
# one row of a document (its head) has the columns of _DOC, the others a window each that few items have
_WINDOW_SCHEMA = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("head", pa.bool_()), *_DOC])


def _numbers() -> Iterator[int]:
    """Numbers of rows, unlike those of any other task."""
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


BATCH = 50


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = _numbers()
    for b in batches:
        rows = []
        for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = Templates([text])
            signs = t.signs[1:]
            win = HAN if len(signs) and _is_han(signs).mean() > 0.4 else LATIN
            h, q = t.windows()[win]
            h, q = h[q > 0], q[q > 0] - 1
            digest = int.from_bytes(hashlib.blake2b(signs.tobytes(), digest_size=8).digest(), "little", signed=True)
            figures, names = t.slots(0)
            rows.append((next(number), item_id, digest, len(signs), win, [f for _, f in figures], [n for _, n in names], h.view(np.int64), q))
        if rows:
            yield _rows(list(zip(*rows, strict=True)), _ITEM_SCHEMA)


def _met(t: Templates, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place in the text) of the windows whose slot of the bit table is marked, by text and hash."""
    mask, w = np.uint64(BITS - 1), t.windows()
    (h9, k9), (h20, k20) = w[HAN], w[LATIN]
    sel = np.flatnonzero(bits[h9 & mask])
    # the narrow windows are those of Han script
    han = _is_han(t.signs)
    sel = sel[han[k9[sel]] | han[np.minimum(k9[sel] + HAN - 1, len(han) - 1)]]
    h9, k9 = h9[sel], k9[sel]
    sel = np.flatnonzero(bits[h20 & mask])
    h, k = np.concatenate([h9, h20[sel]]).view(np.int64), np.concatenate([k9, k20[sel]])
    text = t.of(k)
    h, k, text = h[text >= 0], k[text >= 0], text[text >= 0]
    order = np.lexsort((h, text))
    text, h, k = text[order], h[order], k[order]
    return text, h, k - t.start[text]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Templates]]:
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            rows = [r for r in zip(*(c.to_pylist() for c in b.slice(lo, BATCH).columns), strict=True) if r[1]]
            if rows:
                yield [r[0] for r in rows], Templates([r[1] for r in rows])


def _documents(marked: bytes, rare: bytes):
    """Per document that may meet an item: its head, then its windows that few items have; ``marked`` and ``rare`` are bit tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, few = (np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in (marked, rare))
        number = _numbers()
        for ids, t in _texts(batches):
            text, h, k = _met(t, bits)
            rows = []
            for i in np.unique(text[few[h.view(np.uint64) & np.uint64(BITS - 1)]]).tolist():
                a, z = np.searchsorted(text, (i, i + 1)).tolist()
                n, (figures, names) = next(number), t.slots(i)
                rows.append((n, n, True, ids[i], *([x[j] for x in s] for j in (1, 0) for s in (figures, names)), h[a:z], k[a:z]))
                telling = np.unique(h[a:z][few[h[a:z].view(np.uint64) & np.uint64(BITS - 1)]])
                rows += [(n, x, False, None, None, None, None, None, None, None) for x in telling.tolist()]
            if rows:
                yield _rows(list(zip(*rows, strict=True)), _WINDOW_SCHEMA)

    return work


def _stretches(q: np.ndarray, k: np.ndarray, band: np.ndarray, common: np.ndarray, size: int, win: int) -> list[tuple[float, int, int, int]]:
    """Stretches of meetings (item place q, document place k), longest first: share, own share, first and last document place."""
    found = []
    by_band = np.argsort(band, kind="stable")
    ordered = band[by_band]
    values = np.unique(ordered)
    # a band with its neighbours: every meeting is looked at three times, however many bands there are
    for lo, hi in zip(np.searchsorted(ordered, values - 1).tolist(), np.searchsorted(ordered, values + 1, "right").tolist(), strict=True):
        if hi - lo < 0.05 * size:
            continue
        sel = by_band[lo:hi]
        sel = sel[np.argsort(k[sel], kind="stable")]
        qs, ks, cs = q[sel], k[sel], common[sel]
        cuts = np.concatenate([[0], np.flatnonzero(ks[1:] - ks[:-1] > _GAP) + 1, [len(ks)]])
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end - first < 0.05 * size:
                continue
            part = slice(first, end)
            places = np.unique(qs[part])
            span = int(places[-1] - places[0]) + win
            covered = win + int(np.minimum(np.diff(places), win).sum())
            own = np.unique(qs[part][~cs[part]])
            own_covered = (win + int(np.minimum(np.diff(own), win).sum())) if len(own) else 0
            # a changed word at an end hides up to a window of the stretch
            if (span + win) / size >= SHARE and covered / span >= DENSITY:
                found.append((span / size, own_covered, int(ks[first]), int(ks[end - 1]) + win))
    # neighbouring bands see one stretch several times: the longest stands for what it covers
    kept: list[tuple[float, int, int, int]] = []
    for s in sorted(found, key=lambda s: -s[0]):
        if all(2 * (min(s[3], t[3]) - max(s[2], t[2])) < s[3] - s[2] for t in kept):
            kept.append(s)
    return kept


def _equal_slots(mine: list[str], theirs: list[str], same) -> float:
    return sum(any(same(f, g) for g in theirs) for f in mine) / len(mine)


class _Item:
    """An item with its windows in the order of their hashes."""

    __slots__ = ("id", "size", "win", "figures", "names", "h", "q", "common")

    def __init__(self, r: dict) -> None:
        self.id, self.size, self.win, self.figures, self.names = r["item_id"], r["size"], r["win"], r["item_figures"], r["item_names"]
        h = np.array([w["h"] for w in r["windows"]], np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.q, self.common = h[order], np.array([w["q"] for w in r["windows"]])[order], np.array([w["common"] for w in r["windows"]], bool)[order]


def _verdict(h: np.ndarray, places: np.ndarray, slots_of, x: _Item) -> tuple[float, float] | None:
    """(share, slots_equal) of the stretch that speaks most for a leak; None where none counts.

    ``h`` and ``places`` are the windows of a document by hash; ``slots_of`` reads its slots, where a stretch is found.
    """
    lo, hi = np.searchsorted(h, x.h, "left"), np.searchsorted(h, x.h, "right")
    n = hi - lo
    total = int(n.sum())
    if total < 0.08 * x.size:
        return None
    k = places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)].astype(np.int64)
    q, common = np.repeat(x.q, n), np.repeat(x.common, n)
    band = (k - q) // _BAND
    # only where two neighbouring bands hold enough of the item
    keys, counts = np.unique(band, return_counts=True)
    follows = np.zeros(len(keys), dtype=np.int64)
    follows[:-1] = np.where(np.diff(keys) == 1, counts[1:], 0)
    if not (counts + follows >= 0.08 * x.size).any():
        return None
    rest = slots = None
    for share, own, a, z in _stretches(q, k, band, common, x.size, x.win):
        slots = slots or slots_of()
        figures, names = ([v for at, v in s if a <= at < z] for s in slots)
        if figures:
            equal = _equal_slots(figures, x.figures, same_figure)
        elif own / x.size >= OWN:
            # names alone can speak against a leak, as some names are met everywhere
            equal = _equal_slots(names, x.names, str.__eq__) if len(names) >= 2 and x.names else 1.0
        else:
            continue
        if equal >= SLOTS:
            return share, equal
        rest = rest or (share, equal)
    # no stretch with slots of the item: the longest one is another filling of the template
    return rest


_LEAK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("slots_equal", pa.float64())])


def _judged(marked: bytes, seeds: tuple[np.ndarray, np.ndarray], items: dict[int, _Item]):
    """Leaks of documents: ``seeds`` are the windows few items have, by hash, with their items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(marked, np.uint8)).view(bool)
        hashes, owner = seeds
        for ids, t in _texts(batches):
            text, h, k = _met(t, bits)
            # the hash join: every window of a document with the items of an equal one
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = hi - lo
            item = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            found = []
            for i, x in np.unique(np.stack([np.repeat(text, n), item], axis=1), axis=0).tolist():
                a, z = np.searchsorted(text, (i, i + 1)).tolist()
                if v := _verdict(h[a:z], k[a:z], lambda i=i: t.slots(i), items[x]):
                    found.append((ids[i], items[x].id, *v))
            if found:
                yield _rows(list(zip(*found, strict=True)), _LEAK_SCHEMA)

    return work


def _judged_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, where every row is a document with an item."""
    for b in batches:
        found = []
        for i in range(b.num_rows):
            x = _Item({c: b.column(c)[i].as_py() for c in ("item_id", "size", "win", "item_figures", "item_names", "windows")})
            slots = lambda i=i: [list(zip(b.column(f"{c}_at")[i].as_py(), b.column(c)[i].as_py(), strict=True)) for c in ("figures", "names")]
            if v := _verdict(b.column("hs")[i].values.to_numpy(), b.column("ks")[i].values.to_numpy(), slots, x):
                found.append((b.column("doc_id")[i].as_py(), x.id, *v))
        if found:
            yield _rows(list(zip(*found, strict=True)), _LEAK_SCHEMA)


def _ddl(schema: pa.Schema) -> str:
    def kind(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        return {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}[t]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, slots_equal): every document that holds a stretch of an item.

    ``share`` is the part of the item in the stretch, ``slots_equal`` the part of
    the stretch's telling slots that the item has too. Rows below ``SLOTS`` are
    other fillings of the same template (re-parameterised copies).
    """
    asked = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].alias("t")).where("item_id IS NOT NULL AND t IS NOT NULL")
    asked = written(asked.mapInArrow(_items, _ddl(_ITEM_SCHEMA)))
    postings = asked.select("item", "template", F.explode(F.arrays_zip("h", "q")).alias("x")).select("item", "template", "x.h", "x.q")
    # windows that several different items share prove little
    owners = cut_lineage(postings.groupBy("h").agg((F.count_distinct("template") >= SHARED).alias("common")))
    # at most BITS numbers, whatever the number of items
    marked = _bits(owners)
    seeds = cut_lineage(postings.join(owners.where("NOT common"), "h").select("h", "item").distinct())
    known = postings.join(owners, "h").groupBy("item").agg(F.collect_list(F.struct("h", "q", "common")).alias("windows"))
    known = asked.select("item", "item_id", "size", "win", "item_figures", "item_names").join(known, "item")
    src = spread(documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].alias("t")).where(F.length("t") > 0))
    if owners.count() <= POSTINGS and seeds.count() <= POSTINGS:
        # few enough, as counted, to be sent to every partition
        items_of = {r["item"]: _Item(r.asDict(recursive=True)) for r in known.collect()}
        table = seeds.orderBy("h").toArrow()
        build = table["h"].to_numpy(), table["item"].to_numpy()
        return src.mapInArrow(_judged(marked, build, items_of), _ddl(_LEAK_SCHEMA))
    windows = written(src.mapInArrow(_documents(marked, _bits(owners.where("NOT common"))), _ddl(_WINDOW_SCHEMA)))
    pairs = windows.where("NOT head").select("doc", "h").join(seeds, "h").select("doc", "item").distinct()
    every = pairs.join(windows.where("head").drop("h", "head"), "doc").join(known, "item")
    return every.mapInArrow(_judged_pairs, _ddl(_LEAK_SCHEMA))


def _bits(hashes: DataFrame) -> bytes:
    """Bit table of hashes."""
    slots = hashes.select(F.col("h").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()
    out = np.zeros(BITS, dtype=bool)
    out[slots] = True
    return np.packbits(out).tobytes()
