"""Sentence units of texts in any script.

Rule set: the Sentence_Break character classes of Unicode (terminators STerm and
ATerm, closers) propose ends; language-specific suppression (abbreviations,
initials, ordinal and list numbers, figures) and quotation closing decide. Every
document is handled by itself in Arrow batches, so the operator needs no shuffle.

Defined results: a null, empty or blank text has no unit; a text without any
terminator is one unit (or one per heading or paragraph); repeated rows each give
their own units; other columns of the input are not read. Marks without a partner
in their paragraph protect nothing. Thai, which ends sentences with blanks alone,
is cut at blanks between Thai letters behind ``THAI_LEAST`` signs or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .charforms import INVISIBLE_PY, KEEP_LENGTH, ONE_FORM

_ALL = "".join(chr(c) for c in range(0x21, 0x20000) if not 0xD800 <= c <= 0xDFFF)
_STERM = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _ALL)) + "｡"
_STERM_SET = frozenset(_STERM)
_TERM = re.escape(_STERM) + r".…‥"
_OPEN, _CLOSE = r"«“„「『‹《〈【\[\(", r"»”」』›》〉】\]\)\"’"

# Abbreviations that never end a sentence (lower case, without the mark), whatever the language.
NEVER_FINAL = frozenset(
    "dr dra drs sr sra srs srta exmo exma exmos eng engª prof profª mr mrs ms messrs st hon rev gen col capt "  # titles
    "cfr cf conf vd vide art arts n no nos nº fl fls pág págs pag pags p pp vol vols cl cls al als proc procs ac acs "
    "res and c d l ex v.g i.e e.g id ibid op cit tít cap sec secs par para paras reg fig figs núm num tel av "
    "jan feb mar apr jun jul aug sept oct nov dec ed eds inc.no".split()
)
# Of these, words of a language in their own right. In that language they end a sentence unless a number
# (a letter, a Roman numeral) follows, months also where a number stands before them.
WORDS_TOO = {
    "en": frozenset("no art sec para par fig reg ex and ed id mar cap cl gen res".split()),
    "pt": frozenset("mar par art para ex cap".split()),
    "es": frozenset("mar par no art para ex".split()),
    "fr": frozenset("mar par art no cap".split()),
    "it": frozenset("mar no par art al".split()),
    "de": frozenset("mar art par".split()),
}
# Abbreviations of one language alone, and its capitals that stand for a title.
OWN_ABBREVIATIONS = {
    "fr": frozenset("mm mme mmes mlle mgr chap bd".split()), "es": frozenset("ud uds dña lic pág".split()),
    "de": frozenset("hr bzw vgl usw nr abs str".split()), "it": frozenset("sig sigg dott avv ing pag".split()),
}
TITLE_LETTERS = {"fr": frozenset("M"), "es": frozenset("D"), "pt": frozenset("D")}
# Function words that tell a language.
FUNCTION_WORDS = {
    "en": frozenset("the of and to was that is for on with it not by he she they we his her were said this at be".split()),
    "pt": frozenset("de da do dos das que não uma um os as em para com por foi ao à pelo pela no na se ou".split()),
    "es": frozenset("de el los las del una y en que por con se al fue lo su un la".split()),
    "fr": frozenset("de le la les des du est une et dans pour que qui il elle au un habite a".split()),
    "it": frozenset("di il gli della che non una per con è sono lo la dei un del si".split()),
    "de": frozenset("der die das und ist nicht mit den von ein eine zu im sich auf".split()),
}
THAI_LEAST = 16
# Abbreviations that may end one when a capital follows.
MAYBE_FINAL = frozenset("etc ss seq lda ltd inc corp adm a.m p.m sa s.a cia co jr sen approx".split())
# Words after which a number is expected.
NUMBER_AHEAD = frozenset("art arts n no nos fl fls pág págs pag p pp vol cl al proc ac para paras reg fig cap sec and".split())
# Words before a single capital letter that stand for a name, so the letter may end a sentence.
SMALL_WORDS = frozenset("de do da dos das por pelo pela pelos pelas o a os as e em no na ao à by of the and with for to".split())
TITLES = frozenset("dr dra sr sra exmo exma eng prof mr mrs ms messrs".split())
# Chinese conjunctions that continue a sentence after an ellipsis.
CJK_CONTINUE = ("因此", "所以", "但", "而", "故", "於是", "並", "則", "然而", "因而", "從而", "以致", "等", "的")

_LIST_NO = re.compile(r"[(（]?(?:\d{1,3}|[ivxlc]{1,5}|[IVXLC]{1,5}|[A-Za-z])$")
_LIST_AHEAD = re.compile(r"\d{1,3}[.)]\s*[^\W\d_a-zà-ÿ]|\d{1,3}[.)]\s+[\"«“‘(]")
_CJK_LIST_AHEAD = re.compile(r"\d{1,3}[.)、]\s*[㐀-鿿「『《]")
_WORD_BACK = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*$")
_HEADING = re.compile(
    r"(?:[IVX]{1,4}\s*[-–—.]\s*)?[A-ZÀ-Ý][A-ZÀ-Ý\s]{3,40}$"  # capitals only, numbered or not
    r"|(?:[IVX]{1,4}\.\s*[A-Z][\w ]{2,30})$"
    r"|[一二三四五六七八九十]{1,3}[、､][㐀-鿿]{1,12}$"
)
# what opens a span that is never cut inside, and what closes it
_SPAN = {"«": "»", "“": "”", '"': '"', "「": "」", "『": "』", "(": ")", "《": "》"}
_CLOSES = {z: a for a, z in _SPAN.items()}
_NUMBERED = re.compile(r"[IVXLC]{1,6}\b|[A-Za-z]\)|[A-Z](?=[\s,.)])|[§º°]")
_DAY_BEFORE = re.compile(r"\d[ºª.]?\s+(?:de\s+)?$")
_LATIN_WORDS = re.compile(r"[a-zà-öø-ÿ]+")
_ADDRESS = re.compile(r"[/@:\\_]|www", re.IGNORECASE)
_RUN = re.compile(f"[{_TERM}]+[{_CLOSE}]*")
_BLANKS = re.compile(r"\s*")
_SINGLE_BREAK = re.compile(r"(?<=[^\s.])\n(?=\S)")
_WRAP_BREAK = re.compile(r"\n(?=[a-zà-ÿ])")
_TAIL_TERM = re.compile(rf"[{_TERM}]+[\s{_CLOSE}]*$")
_LIGATURES = {c: v for c, v in ONE_FORM.items() if "ﬀ" <= c <= "ﬆ"}
#: a full stop before one of these never ends a unit
_NO_END_BEFORE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ,;:ºª%/-=&@")


def _table(dtype: type, chars: str = "") -> np.ndarray:
    out = np.zeros(0x110000, dtype=dtype)
    out[[ord(c) for c in chars]] = 1
    return out


_IS_TRIGGER = _table(bool, _STERM + ".…‥\n" + "".join(_SPAN))
_IS_PAIRED = _table(bool, "\n" + "".join(_SPAN) + "".join(_CLOSES))
_IS_ODD = _table(bool, regex.sub(r"[^\p{M}\p{Cf}]", "", _ALL) + "".join(_LIGATURES))
_IS_ODD[[ord(c) for c in regex.findall(f"[{INVISIBLE_PY}]", _ALL)]] = True
_IS_ODD[ord("\ufeff")] = True
_FOLD_TO = np.arange(0x110000, dtype=np.uint32)
for _c, _d in (KEEP_LENGTH | {ord("｡"): "。", ord("．"): "."}).items():
    _FOLD_TO[_c] = ord(_d)


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0003ffff" or "가" <= c <= "힯"


def _wrapped(lines: list[str]) -> bool:
    """Whether the lines of a text look hard-wrapped: all but the last about as long as the longest."""
    body = [len(x.strip()) for x in lines if x.strip()][:-1]
    return len(body) >= 3 and max(body) >= 12 and min(body) >= max(body) - 3


def _partners(view: str, codes: np.ndarray) -> dict[int, int]:
    """Place of each opening mark -> place of the mark that closes it: nested, in one pass, a blank line ends all that is open."""
    out: dict[int, int] = {}
    still: dict[str, list[int]] = {a: [] for a in _SPAN}
    n = len(view)
    for i in np.flatnonzero(_IS_PAIRED[codes]).tolist():
        c = view[i]
        if c == "\n":
            k = i + 1
            while k < n and view[k] in " \t\r":
                k += 1
            if k < n and view[k] == "\n":
                for open_at in still.values():
                    open_at.clear()
        elif c == '"':
            if still[c] and not view[i - 1].isspace():
                out[still[c].pop()] = i
            elif not still[c] and i + 1 < n and not view[i + 1].isspace():
                still[c].append(i)
        elif c in _SPAN:
            still[c].append(i)
        elif still[_CLOSES[c]]:
            out[still[_CLOSES[c]].pop()] = i
    return out


def _language(t: str) -> str:
    """The language whose function words a text in Latin letters holds most of; '' where none is met twice."""
    words = _LATIN_WORDS.findall(t.lower())
    counts = {lang: sum(w in known for w in words) for lang, known in FUNCTION_WORDS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] >= 2 else ""


class _Text:
    """One text under way: decides, for each proposed end, whether a unit ends there."""

    __slots__ = ("t", "n", "start", "width", "wrap", "_lang")

    def __init__(self, t: str) -> None:
        self.t, self.n, self.start, self.width, self.wrap, self._lang = t, len(t), 0, -1, None, None

    @property
    def lang(self) -> str:
        if self._lang is None:
            self._lang = _language(self.t)
        return self._lang

    def suppressed(self, w: str, at: int, k: int) -> bool:
        """Whether the word w before the stop, begun at ``at``, is an abbreviation that goes on with what stands at k."""
        if w in NEVER_FINAL:
            if w not in WORDS_TOO.get(self.lang, ()):
                return True
            return bool(_NUMBERED.match(self.t, k)) or bool(_DAY_BEFORE.search(self.t, max(self.start, at - 12), at))
        return w in OWN_ABBREVIATIONS.get(self.lang, ())

    def after_quote(self, inner_end: bool, j: int) -> bool:
        """End after a closing quote: the quotation ended a sentence and nothing goes on behind it."""
        if not inner_end:
            return False
        return self.fresh(j)

    def fresh(self, j: int) -> bool:
        """Whether what follows position j can begin a sentence."""
        t, n = self.t, self.n
        k = j
        while k < n and t[k].isspace():
            k += 1
        if k >= n:
            return True
        c = t[k]
        if k == j:
            near = j > 1 and (_cjk(t[j - 2]) or t[j - 1] in "」』")
            return _cjk(c) and not "　" <= c <= "〿" or c in "「『《" or (near and (c.isdigit() or c.isupper()))
        if t.count("\n", j, k) > 1:
            return True
        if c.islower() or c in ",;:)]»”」』，、；：—–-":
            return False
        return True

    def at_term(self, i: int, run: str, j: int) -> bool:
        t, n = self.t, self.n
        core = run.rstrip("»”」』›》〉】])\"’")
        if j >= n:
            return True
        nxt = t[j]
        if "…" in core or "‥" in core or core.startswith("..") or core.startswith("。。"):
            if nxt.isspace():
                return self.fresh(j)
            return _cjk(nxt) and not t.startswith(CJK_CONTINUE, j) and not "　" <= nxt <= "〿"
        if any(c in _STERM_SET for c in core):
            if core[-1] in "!?" and not nxt.isspace():
                if i and _cjk(t[i - 1]) and (nxt.isdigit() or nxt.isupper()):
                    return True
                return (_cjk(nxt) and not "　" <= nxt <= "〿") or nxt in "「『《" or nxt in _OPEN.replace("\\", "")
            if not nxt.isspace():
                return nxt not in "，、；：,;:)」』）"
            return self.fresh(j) or core[-1] not in "!?"
        # a full stop
        prev = t[i - 1] if i > self.start else ""
        head = t[self.start : i] if i - self.start <= 6 else ""
        if not nxt.isspace():
            if nxt.isdigit() or nxt.isupper():
                # no blank behind a Chinese sentence, or a forgotten one behind a word
                return bool(prev) and (_cjk(prev) or prev in ")」』》" and any(map(_cjk, t[max(self.start, i - 8) : i]))) or self.blank_forgotten(i, j)
            if not _cjk(nxt) and nxt not in "「『《" or "　" <= nxt <= "〿" and nxt not in "「『《":
                return False
            if head and _LIST_NO.match(head):
                return False
            if prev.isalpha() and not _cjk(prev) and prev not in "ºª":
                m = _WORD_BACK.search(t, max(self.start, i - 24), i)
                return bool(m) and len(m.group()) > 1 and m.group().lower() not in NEVER_FINAL
            return bool(prev) and (_cjk(prev) or prev.isdigit() or prev in "ºª)]」』》%\"”»")
        k = j
        while k < n and t[k].isspace():
            k += 1
        if k >= n:
            return True
        if t.count("\n", j, k) > 1:
            return not (head and _LIST_NO.match(head))
        if head and _LIST_NO.match(head):
            return False
        c = t[k]
        if c.islower() or c in ",;:)]»”」』，、；：—–-.":
            return False
        m = _WORD_BACK.search(t, max(self.start, i - 24), i) if not prev.isspace() else None
        w = m.group().lower() if m else ""
        if c.isdigit():
            if w in NUMBER_AHEAD or w in NEVER_FINAL:
                return False
            if _LIST_AHEAD.match(t, k) or _CJK_LIST_AHEAD.match(t, k):
                return True
            return (len(w) >= 3 and w not in MAYBE_FINAL) or bool(prev and (_cjk(prev) or prev in ")\"”»"))
        if not w:
            return True
        if len(w) == 1 and m.group().isupper():
            return self.letter_ends(m.start())
        if w == "v":
            b = t[max(self.start, m.start() - 2) : m.start()].strip()
            return bool(b) and b[-1].isdigit()
        if w in MAYBE_FINAL:
            return not (w == "co" and t.startswith(("Ltd", "Inc"), k))
        if self.suppressed(w, m.start(), k):
            return False
        if "." in w and w.rsplit(".", 1)[-1] in MAYBE_FINAL:
            return True
        if "." in w and all(len(x) == 1 for x in w.split(".")):
            return False
        return True

    def blank_forgotten(self, i: int, j: int) -> bool:
        """A word of small letters, the stop, and a word that begins with a capital: two sentences, unless in an address."""
        t = self.t
        if j != i + 1 or not t[i - 1].islower() or not t[j].isupper() or not t[j + 1 : j + 2].islower():
            return False
        m = _WORD_BACK.search(t, max(self.start, i - 24), i)
        w = m.group() if m else ""
        a, z = i, j
        while a > self.start and not t[a - 1].isspace():
            a -= 1
        while z < self.n and not t[z].isspace():
            z += 1
        # a word of the sentence, not a title, a name with dots or part of an address
        return len(w) > 3 and w.islower() and w not in NEVER_FINAL and w not in MAYBE_FINAL and t.count(".", a, z) <= 2 and not _ADDRESS.search(t, a, z)

    def letter_ends(self, at: int) -> bool:
        """A single capital before the stop: the letter of a party may end a sentence, an initial or a title may not."""
        if self.t[at] in TITLE_LETTERS.get(self.lang, ()) and self.lang == "fr":
            return False
        if at > self.start and self.t[at - 1] in "/-–" + "0123456789":
            return True
        b = self.t[max(self.start, at - 24) : at].rstrip()
        if not b or b[-1] == ".":
            return False
        m = _WORD_BACK.search(b)
        if not m or not m.group().islower() or not b.endswith(m.group()):
            return False
        w = m.group()
        return w not in SMALL_WORDS and w not in TITLES and w not in NEVER_FINAL

    def at_line(self, i: int, j: int) -> bool:
        t = self.t
        if t.count("\n", i, j) > 1:
            return True
        if j >= self.n:
            return True
        unit = t[self.start : i]
        if len(unit) <= 48 and _HEADING.match(unit):
            return True
        e = t.find("\n", j)
        line = t[j : e if e >= 0 else self.n].strip()
        if len(line) <= 48 and _HEADING.match(line):
            return True
        prev, nxt = t[i - 1], t[j]
        if prev in ",;:，、；：(（":
            return False
        if _cjk(prev) or prev in "」』》" or (_cjk(nxt) and not prev.islower()):
            if self.wrap is None:
                self.wrap = _wrapped(t.split("\n"))
            return not self.wrap or bool(_CJK_LIST_AHEAD.match(t, j))
        if nxt.islower() or prev == ".":
            return False
        # single line breaks before capitals only, never before a small letter: the lines are the units
        if self.width < 0:
            self.width = len(_SINGLE_BREAK.findall(t)) if not _WRAP_BREAK.search(t) else 0
        m = _WORD_BACK.search(t, max(self.start, i - 24), i)
        return self.width > 2 and nxt.isupper() and not (m and m.group() in SMALL_WORDS)


def split_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end (exclusive) of the sentence units of a text, in code points."""
    if not text or text.isspace():
        return []
    codes, at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), None
    codes = _FOLD_TO[codes]
    view = codes.tobytes().decode("utf-32-le", "surrogatepass")
    if _IS_ODD[codes].any():
        chars, at = [], []
        for i, c in enumerate(view):
            for d in _LIGATURES.get(c, "" if _IS_ODD[ord(c)] else c):
                chars.append(d)
                at.append(i)
        view = "".join(chars)
        codes = np.frombuffer(view.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x, out = _Text(view), []
    n = x.n
    while x.start < n and view[x.start].isspace():
        x.start += 1

    def close(e: int) -> None:
        s = x.start
        while e > s and view[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        x.start = _BLANKS.match(view, e).end()

    pos = x.start
    at_triggers = np.flatnonzero(_IS_TRIGGER[codes])
    thai = (codes >= 0x0E01) & (codes <= 0x0E5B)
    if thai.any():
        between = np.flatnonzero((codes[1:-1] == 32) & thai[:-2] & thai[2:]) + 1
        at_triggers = np.union1d(at_triggers, between)
    partners = None
    for i in at_triggers.tolist():
        if i < pos:
            continue
        c = view[i]
        if c == "." and i + 1 < n and (d := view[i + 1]) in _NO_END_BEFORE and not (i and (_cjk(view[i - 1]) or d.isupper() and view[i - 1].islower())) or c == "." and i + 1 < n and i and view[i + 1].isdigit() and view[i - 1].isdigit():
            pos = i + 1
            continue
        if c in _SPAN:
            if partners is None:
                partners = _partners(view, codes)
            if i not in partners:
                pos = i + 1
                continue
            j = partners[i] + 1
            ended = c not in "(《" and x.after_quote(bool(_TAIL_TERM.search(view, max(i + 1, j - 12), j - 1)), j)
        elif c == " ":
            j = i + 1
            ended = i - x.start >= THAI_LEAST
        elif c == "\n":
            j = _BLANKS.match(view, i).end()
            while i > x.start and view[i - 1].isspace():
                i -= 1
            ended = i > x.start and x.at_line(i, j)
        else:
            m = _RUN.match(view, i)
            j = m.end()
            ended = x.at_term(i, m.group(), j)
        if ended:
            close(j)
            j = max(j, x.start)
        pos = j
    if x.start < n:
        close(n)
    if at is None:
        return out
    # shapeless characters are text too: they go with the unit they touch
    size, spans, last = len(text), [], 0
    for s, e in out:
        s, e = at[s], at[e - 1] + 1
        while e < size and _IS_ODD[ord(text[e])] and text[e] not in _LIGATURES:
            e += 1
        while s > last and _IS_ODD[ord(text[s - 1])]:
            s -= 1
        spans.append((s, e))
        last = e
    return spans


SCHEMA = "ord bigint, start_at int, end_at int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ord", pa.int64()), ("start_at", pa.int32()), ("end_at", pa.int32())])
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            texts = part.column(1).to_pylist()
            spans = [split_spans(t) for t in texts]
            counts = np.fromiter((len(s) for s in spans), dtype=np.int64, count=len(spans))
            ords = part.column(0).take(pa.array(np.repeat(np.arange(len(spans)), counts)))
            flat = np.array([p for s in spans for p in s], dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([ords, pa.array(flat[:, 0]), pa.array(flat[:, 1])], schema=schema)


def sentence_units(df: DataFrame, id_col: str = "ord", text_col: str = "chunk_text") -> DataFrame:
    """One row (ord, start_at, end_at) per sentence unit of each row of ``df``."""
    src = df.select(df[id_col].cast("bigint").alias("ord"), df[text_col].alias("text"))
    return src.mapInArrow(_units, SCHEMA)
