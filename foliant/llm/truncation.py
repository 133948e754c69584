"""Values cut off by field limits or in transfer, and how often each source cuts.

Three kinds of evidence, all counted over whole columns:

* a corpus vocabulary trie, kept as a table of words and of their proper
  prefixes: a value whose final token is no word but the beginning of one was cut
  inside a word;
* the same idea for sentences: after which last signs of a text do sentences of
  the corpus end, after which do they go on (contexts of 24, 12 and 6 signs,
  figures made equal, the longest context with enough cases decides);
* lengths: a source that stops unusually often at one length has a limit there,
  which decides where the contexts leave the matter open.

A cut mark at the end is taken off first and proves nothing by itself, since
sentences may end in dots too. The contexts asked for mark a bit table of fixed
size (2**22 slots), and only places whose slot is marked are counted, so the
shuffle follows the number of values, not of characters.

Defined results: null, empty and blank values are no case; headings and keyword
lines that are complete are no case; equal values get the same verdict; a table
without rows gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import cut_lineage, written

from .charforms import KEEP_LENGTH
from .sentences import _HEADING, MAYBE_FINAL, NEVER_FINAL, split_spans

CONTEXTS = (24, 12, 6)
COUNTS = ("ends", "goes", "open", "dot_ends", "dot_goes", "dots_end", "dots_go")
#: least and most slots of the bit table (powers of two), and slots for each context
LEAST_BITS, MOST_BITS, ROOM = 22, 27, 16
#: cases a context needs, and the share of ends that makes a place an end
CASES, END_SHARE = 3, 0.5
#: the same away from any limit, and the share that means "never"
CLAUSE_SHARE, NEVER = 0.15, 0.05
#: least cases of a word or prefix that the trie trusts
WORD_CASES = 3
#: a length is a limit of a source where so large a share of its values stop there
LIMIT_SHARE, LIMIT_CASES = 0.01, 5

_MARK = re.compile(r"(?:\s*(?:\.{2,}|…|‥|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)))+\s*$")
_STRONG = re.compile(r"[。｡！？!?](?:[\"”»」』’')）\]》]|\s)*$")
_DOT = re.compile(r"[.．](?:[\"”»」』’')）\]》]|\s)*$")
_OPEN_END = frozenset(",;:，；：､、(（[«“「『《/&–—-")
_DOTTED_WORD = re.compile(r"([^\W\d_]+)[.．]$")
_PAIRS = {"「": "」", "『": "』", "«": "»", "“": "”", "(": ")", "《": "》"}
_B = np.uint64(0x9E3779B97F4A7C15)


class _Streams:
    """The signs of many texts in one array, with a start sign before each unit.

    ``event`` per sign: 0 inside a token or unknown, 1 a unit ends here, 2 it goes
    on, 3 open (a capital follows). ``stop``: 1 a full stop behind, 2 dots or an
    ellipsis. ``first`` and ``last``: place of the first and last sign of each
    text, -1 for a text without signs.
    """

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int]]]) -> None:
        from .fold import BASE
        from .leakage import _is_han, _letters

        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        offset = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        counts = np.fromiter((len(x) for x in spans), np.int64, len(spans))
        flat = np.array([p for x in spans for p in x], np.int64).reshape(-1, 2) + np.repeat(offset, counts)[:, None]
        signs = BASE[codes]
        digit = (signs >= 48) & (signs <= 57)
        at = np.flatnonzero(digit | ((signs >= 97) & (signs <= 122)) | _letters()[signs])
        n = len(at)
        s = np.where(digit, 48, signs)[at].astype(np.uint32)
        han = _is_han(s)
        gap = np.append(np.diff(at), 2)
        behind, second = (codes[np.minimum(at + k, len(codes) - 1)] if len(codes) else codes for k in (1, 2))
        token_end = han | (gap > 1) | np.append(han[1:], True)
        event = np.where(token_end, 2, 0)
        blank = (gap > 1) & ((behind == 32) | (behind == 0x3000) | (behind == 10) | (behind == 0xA0))
        nxt = np.append(codes[at[1:]], 0)
        event[blank & (((nxt >= 65) & (nxt <= 90)) | ((nxt >= 0xC0) & (nxt <= 0xDE)))] = 3
        # a Han sign, one blank and a Han sign or a figure: a new unit without any mark
        event[blank & (gap == 2) & han & np.append(han[1:] | (s[1:] == 48), False)] = 1
        ends = np.searchsorted(at, flat[:, 1], "left") - 1
        final = np.zeros(len(flat), bool)
        final[np.cumsum(counts)[counts > 0] - 1] = True
        event[ends[~final & (ends >= 0)]] = 1
        stop = np.where((behind == 0x2026) | ((behind == 46) & (second == 46)), 2, (behind == 46).astype(np.int64))
        # nothing is known about the last token of a text
        lo, hi = np.searchsorted(at, offset, "left"), np.searchsorted(at, offset + sizes, "left") - 1
        token = np.cumsum(np.concatenate([[True], token_end[:-1]])) if n else np.zeros(0, np.int64)
        some = hi >= lo
        unknown = np.zeros((token[-1] if n else 0) + 1, bool)
        unknown[token[hi[some]]] = True
        event[unknown[token]] = 0
        starts = np.searchsorted(at, flat[:, 0], "left")
        shift = np.searchsorted(starts, np.arange(n), "right")
        self.signs = np.insert(s, starts, 1)
        where = np.arange(n) + shift
        self.event, self.stop = np.zeros(len(self.signs), np.int64), np.zeros(len(self.signs), np.int64)
        self.event[where], self.stop[where] = event, stop
        self.first, self.last = np.full(len(texts), -1), np.full(len(texts), -1)
        self.first[some], self.last[some] = where[lo[some]] - 1, where[hi[some]]
        # where a text has signs before its first unit begins there is none; its first sign is then the first place
        self.first[some] = np.maximum(self.first[some], 0)


def _hashes(s: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of the last k signs at each place from k - 1 on."""
    with np.errstate(over="ignore"):
        h1 = (s.astype(np.uint64) + np.uint64(11)) * np.uint64(0xBF58476D1CE4E5B9)
        h1 ^= h1 >> np.uint64(31)
        b3 = _B * _B * _B
        b6 = b3 * b3
        b12 = b6 * b6
        h3 = (h1[:-2] * _B + h1[1:-1]) * _B + h1[2:]
        h6 = h3[:-3] * b3 + h3[3:]
        h12 = h6[:-6] * b6 + h6[6:]
        h24 = h12[:-12] * b12 + h12[12:]
        return {k: ((h ^ np.uint64(k)) * _B).view(np.int64) for k, h in ((6, h6), (12, h12), (24, h24))}


def _final(text: str) -> tuple[str, str, bool, list[tuple[int, int]], bool]:
    """(text without cut mark, class of its end, whether a heading, its units, whether it had a mark)."""
    t = text.rstrip(" \t\r\n　\xa0\u200b\ufeff")
    m = _MARK.search(t, max(0, len(t) - 16))
    if m:
        t = t[: m.start()].rstrip()
    if not t:
        return t, "none", False, [], bool(m)
    spans, tail = split_spans(t), max(0, len(t) - 8)
    unit = t[spans[-1][0] :] if spans else t
    single = len(spans) == 1 and spans[0][0] == len(t) - len(t.lstrip())
    heading = single and len(unit) <= 48 and bool(_HEADING.match(unit.translate(KEEP_LENGTH)))
    flat = unit.replace("（", "(").replace("）", ")").replace("｢", "「").replace("｣", "」")
    if any(flat.count(o) > flat.count(c) for o, c in _PAIRS.items()) or flat.count('"') % 2:
        kind = "open"
    elif m := _STRONG.search(t, tail):
        kind = "quoted" if len(m.group().strip()) > 1 and m.group().strip()[-1] in "\"”»」』" else "strong"
    elif (m2 := _DOT.search(t, tail)) and m2.group().strip()[-1] in "\"”»」』":
        kind = "quoted"
    elif m2:
        w = _DOTTED_WORD.search(t, max(0, len(t) - 24))
        kind = "abbreviation" if w and w.group(1).lower() in NEVER_FINAL - MAYBE_FINAL and len(w.group(1)) > 1 else "dot"
    elif t[-1] in _OPEN_END:
        kind = "open"
    elif t[-1] in ")）]】》」』»”\"":
        kind = "closed"
    else:
        kind = "none"
    return t, kind, heading, spans, bool(m)


def _last_word(t: str) -> str | None:
    """The letters a text ends in, however many, in small letters; None where it ends in none."""
    e = len(t)
    while e and t[e - 1].isalpha() and not "一" <= t[e - 1] <= "鿿":
        e -= 1
    return t[e:].lower() or None


_VALUE_SCHEMA = pa.schema(
    [("t", pa.int32()), ("ord", pa.int64()), ("source", pa.string()), ("len", pa.int32()), ("kind", pa.string()), ("heading", pa.bool_()),
     ("marked", pa.bool_()), ("single", pa.bool_()), ("short", pa.bool_()), ("word", pa.string()), ("c24", pa.int64()), ("c12", pa.int64()),
     ("c6", pa.int64()), ("bare", pa.string()), ("spans", pa.list_(pa.int32()))]
)
BATCH = 2000


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: how each value ends, its units, and the contexts it asks for."""
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            rows = [r for r in zip(*(c.to_pylist() for c in b.slice(lo, BATCH).columns), strict=True) if r[3] and not r[3].isspace()]
            if not rows:
                continue
            finals = [_final(r[3]) for r in rows]
            x = _Streams([f[0] for f in finals], [f[3] for f in finals])
            size = np.where(x.last >= 0, x.last - x.first + 1, 0)
            figures = np.cumsum(x.signs == 48)
            hashes, contexts = _hashes(x.signs), []
            for k in CONTEXTS:
                h = hashes[k]
                ok = (size >= k) & (x.last >= k - 1)
                end = np.where(ok, x.last, k - 1)
                if len(h):
                    # figures alone are no context
                    inside = figures[end] - np.where(end >= k, figures[np.maximum(end - k, 0)], 0)
                    ok &= inside < k - 1
                    contexts.append(pa.array(h[np.minimum(end - k + 1, len(h) - 1)], pa.int64(), mask=~ok))
                else:
                    contexts.append(pa.nulls(len(rows), pa.int64()))
            words = [_last_word(f[0]) if f[1] == "none" else None for f in finals]
            yield _rows(
                [
                    [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [len(r[3]) for r in rows], [f[1] for f in finals], [f[2] for f in finals],
                    [f[4] for f in finals], [len(f[3]) == 1 and len(f[0]) <= 40 for f in finals], size <= 6, words,
                    *contexts, [f[0] for f in finals], [[p for ab in f[3] for p in ab] for f in finals],
                ],
                _VALUE_SCHEMA,
            )


_EVENT_SCHEMA = pa.schema([("h", pa.int64()), ("word", pa.string())] + [(c, pa.int64()) for c in COUNTS])
_WORD = re.compile(r"[^\W\d_一-鿿]+")


def _events(bits: int, table: bytes):
    """Second pass: what follows the contexts asked for, and the words of the corpus, counted per batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, mask = np.frombuffer(table, np.uint64), (1 << bits) - 1
        words: Counter = Counter()
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                texts, spans = part.column(0).to_pylist(), [list(zip(x[::2], x[1::2], strict=True)) for x in part.column(1).to_pylist()]
                for t in texts:
                    ws = _WORD.findall(t.lower())
                    words.update(ws[:-1] if ws and t and t[-1].isalpha() else ws)
                x = _Streams(texts, spans)
                if len(x.signs) <= 24:
                    continue
                begin = np.zeros(len(x.signs), np.int64)
                begin[x.first[x.first >= 0]] = x.first[x.first >= 0]
                begin = np.maximum.accumulate(begin)
                place = np.flatnonzero(x.event)
                for k, h in _hashes(x.signs).items():
                    at = place[place - begin[place] + 1 >= k]
                    hk = h[at - k + 1]
                    slot = hk & mask
                    sel = ((asked[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                    at, hk = at[sel], hk[sel]
                    if not len(at):
                        continue
                    keys, inv = np.unique(hk, return_inverse=True)
                    e, d = x.event[at], x.stop[at]
                    wanted = (e == 1, e == 2, e == 3, (e == 1) & (d == 1), (e == 2) & (d == 1), (e == 1) & (d == 2), (e == 2) & (d == 2))
                    counts = [np.bincount(inv, weights=w, minlength=len(keys)).astype(np.int64) for w in wanted]
                    yield _rows([keys, pa.nulls(len(keys), pa.string()), *counts], _EVENT_SCHEMA)
            if len(words) > 50_000:
                yield from _word_rows(words)
        yield from _word_rows(words)

    return work


def _word_rows(words: Counter) -> Iterator[pa.RecordBatch]:
    if words:
        z = np.zeros(len(words), np.int64)
        yield _rows([pa.nulls(len(words), pa.int64()), list(words), np.fromiter(words.values(), np.int64, len(words)), *[z] * (len(COUNTS) - 1)], _EVENT_SCHEMA)
        words.clear()


def _share(ends: str, goes: str, contexts: tuple[int, ...] = CONTEXTS) -> Column:
    """Share of ends after the longest context with enough cases; null where none has."""
    sums = [(F.col(f"e{k}.{ends}"), F.col(f"e{k}.{ends}") + F.col(f"e{k}.{goes}")) for k in contexts]
    return F.coalesce(*[F.when(n >= CASES, e / n) for e, n in sums])


def judged(values: DataFrame) -> DataFrame:
    """Verdict for every non-blank value of (t int, ord, source, text): t, ord, source, ``cut`` and the evidence."""
    passed = written(values.mapInArrow(_ends, _ddl(_VALUE_SCHEMA)))  # read by both halves: units are found once
    ends = passed.drop("bare", "spans")
    asked = ends.select("t", "ord", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("h")) for k in CONTEXTS])).alias("x"))
    asked = asked.where("x.h IS NOT NULL").select("t", "ord", "x.k", "x.h")
    n = asked.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    bits = min(max(LEAST_BITS, (ROOM * n).bit_length()), MOST_BITS)
    slot = asked.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("s"))
    marked = slot.selectExpr("cast(shiftright(s, 6) as int) AS i", "shiftleft(1L, cast(s & 63 as int)) AS b")
    # 64 slots a row: at most 2**21 rows come to the driver
    marked = marked.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[marked["i"].to_numpy()] = marked["b"].to_numpy()
    counts = passed.select("bare", "spans").mapInArrow(_events(bits, table.tobytes()), _ddl(_EVENT_SCHEMA))
    counts = cut_lineage(counts.groupBy("h", "word").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    events = counts.where("h IS NOT NULL").select("h", F.struct(*COUNTS).alias("e"))
    # one row a value: the counts of its contexts
    seen = asked.join(events, "h").groupBy("t", "ord").agg(*[F.max(F.when(F.col("k") == k, F.col("e"))).alias(f"e{k}") for k in CONTEXTS])
    words = counts.where(f"word IS NOT NULL AND ends >= {WORD_CASES}").select("word", F.col("ends").alias("n"))
    prefix = F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, 1, k))")
    prefixes = words.where("length(word) > 1").select(F.explode(prefix).alias("word"), "n")
    trie = (
        words.select("word", F.col("n").alias("as_word"), F.lit(0).cast("bigint").alias("as_prefix"))
        .unionByName(prefixes.select("word", F.lit(0).cast("bigint").alias("as_word"), F.col("n").alias("as_prefix")))
        .groupBy("word")
        .agg(F.sum("as_word").alias("as_word"), F.sum("as_prefix").alias("as_prefix"))
    )
    lengths = ends.groupBy("t", "source", "len").agg(F.count("*").alias("n")).select(F.col("t").alias("lt"), F.col("source").alias("ls"), F.col("len").alias("ll"), "n")
    totals = lengths.groupBy("lt", "ls").agg(F.sum("n").alias("all_n")).select(F.col("lt").alias("tt"), F.col("ls").alias("ts"), "all_n")
    limits = (
        lengths.join(totals, (F.col("lt") == F.col("tt")) & F.col("ls").eqNullSafe(F.col("ts")))
        .where((F.col("n") >= LIMIT_CASES) & (F.col("n") >= LIMIT_SHARE * F.col("all_n")))
        .select("lt", "ls", "ll")
    )
    # values without a word to look up are spread by a key of their own, not gathered under null
    own = F.coalesce("word", F.concat(F.lit("\0"), F.col("ord").cast("string")))
    got = (
        ends.join(seen, ["t", "ord"], "left")
        .withColumn("asked_word", own)
        .join(trie.withColumnRenamed("word", "asked_word"), "asked_word", "left")
        .join(limits, (F.col("t") == F.col("lt")) & F.col("source").eqNullSafe(F.col("ls")) & (F.col("len") == F.col("ll")), "left")
    )
    kind = F.col("kind")
    share = F.when(kind == "dot", _share("dot_ends", "dot_goes")).otherwise(_share("ends", "goes"))
    longest = F.coalesce(*[F.col(f"e{k}") for k in CONTEXTS])
    title = F.col("single") & (kind == "none") & (longest["open"] >= CASES) & (longest["goes"] * 20 <= longest["open"])
    inside_word = F.col("word").isNotNull() & (F.coalesce("as_word", F.lit(0)) == 0) & (F.coalesce("as_prefix", F.lit(0)) > 0)
    at_limit = F.col("ll").isNotNull()
    # a full stop: only a stop that never ends anything here, or the limit of the source, speaks against it
    stop_cut = (_share("dot_ends", "dot_goes", CONTEXTS[:2]) < NEVER) | (at_limit & (share < 2 * NEVER))
    # dots: sentences that end in dots do so after this context, and the source has no limit here
    dots_end = F.col("marked") & ~at_limit & (_share("dots_end", "dots_go") >= END_SHARE)
    # no mark at all: hardly any cut meets the end of a clause by chance, unless at a limit
    least = F.when(at_limit | F.col("marked"), END_SHARE).otherwise(CLAUSE_SHARE)
    cut = (
        F.when(F.col("heading") | F.coalesce(title, F.lit(False)), False)
        .when(kind.isin("open", "abbreviation"), True)
        .when(kind == "strong", False)
        .when(kind == "quoted", F.coalesce(share < NEVER, F.lit(False)))
        .when(inside_word, True)
        .when(F.col("short") & ~F.col("marked"), False)
        .when(F.coalesce(dots_end, F.lit(False)), False)
        .when(kind == "dot", F.coalesce(stop_cut, F.lit(False)))
        .otherwise(F.coalesce(share < least, kind == "none"))
    )
    return got.select("t", "ord", "source", "len", "kind", share.alias("end_share"), inside_word.alias("inside_word"), at_limit.alias("at_limit"), cut.alias("cut"))


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "bigint", "string": "string", "bool": "boolean", "list<item: int32>": "array<int>", "list<element: int32>": "array<int>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def field_values(df: DataFrame, number: int, source_col: str, text_col: str) -> DataFrame:
    """One column in the form ``judged`` takes."""
    return df.select(F.lit(number).alias("t"), df["ord"].cast("bigint").alias("ord"), df[source_col].cast("string").alias("source"), df[text_col].alias("text"))


def cut_values(tables: dict[str, DataFrame]) -> DataFrame:
    """``judged`` over several columns, with the table's name; ``tables`` maps names to ``field_values`` rows numbered 0, 1, ..."""
    frames = list(tables.values())
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    name = F.element_at(F.array(*[F.lit(n) for n in tables]), F.col("t") + 1)
    return judged(every).withColumn("table_name", name)


def cut_shares(verdicts: DataFrame) -> DataFrame:
    """Share of cut values of each source."""
    return verdicts.groupBy("table_name", "source").agg(
        F.count("*").alias("values"), F.count_if("cut").alias("cut_values"), F.round(F.avg(F.col("cut").cast("double")), 4).alias("cut_share")
    )
