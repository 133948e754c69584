"""Text functions as Spark column expressions; only ``nfkc`` needs Arrow.

Every function gives null for null, and '' stays ''.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
# Accented small letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
HAN = "一-鿿"
#: every kind of blank, in a form that Java and RE2 read alike
BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]"
LATIN_WORD = r"[a-zà-öø-ÿ]+(?:[-'][a-zà-öø-ÿ]+)*"
REFERENCE = r"[a-z0-9]+(?:[./_-][a-z0-9]+)+"
CASE_REFERENCE = r"(?:proc\.?[ \t\n]*)?[a-z]{0,6}[ \t\n]*[0-9]{1,5}[ \t\n]*/[ \t\n]*[0-9]{2,4}"
CASE_NUMBER = r"\b[0-9]{1,5}/[0-9]{4}\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfkc(c: Column) -> Column:
    """Unicode compatibility form."""
    return F.arrow_udf(_nfkc, T.StringType())(c)


def _nfkc(x: pa.Array) -> pa.Array:
    # the Arrow kernel of some builds decomposes without composing again
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())


def half_width(c: Column) -> Column:
    """Full-width ASCII to half width, the part of NFKC that stays in the JVM."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def fold_accents(c: Column) -> Column:
    """Small letters without Latin accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    """Every run of blanks to one space, outer blanks off."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def squeeze_ends(c: Column) -> Column:
    """Outer blanks of every kind off."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def keep_paragraphs(c: Column) -> Column:
    """LF line ends, blanks of a line squeezed, lines trimmed, at most one blank line."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "(?m)^ | $", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def multiline(c: Column) -> Column:
    """``keep_paragraphs`` after no-break spaces became spaces and byte-order marks are gone."""
    return keep_paragraphs(F.translate(c, "\u00a0\ufeff", " "))


def without_lines(c: Column, equal: tuple[str, ...] = (), holding: tuple[str, ...] = ()) -> Column:
    """Lines dropped that equal one of ``equal`` (trimmed, any case) or hold one of ``holding``."""

    def keep(line: Column) -> Column:
        ok = ~F.lower(F.trim(line)).isin(*[e.lower() for e in equal]) if equal else F.lit(True)
        for h in holding:
            ok = ok & ~F.contains(line, F.lit(h))
        return ok

    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def ranking_text(c: Column) -> Column:
    """Small letters, everything but letters, figures and blanks to a space, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]", " "), " +", " "))


def clip(c: Column, n: int) -> Column:
    """At most n characters, the last three of a cut text being dots."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def preview(c: Column, n: int = 220) -> Column:
    """Squeezed text, dots added behind n characters."""
    s = squeeze(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("...")))


def clean_preview(c: Column, n: int = 180) -> Column:
    """Squeezed text of at most n characters, an ellipsis being the last of a cut one."""
    s = squeeze(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("…")))


def spaced_sentences(c: Column) -> Column:
    """Parts after a terminator that blanks follow (a text without such blanks stays whole)."""
    return F.filter(F.transform(F.split(c, r"(?<=[。.!?；;])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def case_key(c: Column) -> Column:
    """Case number for equality: half width, small letters, no blanks."""
    return F.regexp_replace(F.lower(half_width(c)), BLANK, "")


def case_identity(c: Column) -> Column:
    """First case number in a text, leading zeros off, suffix in capitals; null where there is none."""
    t = half_width(c)
    head, year = F.regexp_extract(t, r"([0-9]{1,6})\s*/\s*([0-9]{4})", 1), F.regexp_extract(t, r"([0-9]{1,6})\s*/\s*([0-9]{4})", 2)
    suffix = F.upper(F.regexp_extract(t, r"[0-9]{1,6}\s*/\s*[0-9]{4}\s*[-/]\s*([A-Za-z]{1,3})\b", 1))
    number = F.concat(F.regexp_replace(head, r"^0+(?=[0-9])", ""), F.lit("/"), year)
    return F.when(head != "", F.when(suffix != "", F.concat(number, F.lit("-"), suffix)).otherwise(number))


def replace_variants(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Variants to canonical terms, the longest first, one after the other."""
    out = c
    for k, v in sorted((variants or lexicon.VARIANTS).items(), key=lambda kv: -len(kv[0])):
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def expansion_terms(c: Column, expansions: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Expansions of the concepts a text holds that it does not hold already, in order, each once."""
    parts = []
    for concept, terms in (expansions or lexicon.EXPANSIONS).items():
        listed = F.array(*[F.lit(t) for t in terms])
        parts.append(F.when(F.contains(c, F.lit(concept)), listed).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(*parts), lambda t: ~F.contains(F.lower(c), F.lower(t))))


def count_held(c: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text holds."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t)))


def occurrences(c: Column, term: str) -> Column:
    """How often a term occurs, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def _pairs(c: Column) -> Column:
    """Every pair of neighbouring Han signs; one pass of a pattern that consumes nothing."""
    return F.regexp_extract_all(c, F.lit(f"(?=([{HAN}]{{2}}))"))


def han_tokens(c: Column, hints: tuple[str, ...] = lexicon.HINTS) -> Column:
    """The Han runs, the pairs of signs in them, and of every run the hints it holds."""
    runs = F.regexp_extract_all(c, F.lit(f"([{HAN}]+)"))
    if not hints:
        return F.concat(runs, _pairs(c))
    listed = F.array(*[F.lit(h) for h in hints])
    held = F.flatten(F.transform(runs, lambda r: F.filter(listed, lambda h: F.contains(r, h))))
    # few texts hold any hint: only their runs are looked at one by one
    some = c.rlike("|".join(hints))
    return F.concat(runs, _pairs(c), F.when(some, held).otherwise(F.array().cast("array<string>")))


def mixed_tokens(c: Column, hints: tuple[str, ...] = lexicon.HINTS) -> Column:
    """Tokens of a mixed Latin and Han text, repeated ones kept.

    Case references without blanks, other references, Latin words each with its
    accent-free twin, Han runs with pairs and hints. A case reference is met by
    the second pattern too and so counts twice, on purpose.
    """

    def of(t: Column) -> Column:
        cases = F.transform(
            F.regexp_extract_all(t, F.lit(rf"(?U)(?<![\p{{L}}\p{{N}}_])({CASE_REFERENCE})(?![\p{{L}}\p{{N}}_])")),
            lambda x: F.replace(F.regexp_replace(x, r"\s+", ""), F.lit("proc."), F.lit("proc")),
        )
        words = F.regexp_extract_all(t, F.lit(f"({LATIN_WORD})"))
        with_twins = let(words, lambda ws: F.concat(ws, F.array_compact(F.transform(ws, lambda w: F.nullif(F.translate(w, ACCENTED, PLAIN), w)))))
        return F.concat(cases, F.regexp_extract_all(t, F.lit(f"({REFERENCE})")), with_twins, han_tokens(t, hints))

    return let(F.trim(F.lower(nfkc(c))), of)


def tokenizer(mode: str = "deterministic", segment: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """Tokens by mode: ``deterministic``; ``auto`` adds the Han words of a dictionary segmenter if there is one; ``dictionary`` needs one.

    ``segment`` takes a text column and gives an array of words, for example an Arrow function over a segmenting library.
    """
    if mode not in ("deterministic", "auto", "dictionary"):
        raise ValueError(f"no tokenizer mode {mode}")
    if mode == "dictionary" and segment is None:
        raise ValueError("the dictionary mode needs a segmenter")
    if mode == "deterministic" or segment is None:
        return mixed_tokens

    def both(c: Column) -> Column:
        words = F.filter(F.transform(segment(F.lower(nfkc(c))), squeeze_ends), lambda w: w.rlike(f"[{HAN}]"))
        return F.concat(mixed_tokens(c), words)

    return both


def light_tokens(c: Column) -> Column:
    """Latin and figure runs, and Han pairs (single signs kept)."""

    def of(t: Column) -> Column:
        alone = F.regexp_extract_all(t, F.lit(f"(?<![{HAN}])([{HAN}])(?![{HAN}])"))
        return F.concat(F.regexp_extract_all(t, F.lit("([a-zà-öø-ÿ0-9]+)")), alone, _pairs(t))

    return let(F.lower(nfkc(c)), of)


def overlap_tokens(c: Column) -> Column:
    """Distinct runs of letters, figures and Han signs, for overlap scores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(half_width(c)), F.lit(f"([a-zà-öø-ÿ0-9{HAN}]+)")))


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """n-grams over the non-blank characters of a text, and its Han signs."""

    def every(t: Column) -> Column:
        return F.concat(*[F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))")) for n in range(low, high + 1)], F.regexp_extract_all(t, F.lit(f"([{HAN}])")))

    return let(F.regexp_replace(F.lower(nfkc(c)), BLANK, ""), every)


def slug(c: Column, index: Column) -> Column:
    """File-name form of a case number; ``unknown_case_0001`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.format_string("unknown_case_%04d", index)).otherwise(s)


def year_of(c: Column) -> Column:
    """Year of a date text, or unknown_year."""
    y = F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1)
    return F.when(F.coalesce(y, F.lit("")) == "", F.lit("unknown_year")).otherwise(y)


def visible_text(html: Column) -> Column:
    """Lines of text of a page: scripts, styles and tags off, blank lines dropped."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<[^>]+>", " "), "&nbsp;", " ")
    t = F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != ""), "\n")


def labelled(c: Column, labels: tuple[str, ...], stops: tuple[str, ...] = ()) -> Column:
    """Value behind the first of the labels, up to the line end or the first stop label; null where missing."""
    alt = "|".join(labels)
    end = rf"(?:\n|$|{'|'.join(stops)})" if stops else r"(?:\n|$)"
    v = F.trim(F.regexp_extract(c, rf"(?:{alt})[ \t]*[:：][ \t]*(.*?){end}", 1))
    return F.when(v != "", v)


def header(c: Column) -> Column:
    """struct(decision_date, case_number, case_type) of a card line: the first date, the first case number behind it, the rest."""
    line = squeeze(c)
    date = F.regexp_extract(line, r"([0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})", 1)
    rest = F.regexp_extract(line, r"[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}(.*)$", 1)
    case = F.regexp_extract(rest, r"([0-9]{1,5}/[0-9]{4}(?:-[A-Z]{1,3})?)", 1)
    kind = F.trim(F.regexp_replace(F.regexp_extract(rest, r"[0-9]{1,5}/[0-9]{4}(?:-[A-Z]{1,3})?(.*)$", 1), r"^[^\p{L}]+", ""))
    return F.struct(F.nullif(date, F.lit("")).alias("decision_date"), F.nullif(case, F.lit("")).alias("case_number"), F.nullif(kind, F.lit("")).alias("case_type"))


def distinct_ignoring_case(items: Column, limit: int) -> Column:
    """First spelling of each element, case aside, blanks dropped, ``limit`` at most (the feature's own size)."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return let(clean, lambda a: let(F.transform(a, F.lower), lambda low: F.slice(F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, limit)))


def as_list(c: Column, limit: int = 8) -> Column:
    """A delimited text, or a JSON list of texts, as a clean list; null gives an empty one."""
    listed = F.from_json(c, "array<string>")
    parts = F.when(F.startswith(F.trim(c), F.lit("[")) & listed.isNotNull(), listed).otherwise(F.split(c, "[;；\n、|]"))
    return F.coalesce(distinct_ignoring_case(parts, limit), F.array().cast("array<string>"))


def json_block(c: Column) -> Column:
    """The JSON object inside a text (fences and talk around it dropped); null where there is no valid one."""
    block = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(block).isNotNull() & (block != ""), block)


def block(c: Column, heads: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """Text behind the first heading up to the first stop heading; null where there is no heading."""
    found = F.regexp_extract(c, rf"(?is)(?:{'|'.join(heads)})\s*[:：]?\s*(.+?)(?:{'|'.join(stops)}|$)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def head_and_tail(c: Column, n: int, mark: str = "\n...\n") -> Column:
    """The text if it has at most n characters, else its first and last n/2 around a mark."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n // 2), F.lit(mark), F.right(c, F.lit(n // 2))))


def length_route(c: Column, short: int = 3800, medium: int = 14000) -> Column:
    """short, medium or long."""
    return F.when(F.length(c) <= short, "short").when(F.length(c) <= medium, "medium").otherwise("long")
