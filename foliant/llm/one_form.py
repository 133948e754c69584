"""One consistent form for texts that look the same.

DuckDB runs inside Arrow partitions: embedded SQL folds width forms, blanks,
look-alike letters and ligatures with ``translate``/``replace``, drops shapeless
characters with a regular expression and composes accents with
``nfc_normalize``. Raised signs, circled figures and Han variants stay as they
are. A joiner between Arabic or Indic letters is kept, as it changes their shape. The
one form is for comparing; beside it a readable form keeps words of one script in that
script and puts look-alike letters right only inside words of mixed script. Only
fixed-size digests leave the partitions, so the search for equal
looks shuffles some 50 bytes a row whatever the length of the texts.

Defined results: null, empty and blank texts take part in nothing; equal texts
are no pair; repeated rows pair with every row of the other spelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import cut_lineage

from .charforms import INVISIBLE_CLASS, ONE_FORM


#: parts of a hot key in the joins of pairs
SALTS = 8
INVISIBLE_SQL = f"[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F{INVISIBLE_CLASS}]"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _block_of(c: str) -> str:
    lo = ord(c) & ~0x0F
    return f"\\x{{{lo:X}}}-\\x{{{lo + 0x0F:X}}}"


def _group(c: str) -> str:
    """Characters met together; a text goes through the table of a group only where it holds any of the group."""
    if 0xFF00 <= ord(c) <= 0xFFEF or ord(c) < 0x100 or 0x2000 <= ord(c) <= 0x206F or c == "　":
        return "width and blanks"
    if 0x2E80 <= ord(c) <= 0x2FDF:
        return "radicals"
    return "letters" if 0x0250 <= ord(c) <= 0x058F else "others"


#: a joiner that shapes the letters around it, and the sign that stands for it while the others are dropped
_SHAPED = "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{0900}-\\x{0DFF}"
STAND_IN = "\ue0cc"
JOINED, KEPT = f"([{_SHAPED}])\\x{{200C}}([{_SHAPED}])", f"\\1{STAND_IN}\\2"


def _table_step(table: dict[str, str]) -> str:
    one = {k: v for k, v in table.items() if len(v) == 1}
    expr = f"translate(c, {_sql_text(''.join(one))}, {_sql_text(''.join(one.values()))})" if one else "c"
    expr = reduce(lambda e, kv: f"replace({e}, {_sql_text(kv[0])}, {_sql_text(kv[1])})", ((k, v) for k, v in table.items() if len(v) > 1), expr)
    held = "[" + "".join(sorted({_block_of(k) if ord(k) > 0xFF else f"\\x{{{ord(k):X}}}" for k in table})) + "]"
    return f"CASE WHEN regexp_matches(c, {_sql_text(held)}) THEN {expr} ELSE c END"


def _steps() -> tuple[list[str], str]:
    """SQL expressions over column ``c``, applied one after the other; and the last one, for look-alike letters."""
    steps = ["replace(c, chr(13) || chr(10), chr(10))"]
    bad = _sql_text(INVISIBLE_SQL)
    # twice, as letters with joiners on both sides are met once only
    shaped = f"regexp_replace(regexp_replace(c, {_sql_text(JOINED)}, {_sql_text(KEPT)}, 'g'), {_sql_text(JOINED)}, {_sql_text(KEPT)}, 'g')"
    steps.append(f"CASE WHEN contains(c, chr(8204)) THEN {shaped} ELSE c END")
    steps.append(f"CASE WHEN regexp_matches(c, {bad}) THEN regexp_replace(c, {bad}, '', 'g') ELSE c END")
    steps.append(f"replace(c, {_sql_text(STAND_IN)}, chr(8204))")
    groups: dict[str, dict[str, str]] = {}
    for k, v in ONE_FORM.items():
        groups.setdefault(_group(k), {})[k] = v
    letters = groups.pop("letters")
    return [*steps, *map(_table_step, groups.values())], _table_step(letters)


def one_form_query(source: str, text: str, others: str, readable: bool = False) -> str:
    """DuckDB query over ``source`` giving the columns ``others``, ``c``, the text in its one form, and on demand ``r``, the readable one."""
    sql = f"SELECT {others}, {text} AS raw, {text} AS c FROM {source}"
    steps, letters = _steps()
    for step in steps:
        sql = f"SELECT {others}, raw, {step} AS c FROM ({sql})"
    r = ""
    if readable:
        word = letters.replace("(c,", "(w,").replace("ELSE c END", "ELSE w END")
        mixed = f"CASE WHEN regexp_matches(w, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]') THEN {word} ELSE w END"
        lines = f"list_transform(string_split(c, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda w: {mixed}), ' '))"
        sql = f"SELECT {others}, raw, c, nfc_normalize(array_to_string({lines}, chr(10))) AS r FROM ({sql})"
        r = ", r"
    return f"SELECT {others}, raw, nfc_normalize(c) AS c{r} FROM (SELECT {others}, raw, {letters} AS c{r} FROM ({sql}))"


def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": ""})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    sql = f"SELECT ord, md5(c) AS look, md5(raw) AS spelling FROM ({one_form_query('src', 't', 'ord')}) WHERE trim(c, ' ' || chr(10)) <> ''"
    for b in batches:
        for lo in range(0, b.num_rows, 4000):
            con.register("src", pa.Table.from_batches([b.slice(lo, 4000)]))
            yield from con.sql(sql).to_arrow_table().cast(_DIGEST_ARROW).to_batches()
            con.unregister("src")


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _duck()
    sql = f"SELECT ord, c AS one_form, r AS readable_form FROM ({one_form_query('src', 't', 'ord', readable=True)})"
    schema = pa.schema([("ord", pa.int64()), ("one_form", pa.string()), ("readable_form", pa.string())])
    for b in batches:
        for lo in range(0, b.num_rows, 4000):
            con.register("src", pa.Table.from_batches([b.slice(lo, 4000)]))
            yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
            con.unregister("src")


_DIGEST_ARROW = pa.schema([("ord", pa.int64()), ("look", pa.string()), ("spelling", pa.string())])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("bigint").alias("ord"), df[text_col].alias("t"))


def one_form(df: DataFrame, id_col: str = "ord", text_col: str = "chunk_text") -> DataFrame:
    """One row (ord, one_form, readable_form) per row: the text in the form for comparing and in that for reading; null stays null."""
    return _source(df, id_col, text_col).mapInArrow(_forms, "ord bigint, one_form string, readable_form string")


def look_alike_pairs(df: DataFrame, id_col: str = "ord", text_col: str = "chunk_text") -> DataFrame:
    """Pairs (ord_a, ord_b), ord_a < ord_b, of rows whose texts differ but look the same.

    Rows are first reduced to (look, spelling) classes with map-side counts, so the
    work is bound by the result: two classes are joined only where their looks are
    equal and their spellings differ, and copies of one spelling never meet.
    """
    rows = (
        _source(df, id_col, text_col)
        .where((F.length("t") > 0) & F.col("ord").isNotNull())
        .mapInArrow(_digests, "ord bigint, look string, spelling string")
        .select("ord", F.unhex("look").alias("look"), F.unhex("spelling").alias("spelling"))
    )
    rows = cut_lineage(rows)  # text work is done once; the rest reads the digests
    several = (
        rows.groupBy("look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("look")
    )
    rows = rows.join(several, "look", "left_semi")
    spellings = rows.select("look", "spelling").distinct()
    a, b = spellings.alias("a"), spellings.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.spelling") < F.col("b.spelling"))).select(
        F.col("a.look").alias("look"), F.col("a.spelling").alias("sa"), F.col("b.spelling").alias("sb")
    )
    # a popular text is a key of both joins: its rows are spread by salt, the other side is repeated for each salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = rows.select("look", F.col("spelling").alias("sa"), F.col("ord").alias("oa"), F.pmod(F.xxhash64("ord"), F.lit(SALTS)).cast("int").alias("salt"))
    right = rows.select("look", F.col("spelling").alias("sb"), F.col("ord").alias("ob"), salts.alias("salt"))
    return (
        pairs.withColumn("salt", salts)
        .join(left, ["look", "sa", "salt"])
        .join(right, ["look", "sb", "salt"])
        .select(F.least("oa", "ob").alias("ord_a"), F.greatest("oa", "ob").alias("ord_b"))
    )
