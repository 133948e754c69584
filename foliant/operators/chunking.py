"""Paragraph-aware chunks, as a fold over the paragraphs of a row; no shuffle, no Python.

Defined results: null, empty and blank texts give no chunk; a paragraph beyond
the maximum is cut at the target length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import keep_paragraphs

TARGET, MAXIMUM = 1200, 1600


def fixed_slices(c: Column, size: int = TARGET) -> Column:
    """Slices of ``size`` characters, trimmed, blank ones dropped."""
    starts = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int"))
    cut = F.transform(starts, lambda i: F.regexp_replace(F.substr(c, i * size + 1, F.lit(size)), r"^\s+|\s+$", ""))
    return F.when(F.length(c) > 0, F.filter(cut, lambda s: s != "")).otherwise(F.array().cast("array<string>"))


def chunks(c: Column, target: int = TARGET, maximum: int = MAXIMUM) -> Column:
    """Array of chunks of a text with blank lines between paragraphs."""
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        joined = F.when(acc["open"] != "", F.concat(acc["open"], F.lit("\n\n"), p)).otherwise(p)
        return (
            F.when(F.length(p) > maximum, F.struct(F.concat(flushed, fixed_slices(p, target)).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) <= target, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("open")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    return F.aggregate(paragraphs, start, step, finish)


def chunk_id(case: Column, date: Column, language: Column, index: Column, text: Column) -> Column:
    """case_language_cNNNN_ and twelve hexadecimal figures of sha1 over the identity and the text; slashes of the case as underlines."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (case, date, language, index, text)]
    digest = F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)
    return F.concat_ws("_", F.translate(parts[0], "/", "_"), parts[2], F.format_string("c%04d", index), digest)


def chunk_rows(df: DataFrame, text: str, case: str, date: str, language: str) -> DataFrame:
    """One row per chunk with its index and id; the other columns of ``df`` are kept."""
    cleaned = df.withColumn("__t", keep_paragraphs(F.col(text)))
    rows = cleaned.select(*df.columns, F.posexplode(chunks(F.col("__t"))).alias("chunk_index", "chunk_text"))  # null texts give none
    return rows.withColumn("chunk_id", chunk_id(F.col(case), F.col(date), F.col(language), F.col("chunk_index"), F.col("chunk_text")))
