"""JSON-lines and whole-document JSON, with explicit schemas and four ways to meet bad lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(path: str) -> bool:
    """Whether a plain local path does not exist; other file systems are left to Spark."""
    return "://" not in path and not any(ch in path for ch in "*?[{") and not os.path.exists(path)


def strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped, any malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Malformed lines and lines that hold no object are dropped; a missing path is an empty table."""
    if _missing(path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    parsed = lines.select(F.from_json("value", f"struct<{ddl}>" if isinstance(schema, str) and not ddl.startswith("struct") else ddl, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("ok"))
    return parsed.where("r IS NOT NULL AND ok IS NOT NULL").select("r.*")


def bad_lines(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """(file, line_no, value) of the lines that are no JSON object; line numbers count from 1 in each file.

    Files are read whole, so this is meant for inspecting hand-sized files.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    bad = (F.trim("line") != "") & (F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{"))
    return lines.where(bad).select("file", (F.col("i") + 1).alias("line_no"), F.col("line").alias(column))


def strict_with_place(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; a malformed line fails the read with its file and line number.

    Lines are parsed where they are; only if one is malformed are the numbers of its
    file's lines counted, by ``bad_lines``.
    """
    bad = bad_lines(spark, path).orderBy("file", "line_no").limit(1).collect() if _malformed(spark, path) else []
    if bad:
        raise ValueError(f"{bad[0].file}, line {bad[0].line_no}: no JSON object")
    return strict(spark, path, schema)


def _malformed(spark: SparkSession, path: str) -> bool:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return not lines.where(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")).isEmpty()


def document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files of one JSON value each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as text, '' for null (typed loader)."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, failing at run time where a required column is null."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return df.where(F.coalesce(F.assert_true(ok, F.lit(f"missing one of {', '.join(columns)}")).isNull(), F.lit(True)))


def window(df: DataFrame, order: str, start: int, end: int | None, language: str | None = None, limit: int = 0) -> DataFrame:
    """Rows of an ordinal range (start included, end not), optionally of one language, case aside, then the first ``limit`` (0: all)."""
    out = df.where(F.col(order) >= start)
    if end is not None:
        out = out.where(F.col(order) < end)
    out = out if not language else out.where(F.lower(F.trim("language")) == language.strip().lower())
    return out.orderBy(order).limit(limit) if limit > 0 else out


def done_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct non-blank ids already written; corrupt lines are skipped, a missing path has none."""
    return lenient(spark, path, f"{key} string").select(F.trim(key).alias(key)).where(f"{key} <> ''").distinct()
