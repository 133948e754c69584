"""Generated metadata on files: discovery, inspection, choice of the latest valid one; regression packs; vector indexes."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST_FIELDS = ("case_summary", "holding", "legal_basis", "disputed_issues")
CORE_FIELDS = ("authoritative_case_number", "authoritative_decision_date", "court", "language", "case_type")
# Priority of an artifact by its file name, the first that holds wins.
NAME_PRIORITIES = (("holds", "expanded_current_default_model_generation_batch_output", 3), ("begins", "model_output__", 2), ("holds", "model_generated_metadata_output", 1))
REPORT_ENDS = ("_report.txt", "_generation_report.txt")


def discover(fixed: list[str], pattern: str) -> list[str]:
    """Fixed paths and those of a pattern, each once, in order; names only, the files are read by ``inspected``."""
    return list(dict.fromkeys([*fixed, *sorted(glob.glob(pattern))]))


def case_number(payload: Column) -> Column:
    """Case number of a record (variant): of its core, of the record, or under its other name."""
    get = lambda path: F.trim(F.coalesce(F.try_variant_get(payload, path, "string"), F.lit("")))
    return F.coalesce(*[F.nullif(get(p), F.lit("")) for p in ("$.core_case_metadata.authoritative_case_number", "$.authoritative_case_number", "$.case_number")], F.lit(""))


def compatible(payload: Column) -> Column:
    """Whether a record (variant) has any digest field, in its digest or else at its top."""
    digest = F.try_variant_get(payload, "$.generated_digest_metadata", "variant")
    names = lambda v: F.json_object_keys(F.to_json(v))
    held = F.coalesce(names(F.when(digest.isNotNull(), digest).otherwise(payload)), F.array().cast("array<string>"))
    return F.arrays_overlap(held, F.array(*[F.lit(f) for f in DIGEST_FIELDS]))


def comparable(payload: Column) -> Column:
    """Whether a record (variant) has every core key and every digest key, so that runs can be compared on it."""
    keys = lambda path: F.coalesce(F.json_object_keys(F.to_json(F.try_variant_get(payload, path, "variant"))), F.array().cast("array<string>"))
    has = lambda path, names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), keys(path))) == 0
    return has("$.core_case_metadata", CORE_FIELDS) & has("$.generated_digest_metadata", DIGEST_FIELDS)


def name_priority(path: Column) -> Column:
    """3 to 0 by the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = None
    for how, part, n in NAME_PRIORITIES:
        test = F.contains(name, F.lit(part)) if how == "holds" else F.startswith(name, F.lit(part))
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.otherwise(0)


def inspected(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per artifact (JSON lines): path, distinct cases, whether all lines parse, whether any fits the schema, time, priority, report beside it.

    Missing files have no row. A file with one bad line counts as not parseable.
    """
    there = [p for p in paths if os.path.isfile(p)]
    schema = "path string, case_count bigint, parseable boolean, schema_compatible boolean, modified timestamp, priority int, has_report boolean"
    if not there:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(there).select(F.col("_metadata.file_path").alias("path"), "value")
    # an empty file has no line but still a row
    files = spark.createDataFrame([(p, os.path.getmtime(p)) for p in there], "path string, m double").select("path", F.timestamp_seconds("m").alias("modified"))
    payload = F.try_parse_json("value")
    x = lines.where(F.trim("value") != "").select(F.regexp_replace("path", "^file:/*", "/").alias("path"), payload.alias("p"))
    ok = F.coalesce(F.schema_of_variant("p").startswith("OBJECT"), F.lit(False))
    g = x.groupBy("path").agg(
        F.count_distinct(F.when(ok, F.nullif(case_number(F.col("p")), F.lit("")))).alias("case_count"), F.bool_and(ok).alias("parseable"),
        F.bool_or(F.coalesce(ok & compatible(F.col("p")), F.lit(False))).alias("schema_compatible"),
    )
    reports = [p for p in there if any(os.path.exists(p.rsplit(".", 1)[0] + e) for e in REPORT_ENDS)]
    listed = F.col("path").isin(reports) if reports else F.lit(False)
    f = files.join(g, "path", "left")
    good = F.coalesce("parseable", F.lit(True))
    return f.select(
        "path", F.when(good, F.coalesce("case_count", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("case_count"), good.alias("parseable"),
        (good & F.coalesce("schema_compatible", F.lit(False))).alias("schema_compatible"), "modified", name_priority(F.col("path")).alias("priority"), listed.alias("has_report"),
    )


def latest_valid(found: DataFrame) -> DataFrame:
    """The valid artifact (parseable, fitting, with cases) latest by time, then priority, report and path; no row where none is valid."""
    valid = found.where("parseable AND schema_compatible AND case_count > 0")
    best = valid.agg(F.max_by(F.struct("path", "case_count", "modified"), F.struct("modified", "priority", F.col("has_report").cast("int").alias("r"), "path")).alias("b"))
    return best.where("b IS NOT NULL").select("b.*", F.lit("auto_latest").alias("source"))


RULE = "struct<rule_type:string,rank:int,top_k:int,case_number:string,case_numbers:array<string>>"
PACK = f"query_id string, query_text string, route_hint string, expected_behavior string, expected_case_numbers array<string>, pass_rule {RULE}"
PACK_FIELDS = ("query_id", "query_text", "route_hint", "expected_behavior", "pass_rule")


def regression_pack(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a pack, a JSON array of objects; a missing required field fails the read, with the place of the entry."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = whole.where(F.assert_true(F.schema_of_variant("v").startswith("ARRAY"), F.lit("the pack is no JSON array")).isNull())
    rows = listed.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "e"))
    missing = F.filter(F.array(*[F.lit(f) for f in PACK_FIELDS]), lambda f: ~F.array_contains(F.coalesce(F.json_object_keys(F.to_json("e")), F.array().cast("array<string>")), f))
    checked = rows.where(F.assert_true(F.size(missing) == 0, F.format_string("entry %s lacks %s", (F.col("i") + 1).cast("string"), F.array_join(missing, ", "))).isNull())
    return checked.select(F.from_json(F.to_json("e"), T.StructType.fromDDL(PACK)).alias("q")).select("q.*")


def save_index(vectors: DataFrame, path: str, header: dict[str, str]) -> None:
    """A vector index as a table of rows with their vectors, and its header beside it."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    spark.createDataFrame(sorted(header.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(vectors, header) of a saved index; the header is a handful of entries."""
    header = {r.key: r.value for r in spark.read.schema("key string, value string").json(f"{path}/header").collect()}
    return spark.read.parquet(f"{path}/vectors"), header
