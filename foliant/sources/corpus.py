"""Case corpus on files: one folder per case with metadata and full text, and a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.text import slug, year_of
from foliant.operators.dedupe import present, unique_suffix
from foliant.operators.ranks import numbered

# Court code of a crawl -> name of the court.
COURTS = {"tui": "終審法院", "tsi": "中級法院", "tjb": "初級法院", "ta": "行政法院"}

MANIFEST = "sentence_id string, authoritative_case_number string, authoritative_decision_date string, language string, court string, year string, case_slug string, metadata_path string, full_text_path string"


def court_name(code, otherwise):
    """Name of the court for a crawl code, else the given value."""
    table = F.create_map(*[F.lit(x) for kv in COURTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(code))), otherwise, F.lit(""))


def layout(df: DataFrame, order: str = "ord") -> DataFrame:
    """Adds language, year, case_slug (unique in its folder) and the relative paths of the corpus layout."""
    x = df.withColumn("language", F.when(present(F.col("language")), F.lower(F.trim("language"))).otherwise("unknown")).withColumn(
        "year", year_of(F.coalesce("authoritative_decision_date", F.lit("")))
    )
    x = x.withColumn("case_slug", slug(F.coalesce("authoritative_case_number", F.lit("")), F.col(order).cast("int")))
    x = unique_suffix(x, ["language", "year"], order, "case_slug")
    base = F.concat_ws("/", F.lit("cases"), "language", "year", "case_slug")
    return x.withColumn("metadata_path", F.concat(base, F.lit("/metadata.json"))).withColumn("full_text_path", F.concat(base, F.lit("/full_text.txt")))


def one_line(c):
    """A text on one line."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def write(df: DataFrame, path: str, mode: str = "overwrite", collapse: bool = False) -> None:
    """Write the corpus as tables partitioned by language and year; ``collapse`` puts each text on one line."""
    x = layout(df)
    if collapse:
        x = x.withColumn("full_text", one_line("full_text"))
    x.write.mode(mode).partitionBy("language", "year").parquet(path)


def write_files(df: DataFrame, root: str, mode: str = "overwrite", collapse: bool = False, order: str = "ord", court_code: str | None = None) -> None:
    """The corpus as folders: metadata.json and full_text.txt of every case, and manifest.jsonl over them.

    The files are written by the tasks that hold the rows; a task run again writes
    the same files again. With ``append`` the folders and the manifest of other cases
    stay, and slugs that exist already get the next suffix. ``court_code`` names the
    column of the crawl's court code; nulls are written as ''.
    """
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    names = [c for c in df.columns if c not in ("full_text", order)]
    x = df
    if mode == "overwrite":
        if files.get_file_info(base).type != fs.FileType.NotFound:
            files.delete_dir(base)
        x = layout(x, order)
    else:
        x = _beside(layout(x, order), read_manifest(df.sparkSession, root), order)
    if court_code:
        x = x.withColumn("court", court_name(F.col(court_code), F.col("court")))
    body = F.coalesce("full_text", F.lit(""))
    blank = [F.coalesce(F.col(c).cast("string") if t in ("string", "null") else F.col(c), F.lit("") if t in ("string", "null") else F.col(c)).alias(c) for c, t in x.dtypes if c in names]
    x = x.select("metadata_path", "full_text_path", F.to_json(F.struct(*blank, "year", "case_slug")).alias("meta"), (one_line(body) if collapse else body).alias("body"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _manifest_columns(x)])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = fs.FileSystem.from_uri(root)
        for b in batches:
            for r in b.to_pylist():
                out.create_dir(f"{at}/{r['full_text_path'].rsplit('/', 1)[0]}", recursive=True)
                for name, value in ((r["metadata_path"], r["meta"]), (r["full_text_path"], r["body"])):
                    with out.open_output_stream(f"{at}/{name}") as f:
                        f.write(value.encode())
            yield b.drop_columns(["meta", "body"])

    kept = [c for c in x.columns if c not in ("meta", "body")]
    manifest = x.mapInArrow(put, ", ".join(f"{c} string" for c in kept))
    manifest.write.mode("overwrite" if mode == "overwrite" else "append").json(f"{root}/manifest.jsonl")


def _manifest_columns(x: DataFrame) -> list[str]:
    return [c for c in ("sentence_id", "authoritative_case_number", "authoritative_decision_date", "language", "court", "year", "case_slug") if c in x.columns]


def _beside(x: DataFrame, there: DataFrame, order: str) -> DataFrame:
    """New rows with slugs that do not meet those already there: later suffixes go on where the old ones end."""
    bare = lambda c: F.regexp_replace(c, "__dup[0-9]+$", "")
    n = F.coalesce(F.nullif(F.regexp_extract("case_slug", "__dup([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1))
    taken = there.groupBy("language", "year", bare("case_slug").alias("__b")).agg(F.max(n).alias("__max"))
    y = numbered(x.withColumn("__b", bare("case_slug")), ["language", "year", "__b"], [F.col(order)], "__n").join(taken, ["language", "year", "__b"], "left")
    place = F.col("__n") + F.coalesce("__max", F.lit(0))
    y = y.withColumn("case_slug", F.when(place > 1, F.concat(F.col("__b"), F.lit("__dup"), place.cast("string"))).otherwise(F.col("__b")))
    base = F.concat_ws("/", F.lit("cases"), "language", "year", "case_slug")
    return y.withColumn("metadata_path", F.concat(base, F.lit("/metadata.json"))).withColumn("full_text_path", F.concat(base, F.lit("/full_text.txt"))).drop("__b", "__n", "__max")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows; a missing manifest is an empty table, lines that hold no object are dropped."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest.jsonl")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def write_new(df: DataFrame, path: str, key: str) -> None:
    """Append only rows whose key is not in the output yet (resumable sink)."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # no output yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, nulls left out."""
    df.write.mode(mode).json(path)


def read_files(spark: SparkSession, root: str, manifest: DataFrame, metadata: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases with their text, manifest rows skipped because a file is missing or the text blank).

    Only the folders the manifest names are listed: those of its languages and years.
    With ``metadata``, a schema, metadata.json is read too, as a struct ``metadata``;
    a case whose metadata file is missing is skipped then.
    """
    folder = lambda c: F.regexp_extract(c, r"(cases/[^/]+/[^/]+)/[^/]+/[^/]+$", 1)
    folders = [r[0] for r in manifest.select(folder("full_text_path")).distinct().collect() if r[0]]  # languages x years
    place = lambda name: F.regexp_extract("_metadata.file_path", rf"(cases/[^/]+/[^/]+/[^/]+/{name})$", 1)
    there = _existing(spark, root, folders, "full_text.txt")
    if not there:
        return manifest.where(F.lit(False)).withColumn("full_text", F.lit("")), manifest
    texts = spark.read.text(there, wholetext=True).select(place(r"full_text\.txt").alias("full_text_path"), F.col("value").alias("full_text"))
    joined = manifest.join(texts, "full_text_path", "left")
    ok = present(F.col("full_text"))
    if metadata:
        rows = spark.read.schema(metadata).option("multiLine", True).json(_existing(spark, root, folders, "metadata.json"))
        rows = rows.select(place(r"metadata\.json").alias("metadata_path"), F.struct(*rows.columns).alias("metadata"))
        joined = joined.join(rows, "metadata_path", "left")
        ok = ok & F.col("metadata").isNotNull()
    return joined.where(ok), joined.where(~ok).select(*manifest.columns)


def _existing(spark: SparkSession, root: str, folders: list[str], name: str) -> list[str]:
    """Patterns of the folders that exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return [f"{root}/{f}/*/{name}" for f in folders if path(f"{root}/{f}").getFileSystem(conf).exists(path(f"{root}/{f}"))]


def merged_cases(spark: SparkSession, root: str, limit: int = 0, language: str = "") -> DataFrame:
    """Cases of a merged corpus in the order of its manifest: rows with a sentence id, optionally of one language, ``limit`` at most (0: all).

    A missing file leaves its field ''. Texts come on one line.
    """
    m = read_manifest(spark, root).withColumn("line", F.monotonically_increasing_id()).where(F.trim(F.coalesce("sentence_id", F.lit(""))) != "")
    if language:
        m = m.where(F.lower(F.trim("language")) == language.strip().lower())
    if limit > 0:
        m = m.orderBy("line").limit(limit)
    found, skipped = read_files(spark, root, m)
    kind = spark.read.schema("metadata_path string, source_list_case_type string, case_type string")
    rows = found.unionByName(skipped.withColumn("full_text", F.lit("")))
    metas = _existing(spark, root, [r[0] for r in m.select(F.regexp_extract("metadata_path", r"(cases/[^/]+/[^/]+)/[^/]+/[^/]+$", 1)).distinct().collect() if r[0]], "metadata.json")
    if metas:
        place = F.regexp_extract("_metadata.file_path", r"(cases/[^/]+/[^/]+/[^/]+/metadata\.json)$", 1)
        types = kind.option("multiLine", True).json(metas).select(place.alias("metadata_path"), F.coalesce("source_list_case_type", "case_type", F.lit("")).alias("case_type"))
        rows = rows.join(types, "metadata_path", "left")
    else:
        rows = rows.withColumn("case_type", F.lit(""))
    clean = lambda c: tx.squeeze(F.coalesce(F.col(c), F.lit("")))
    return rows.select("line", *[clean(c).alias(c) for c in ("sentence_id", "authoritative_case_number", "authoritative_decision_date", "language", "court", "case_type", "full_text")])


def per_court(sources: dict[str, DataFrame]) -> DataFrame:
    """Records of several courts in one table, with the place of the court in the order given."""
    out = None
    for i, (court, df) in enumerate(sources.items()):
        part = df.withColumn("origin_court_mode", F.lit(court)).withColumn("court_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def report(df: DataFrame) -> DataFrame:
    """Counters of one row as (key, value) text lines."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns]))
    return df.select(pairs.alias("x")).select(F.concat_ws(": ", "x.key", "x.value").alias("line"))
