"""Statute articles: loading, and exact lookup by id, by (code, article) and by (label, article)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import lookup

from .tables import cut_lineage

SCHEMA = (
    "statute_id string, code_slug string, code_label string, article_no string, article_title string, hierarchy_path array<string>, "
    "full_text string, source_url string, flags map<string,string>"
)
FIELDS = ["statute_id", "code_label", "article_no", "article_title", "hierarchy_path", "full_text", "source_url", "flags"]

# Names an index may have in the lookup file, separators of combined keys, arrays of records.
ID_INDEXES = ("by_statute_id", "statute_id", "statute_id_index", "id_to_article")
CODE_INDEXES = ("by_code_slug_and_article_no", "code_slug_article_no", "slug_article_index", "code_slug_to_article_no")
LABEL_INDEXES = ("by_code_label_and_article_no", "code_label_article_no", "label_article_index", "code_label_to_article_no")
NESTED_CODE, NESTED_LABEL = ("by_code_slug", "code_slug_index"), ("by_code_label", "code_label_index")
SEPARATORS = ("#", ":", "|", "/", "::", "_")
ARRAYS = ("records", "entries", "articles")


def articles(spark: SparkSession, index_path: str, articles_path: str | None = None) -> DataFrame:
    """Articles of the index (one JSON object per statute entry), then of the articles file; a missing index fails, missing articles are none.

    ``priority`` keeps the order in which a lookup meets them: index first.
    """
    if "://" not in index_path and not os.path.exists(index_path):
        raise FileNotFoundError(index_path)
    out = spark.read.schema(SCHEMA).json(index_path).withColumn("priority", F.lit(0))
    if articles_path and ("://" in articles_path or os.path.exists(articles_path)):
        out = out.unionByName(spark.read.schema(SCHEMA).json(articles_path).withColumn("priority", F.lit(1)))
    # ties inside one file: the smallest id
    return out.withColumn("priority", F.struct("priority", "statute_id"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary file as one variant; a missing file is an empty table."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "summary variant")
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("summary"))


def index_entries(spark: SparkSession, path: str, articles_df: DataFrame | None = None) -> DataFrame:
    """Every way a lookup file (one JSON object) and the articles lead to an article, as rows of one table.

    ``kind`` is id, code or label, ``key`` and ``article`` what is asked for, ``probe``
    the order in which ways are tried: combined keys by their separators, nested
    keys, arrays of records, articles. A record may be an article, a list (the first
    counts) or the id of an article, which is followed through the id index, then the
    articles. A pointer to nothing gives an empty record. The file must hold an object.
    """
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    whole = whole.where(F.assert_true(F.schema_of_variant("v").startswith("OBJECT"), F.lit("the lookup file holds no object")).isNull())

    def entries(names: tuple[str, ...], at: str = "$") -> DataFrame:
        # only the first name that the file has is its index
        chosen = F.coalesce(*[F.try_variant_get("v", f"{at}.{n}", "variant") for n in names])
        return whole.select(F.explode(F.try_variant_get(chosen, "$", "map<string,variant>")).alias("k", "r"))

    ids = entries(ID_INDEXES).select("k", "r")
    parts = [ids.select(F.lit("id").alias("kind"), F.col("k").alias("key"), F.lit(None).cast("string").alias("article"), F.lit(0).alias("probe"), "r")]
    for kind, combined, nested in (("code", CODE_INDEXES, NESTED_CODE), ("label", LABEL_INDEXES, NESTED_LABEL)):
        rows = entries(combined)
        for i, sep in enumerate(SEPARATORS):
            # every place a separator stands may part the key
            x = rows.withColumn("p", F.split("k", "\\Q" + sep + "\\E")).where("size(p) > 1")
            x = x.select(F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"), "p", "r")
            x = x.select(F.struct(F.array_join(F.slice("p", 1, F.col("n")), sep).alias("key"), F.array_join(F.slice("p", F.col("n") + 1, F.size("p")), sep).alias("article")).alias("c"), "r")
            parts.append(x.select(F.lit(kind).alias("kind"), "c.key", "c.article", F.lit(i).alias("probe"), "r"))
        inner = entries(nested).select("k", F.explode(F.try_variant_get("r", "$", "map<string,variant>")).alias("a", "r2"))
        # asked for as it is, in small and in capital letters
        parts.append(inner.select(F.lit(kind).alias("kind"), F.col("k").alias("key"), F.col("a").alias("article"), F.lit(10).alias("probe"), F.col("r2").alias("r")))
    listed = None
    for i, name in enumerate(ARRAYS):
        x = whole.select(F.explode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("r"), F.lit(20 + i).alias("probe"))
        listed = x if listed is None else listed.unionAll(x)
    if articles_df is not None:
        rows = articles_df.select(F.to_variant_object(F.struct(*[c for c in articles_df.columns if c != "priority"])).alias("r"), F.lit(30).alias("probe"))
        listed = listed.unionAll(rows)
    text = lambda f: F.trim(F.coalesce(F.try_variant_get("r", f"$.{f}", "string"), F.lit("")))
    for kind, key, article in (("id", text("statute_id"), F.lit(None).cast("string")), ("code", F.lower(text("code_slug")), text("article_no")), ("label", text("code_label"), text("article_no"))):
        parts.append(listed.select(F.lit(kind).alias("kind"), key.alias("key"), article.alias("article"), "probe", "r"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("key <> ''")
    first = F.coalesce(F.try_element_at(F.try_variant_get("r", "$", "array<variant>"), F.lit(1)), F.col("r"))
    every = every.withColumn("r", first).withColumn("pointer", F.when(F.schema_of_variant("r") == "STRING", F.try_variant_get("r", "$", "string")))
    # pointers are followed once, the id index before the articles
    targets = ids.select(F.col("k").alias("pointer"), F.lit(0).alias("o"), F.col("r").alias("t"))
    if articles_df is not None:
        targets = targets.unionByName(articles_df.select(F.trim("statute_id").alias("pointer"), F.lit(1).alias("o"), F.to_variant_object(F.struct(*[c for c in articles_df.columns if c != "priority"])).alias("t")))
    targets = targets.groupBy("pointer").agg(F.min_by(F.to_json("t"), "o").alias("t")).select("pointer", F.parse_json("t").alias("t"))
    joined = every.join(targets, "pointer", "left").withColumn("r", F.when(F.col("pointer").isNotNull(), F.col("t")).otherwise(F.col("r")))
    get = lambda f: F.try_variant_get("r", f"$.{f}", "string")
    fields = F.struct(
        *[(F.try_variant_get("r", f"$.{f}", "array<string>") if f == "hierarchy_path" else F.try_variant_get("r", f"$.{f}", "map<string,string>") if f == "flags" else get(f)).alias(f) for f in FIELDS]
    )
    return joined.select("kind", "key", "article", "probe", fields.alias("hit"))


def by_index(queries: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    """Articles for queries (key, article) of a kind by the first way that leads to one; keys trimmed, codes in small letters, labels as they are."""
    key = F.lower(F.trim("key")) if kind == "code" else F.trim("key")
    q = queries.withColumn("__key", key).withColumn("__article", F.trim("article") if kind != "id" else F.lit(None).cast("string"))
    spelled = F.array(F.lit(None).cast("string")) if kind == "id" else F.array_distinct(F.array("__article", F.lower("__article"), F.upper("__article")))
    q = cut_lineage(q.withColumn("__n", F.monotonically_increasing_id()))
    asked = q.select("__n", "__key", "__article", F.posexplode(spelled).alias("__alias", "__a"))
    e = entries.where(F.col("kind") == kind).select(F.col("key").alias("__key"), F.col("article").alias("__a"), "probe", "hit")
    met = asked.alias("q").join(e.alias("e"), (F.col("q.__key") == F.col("e.__key")) & F.col("q.__a").eqNullSafe(F.col("e.__a")))
    # other spellings of the article count in nested indexes alone
    met = met.where((F.col("q.__alias") == 0) | (F.col("e.probe") == 10))
    best = met.groupBy("q.__n").agg(F.min_by("e.hit", F.struct("e.probe", "q.__alias")).alias("hit")).withColumn("__hit", F.lit(True))
    found = q.join(best, "__n", "left").drop("__n", "__key", "__article")
    names = [c for c in found.columns if c not in ("hit", "__hit")]
    flags = F.when(F.col("__hit"), F.coalesce(F.col("hit.flags"), F.create_map().cast("map<string,string>"))).alias("flags")
    return found.select(*names, F.coalesce("__hit", F.lit(False)).alias("found"), *[F.col(f"hit.{f}").alias(f) for f in FIELDS if f not in ("flags", "article_no")], F.col("hit.article_no").alias("article_no"), flags)


def _result(found: DataFrame) -> DataFrame:
    names = [c for c in found.columns if c != "hit"]
    cells = [F.col(f"hit.{f}").alias(f) for f in FIELDS if f != "flags"]
    flags = F.when(F.col("hit").isNotNull(), F.coalesce(F.col("hit.flags"), F.create_map().cast("map<string,string>"))).alias("flags")
    return found.select(*names, F.col("hit").isNotNull().alias("found"), *cells, flags)


def by_id(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Articles by id; ``queries`` has query_id_text."""
    return _result(lookup.exact(queries, rows, [F.trim("statute_id")], [F.trim("query_id_text")], F.col("priority")))


def by_code(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Articles by code (case aside) and number; ``queries`` has code and article."""
    keys = [F.lower(F.trim("code_slug")), F.trim("article_no")]
    return _result(lookup.exact(queries, rows, keys, [F.lower(F.trim("code")), F.trim("article")], F.col("priority")))


def by_label(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Articles by label (case kept) and number; ``queries`` has label and article."""
    return _result(lookup.exact(queries, rows, [F.col("code_label"), F.trim("article_no")], [F.col("label"), F.trim("article")], F.col("priority")))
