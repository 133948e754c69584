"""Joins that attach metadata: default rows, prioritised fallbacks, two keys, coverage, exact lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import last_wins, present


def attach(left: DataFrame, right: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """LEFT JOIN with the last right row of each key; '' in place of missing fields, and a flag."""
    r = last_wins(right.where(present(F.col(key))), [F.col(key)], F.col(order)).select(key, *fields, F.lit(True).alias("attached"))
    out = left.join(r, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f), F.lit("")))
    return out.withColumn("attached", F.coalesce("attached", F.lit(False)))


def first_value(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """Field-level priority: first non-blank candidate and the name of its source ('' and empty where none)."""
    value = F.coalesce(*[F.when(present(c), c) for _, c in candidates], F.lit(""))
    source = reduce(lambda w, x: w.when(present(x[1]), x[0]), candidates[1:], F.when(present(candidates[0][1]), candidates[0][0]))
    return value, source.otherwise("empty")


def complete(fields: list[str], lists: list[str], prefix: str = "") -> Column:
    """True where every text is non-blank and every list non-empty."""
    parts = [present(F.col(prefix + f)) for f in fields] + [F.coalesce(F.size(prefix + f) > 0, F.lit(False)) for f in lists]
    return reduce(lambda a, b: a & b, parts)


def missing(fields: list[str], lists: list[str], prefix: str = "") -> Column:
    """True where any text is blank or any list empty."""
    return ~complete(fields, lists, prefix)


def row_priority(df: DataFrame, sources: list[tuple[str, Column, Column]]) -> Column:
    """Row-level choice: complete sources in order, then any present source in order, else 'fallback'.

    ``sources`` holds (name, present, complete).
    """
    chain = None
    for name, _, done in sources:
        chain = F.when(done, name) if chain is None else chain.when(done, name)
    for name, there, _ in sources:
        chain = chain.when(there, name)
    return chain.otherwise("fallback")


def two_keys(left: DataFrame, by_first: DataFrame, by_second: DataFrame, first: str, second: str, field: str) -> DataFrame:
    """``field`` from the right side by the first key, else by the second."""
    a = by_first.select(first, F.col(field).alias("__a"))
    b = by_second.select(second, F.col(field).alias("__b"))
    return left.join(a, first, "left").join(b, second, "left").withColumn(field, F.coalesce("__a", "__b")).drop("__a", "__b")


def coverage(keys: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """How many keys each source covers that no earlier one does, and how many none does."""
    out, chain = keys.select(key), None
    for name, df in sources.items():
        out = out.join(df.select(key).where(present(F.col(key))).distinct().withColumn(f"__{name}", F.lit(True)), key, "left")
        flag = F.col(f"__{name}").isNotNull()
        chain = F.when(flag, name) if chain is None else chain.when(flag, name)
    return out.groupBy(chain.otherwise("unresolved").alias("resolved_by")).agg(F.count("*").alias("keys"))


def exact(queries: DataFrame, rows: DataFrame, keys: list[Column], query_keys: list[Column], priority: Column) -> DataFrame:
    """First row by priority for each query, by composite key; the keys are canonicalised by the caller."""
    right = rows.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*rows.columns), priority).alias("hit"))
    left = queries.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(query_keys)])
    names = [f"__k{i}" for i in range(len(keys))]
    return left.join(right, names, "left").drop(*names)


def field_status(df: DataFrame, fields: list[str], base: str, model: str) -> DataFrame:
    """Per key and field: model_pending, model_missing_field, baseline_missing_field, match or different."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{base}.{f}").alias("b"), F.col(f"{model}.{f}").alias("m")) for f in fields])
    )
    x = df.select("key", F.col(model).isNull().alias("pending"), cells.alias("x")).select("key", "pending", "x.*")
    b, m = F.coalesce(F.trim("b"), F.lit("")), F.coalesce(F.trim("m"), F.lit(""))
    status = (
        F.when(F.col("pending"), "model_pending")
        .when(m == "", "model_missing_field")
        .when(b == "", "baseline_missing_field")
        .when(b == m, "match")
        .otherwise("different")
    )
    return x.select("key", "field_name", status.alias("status"))
