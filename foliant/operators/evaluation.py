"""Scores of retrieval and of extracted fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import extract


def distinct_ranked(hits: DataFrame, key: str) -> DataFrame:
    """(query_id, key, rank): first hit of each key, ranked again without gaps."""
    from pyspark.sql import Window as W

    first = hits.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def first_hit_rank(ranked: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per query of ``expected`` (query_id, key): rank of its first expected key, null without a hit."""
    got = ranked.join(expected, ["query_id", key], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id").distinct().join(got, "query_id", "left")


def hit_rates(per_query: DataFrame, kind: str, k: int) -> DataFrame:
    """Hits at k over queries with expectations, per kind and in total (kind '*')."""
    hit = F.count_if(F.col("first_rank") <= k).alias("hits")
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mean_reciprocal_rank")
    return (
        per_query.rollup(kind)
        .agg(F.count("*").alias("queries"), hit, mrr)
        .select(F.coalesce(kind, F.lit("*")).alias(kind), "queries", "hits", "mean_reciprocal_rank")
        .withColumn("hit_rate", F.round(F.col("hits") / F.col("queries"), 6))
    )


def slice_summary(results: DataFrame, slices: list[str]) -> DataFrame:
    """Summary of every slice of a fixed list, empty ones included; under three queries it is marked small."""
    spark = results.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(slices)], "slice string, position int")
    agg = results.groupBy("slice").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"))
    out = dim.join(agg, "slice", "left").fillna(0, ["queries", "hits"])
    rate = F.when(F.col("queries") > 0, F.round(F.col("hits") / F.col("queries"), 6)).otherwise(0.0)
    return out.withColumn("hit_rate", rate).withColumn("small", F.col("queries") < 3)


def strongest_and_weakest(summary: DataFrame) -> DataFrame:
    """Best slice by (rate, fewest queries, name) and worst by (rate, fewest queries, name)."""
    s = summary.where("queries > 0")
    return s.agg(
        F.max_by("slice", F.struct("hit_rate", -F.col("queries"), "slice")).alias("strongest"),
        F.min_by("slice", F.struct("hit_rate", F.col("queries"), "slice")).alias("weakest"),
    )


def pass_rule(rule: Column, cases: Column) -> Column:
    """Whether ranked case numbers satisfy a rule struct (rule_type, rank, top_k, case_number, case_numbers); unknown rules fail."""
    at = F.try_element_at(cases, rule["rank"]) == rule["case_number"]
    top = F.slice(cases, 1, F.greatest(F.coalesce(rule["top_k"], F.lit(0)), F.lit(0)))
    ok = (
        F.when(rule["rule_type"] == "case_number_at_rank", at)
        .when(rule["rule_type"] == "case_number_in_top_k", F.array_contains(top, rule["case_number"]))
        .when(rule["rule_type"] == "any_case_number_in_top_k", F.arrays_overlap(top, rule["case_numbers"]))
    )
    return F.coalesce(ok, F.lit(False))


def set_overlap(expected: Column, predicted: Column) -> Column:
    """Part of the expected elements that are predicted; 1 when both are empty, 0 when only the expected are."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    return F.when((F.size(e) == 0) & (F.size(p) == 0), 1.0).when(F.size(e) == 0, 0.0).otherwise(F.size(F.array_intersect(e, p)) / F.size(e))


def exact_list(expected: Column, predicted: Column) -> Column:
    """1 for equal lists in equal order, else 0."""
    return F.when(expected == predicted, 1.0).otherwise(0.0)


def normal_overlap(expected: Column, predicted: Column) -> Column:
    """``set_overlap`` of the non-blank evaluation forms of two lists."""
    norm = lambda a: F.filter(F.transform(a, extract.evaluation_text), lambda x: x != "")
    return set_overlap(norm(expected), norm(predicted))


def weakest(scores: dict[str, Column]) -> Column:
    """Name of the lowest score, the first on a tie."""
    return F.array_min(F.array(*[F.struct(c.alias("score"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(scores.items())]))["name"]


def completeness(df: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Per field: rows with a non-blank text, or a list with any non-blank element."""
    cells = [F.count_if(F.coalesce(F.trim(c) != "", F.lit(False))).alias(c) for c in texts]
    cells += [F.count_if(F.coalesce(F.exists(c, lambda x: F.trim(x) != ""), F.lit(False))).alias(c) for c in lists]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("complete")) for c in texts + lists]))
    return df.agg(*cells).select(pairs.alias("x")).select("x.*")


def comparison_ready(samples: tuple[Column, Column], successes: tuple[Column, Column], filled: tuple[Column, Column]) -> Column:
    """Whether two runs compare: the same samples whatever their order, and both with successes and filled fields."""
    same = F.array_sort(F.array_distinct(samples[0])) == F.array_sort(F.array_distinct(samples[1]))
    return same & (successes[0] > 0) & (successes[1] > 0) & (filled[0] > 0) & (filled[1] > 0)


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted names of the leaves of a nested schema; a list is one leaf."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        out += leaves(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [(name, f.dataType)]
    return out


def populated_leaves(df: DataFrame) -> DataFrame:
    """(populated, total) over the leaves of all rows: non-blank texts, non-empty lists, other values that are not null."""
    def there(name: str, kind: T.DataType) -> Column:
        c = F.col(name)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.coalesce(F.trim(c) != "", F.lit(False)) if isinstance(kind, T.StringType) else c.isNotNull()

    found = leaves(df.schema)
    n = reduce(lambda a, b: a + b, [there(*x).cast("bigint") for x in found])
    return df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("populated"), (F.count("*") * len(found)).alias("total"))


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Per key both values and what became of it: gained, lost or kept."""
    x = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    hit = lambda c: F.col(c).isNotNull()
    return x.withColumn("change", F.when(~hit("before") & hit("after"), "gained").when(hit("before") & ~hit("after"), "lost").otherwise("kept"))


def pass_rate(results: DataFrame, passed: str) -> DataFrame:
    """(total, passed, pass_rate); 0 for no results."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"), F.coalesce(F.round(F.avg(F.col(passed).cast("double")), 6), F.lit(0.0)).alias("pass_rate"))


def containment(expected: Column, predicted: Column) -> Column:
    """1 when either text holds the other or both are empty, else 0."""
    e, p = F.coalesce(expected, F.lit("")), F.coalesce(predicted, F.lit(""))
    both = (e == "") & (p == "")
    one = (e == "") | (p == "")
    return F.when(both, 1.0).when(one, 0.0).when(F.contains(p, e) | F.contains(e, p), 1.0).otherwise(0.0)


def population(df: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Per field: rows with a value and their share."""
    cells = [F.count_if(F.coalesce(F.trim(c) != "", F.lit(False))).alias(c) for c in texts] + [
        F.count_if(F.coalesce(F.size(c) > 0, F.lit(False))).alias(c) for c in lists
    ]
    one = df.agg(F.count("*").alias("__n"), *cells)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("filled")) for c in texts + lists]))
    return one.select("__n", pairs.alias("x")).select(
        "x.field_name", "x.filled", F.when(F.col("__n") > 0, F.round(F.col("x.filled") / F.col("__n"), 6)).otherwise(0.0).alias("share")
    )
