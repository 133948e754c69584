"""Citations, case cards and the response envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

SCHEMA_VERSION = "1"
# Fixed value: title of a card without any part.
UNTITLED = "未命名案例"


def or_unknown(c: Column, word: str = "unknown") -> Column:
    """The trimmed value, or a word for a blank one."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(word)).otherwise(t)


def citation_label(court: Column, case: Column, date: Column) -> Column:
    """court｜case｜date, blanks as unknown."""
    return F.concat_ws("｜", or_unknown(court), or_unknown(case), or_unknown(date))


def group_key(*parts: Column) -> Column:
    """Parts joined by ::, blanks as unknown."""
    return F.concat_ws("::", *[or_unknown(p) for p in parts])


def _given(c: Column, word: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(word)).otherwise(c)


def card_title(case: Column, kind: Column, court: Column) -> Column:
    """Parts that are given, joined by a bar, else the default."""
    return _given(F.concat_ws("｜", *[F.nullif(c, F.lit("")) for c in (case, kind, court)]), UNTITLED)


def card_subtitle(language: Column, date: Column, source: Column) -> Column:
    """Language, date and metadata source with defaults."""
    return F.concat_ws(" · ", _given(language, "unknown-language"), _given(date, "unknown-date"), F.concat(F.lit("metadata:"), _given(source, "unknown")))


def card_tags(kind: Column, language: Column, source: Column, basis: Column) -> Column:
    """Distinct non-blank (type, language, source), then the non-blank of the first two of the legal basis."""
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    listed = F.transform(clean(F.slice(F.coalesce(basis, F.array().cast("array<string>")), 1, 2)), lambda x: F.concat(F.lit("basis:"), x))
    return F.concat(F.array_distinct(clean(F.array(kind, language, source))), listed)


def citations(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Hits with citation label, group key and rank in their query."""
    c = F.col
    ranked = numbered(hits, ["query_id"], order, "source_rank")
    return ranked.withColumn("citation_label", citation_label(c("court"), c("authoritative_case_number"), c("authoritative_decision_date"))).withColumn(
        "source_group_key", group_key(c("court"), c("authoritative_case_number"), c("authoritative_decision_date"), c("retrieval_source"))
    )


def envelope(cards: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """One response per query: counters and its cards in order; a query without hits has an empty list."""
    body = cards.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*[c for c in cards.columns if c not in ("query_id", "rank")]).alias("card")))), lambda x: x["card"]).alias("results"),
        F.count_if(F.col("metadata_source") == "model_generated").alias("model_used"),
        F.count_if(F.col("metadata_source") != "model_generated").alias("fallback_used"),
    )
    out = queries.join(body, "query_id", "left")
    n = F.coalesce(F.size("results"), F.lit(0))
    return out.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "query_id", F.lit(top_k).alias("top_k"), F.greatest(n, F.lit(0)).alias("result_count"),
        F.struct(F.coalesce("model_used", F.lit(0)).alias("model_generated_used"), F.coalesce("fallback_used", F.lit(0)).alias("fallback_used"), (n > 0).alias("success")).alias("diagnostics"),
        "results",
    )


def shown(rows: DataFrame, source: str = "ALL", language: str = "ALL") -> DataFrame:
    """Cards of a metadata source and a language; ALL passes every card, a missing value is met by '-'."""
    as_shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return rows.where((F.lit(source) == "ALL") | (as_shown("metadata_source") == source)).where((F.lit(language) == "ALL") | (as_shown("language") == language))


def order_of(column: str, descending: bool = False) -> list[Column]:
    """Order of cards by a column: dates (dd/MM/yyyy) as days with unread ones lowest, case numbers by year and number, other texts as they are."""
    c = F.col(column)
    if column.endswith("date"):
        keys = [F.try_to_date(c, "dd/MM/yyyy")]
    elif column.endswith("case_number"):
        keys = [F.regexp_extract(c, "/([0-9]{4})", 1).try_cast("int"), F.regexp_extract(c, "([0-9]+)/", 1).try_cast("int"), c]
    else:
        keys = [F.lower(c)]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def short_preview(c: Column, n: int = 100) -> Column:
    """First characters of a text, '' for none."""
    return F.substring(F.coalesce(c, F.lit("")), 1, n)
