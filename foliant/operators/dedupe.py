"""Ordered de-duplication: first or last row wins by the ingest ordinal, nulls equal each other.

First and last wins are ``min_by``/``max_by`` aggregates over the row, combined on
the map side, so a key with a third of all rows sends one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text, urls

from .ranks import numbered


def _pick(df: DataFrame, keys: list[Column], order: Column, how) -> DataFrame:
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(how(F.struct(*[F.col(c) for c in df.columns]), order).alias("__row")).select("__row.*")


def first_wins(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """One row per key, the one with the smallest order value."""
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """One row per key, the one with the largest order value."""
    return _pick(df, keys, order, F.max_by)


def present(c: Column) -> Column:
    """True where a text is neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def reason_counts(df: DataFrame, key: Column, order: Column, group: Column) -> DataFrame:
    """Per group: rows seen, kept, skipped without key, skipped as duplicates of an earlier row of any group.

    The earliest row of each key comes from an aggregate joined back, not from a
    window over the key, so hot keys are no hot partitions.
    """
    rows = df.select(group.alias("grp"), F.when(present(key), F.trim(key)).alias("key"), order.alias("ord"))
    earliest = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("first_ord"))
    kept = earliest.select(F.col("first_ord").alias("ord"), F.lit(1).alias("kept"))
    return (
        rows.join(kept, "ord", "left")
        .groupBy("grp")
        .agg(
            F.count("*").alias("seen"),
            F.count("kept").alias("kept"),
            F.count_if(F.col("key").isNull()).alias("without_key"),
            (F.count("key") - F.count("kept")).alias("duplicates"),
        )
    )


def duplicate_key(text_urls: Column, pdf_urls: Column, *identity: Column) -> Column:
    """Tagged key of a record: its text addresses, else its pdf addresses, else its identity columns.

    The address arguments are arrays; they are canonicalised, and sorted.
    """

    def joined(a: Column) -> Column:
        # parts are made canonical one by one; the work per row is the number of its links
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(a, urls.canonical), lambda x: x.isNotNull()))), "|")

    t, p = joined(text_urls), joined(pdf_urls)
    rest = F.concat_ws("|", *[F.coalesce(F.trim(c), F.lit("")) for c in identity])
    return F.when(t != "", F.concat(F.lit("text:"), t)).when(p != "", F.concat(F.lit("pdf:"), p)).otherwise(F.concat(F.lit("meta:"), rest))


def _joined(*c: Column) -> Column:
    """Distinct non-blank texts, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[text.squeeze(F.coalesce(x, F.lit(""))) for x in c]), lambda x: x != ""))), "|")


def card_key(court: Column, case: Column, date: Column, text_urls: list[Column], pdf_urls: list[Column]) -> list[Column]:
    """Key of a card: court, case, date, and its text addresses, else its pdf addresses."""
    t = _joined(*text_urls)
    return [*[text.squeeze(F.coalesce(c, F.lit(""))) for c in (court, case, date)], F.when(t != "", t).otherwise(_joined(*pdf_urls))]


def raw_card_key(court: Column, case: Column, date: Column, document: Column, raw: Column) -> list[Column]:
    """Key of a card by its document, or by its raw text where case, date and document are all blank."""
    parts = [text.squeeze(F.coalesce(c, F.lit(""))) for c in (case, date, document)]
    blank = (parts[0] == "") & (parts[1] == "") & (parts[2] == "")
    shown = [F.when(~blank, p) for p in parts]
    return [court, *shown[:2], F.when(blank, F.concat(F.lit("raw:"), text.squeeze(F.coalesce(raw, F.lit(""))))).otherwise(shown[2])]


def unique_suffix(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``name`` made unique within the keys: later rows get __dup2, __dup3, ..."""
    n = F.col("__place")
    x = numbered(df, [*keys, name], [F.col(order)], "__place")
    return x.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("__dup"), n.cast("string"))).otherwise(F.col(name))).drop("__place")


def page_signatures(df: DataFrame, page: list[str], *identity: str) -> DataFrame:
    """Per page a signature of its cards, however ordered, and whether an earlier page has the same.

    The signature sums the digests of the distinct cards of a page, so a page of any
    size is combined on the map side and never gathered.
    """
    card = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    other = F.xxhash64(F.lit(7), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    each = df.groupBy(*page, card.alias("__a"), other.alias("__b")).agg(F.count("*").alias("__n"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string")
    sig = each.groupBy(*page).agg(F.concat_ws("/", total("__a"), total("__b"), F.count("*").cast("string")).alias("signature"), F.sum("__n").alias("cards"))
    first = sig.groupBy("signature").agg(F.min(F.struct(*page)).alias("first_page"))
    return sig.join(first, "signature").withColumn("repeats_earlier", F.col("first_page") != F.struct(*page)).drop("first_page")


def merge_hits(hits: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per chunk: best score, attributes of its first hit, queries that found it in order."""
    first = F.min_by(F.struct(*attributes), "hit_ord").alias("a")
    queries = F.array_sort(F.collect_list(F.struct("hit_ord", "subquery"))).alias("qs")
    return hits.groupBy("chunk_id").agg(F.max("score").alias("score"), first, queries).select(
        "chunk_id", "score", "a.*", F.array_distinct(F.transform("qs", lambda q: q["subquery"])).alias("matched_subqueries")
    )
