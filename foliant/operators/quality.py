"""Predicates and counters on crawled text, cards and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import extract, text

CASE = r"[0-9]{1,5}\s*/\s*[0-9]{4}"
DATE = r"[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}"


def words(c: Column) -> Column:
    """Number of parts between blanks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\S+)")))


def good_text(c: Column, characters: int = 200, tokens: int = 60) -> Column:
    """Long enough in characters and in parts between blanks."""
    return F.coalesce((F.length(c) >= characters) & (words(c) >= tokens), F.lit(False))


def good_detail(c: Column) -> Column:
    """Stricter form: a short text that holds both a case number and a date is a list entry, not a judgment."""
    entry = (F.length(c) < 420) & c.rlike(CASE) & c.rlike(DATE)
    return F.coalesce(good_text(c, 240, 60) & ~entry, F.lit(False))


# Labels of which a single card has few.
CARD_LABELS = ("主題", "摘要", "裁判結果")


def contaminated(c: Column, labels: tuple[str, ...] = CARD_LABELS) -> Column:
    """Several cards in one: more than one case number, more than one date or more than six labels met; a blank card too."""
    def of(t: Column) -> Column:
        met = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
        cases = met(extract.CASE_IN_LINE) + met(extract.PREFIXED_CASE)
        marks = reduce(lambda a, b: a + b, [text.occurrences(t, x) for x in labels])
        return (t == "") | (cases > 1) | (met(extract.ANY_DATE) > 1) | (marks > 6)

    return text.let(text.squeeze(F.coalesce(c, F.lit(""))), of)


def separator(css: Column, c: Column) -> Column:
    """Whether a block is a rule between cards, or too short to be one."""
    return F.contains(F.lower(F.coalesce(css, F.lit(""))), F.lit("seperate")) | (F.length(text.squeeze(F.coalesce(c, F.lit("")))) < 4)


def result_like(c: Column, links: Column) -> Column:
    """Whether a block looks like a search result: a case number, a date with a link, or two links and forty characters."""
    t = F.coalesce(c, F.lit(""))
    return (F.length(t) >= 20) & (t.rlike(CASE) | (t.rlike(extract.ANY_DATE) & (links > 0)) | ((links >= 2) & (F.length(t) >= 40)))


def link_metrics(cards: DataFrame) -> DataFrame:
    """How many cards have a document of each kind, both kinds, and a text in each language."""
    has = lambda c: F.coalesce(text.squeeze(F.col(c)) != "", F.lit(False))
    spoken = lambda lang: F.coalesce(F.col("text_link_language") == lang, F.lit(False)) | F.coalesce(F.col("text_url_or_action").rlike(f"(?i)/sentence/{lang}/[0-9]+"), F.lit(False))
    flags = {
        "cards_with_pdf": has("pdf_url"), "cards_with_text": has("text_url_or_action"), "cards_with_both": has("pdf_url") & has("text_url_or_action"),
        "zh_text_links": spoken("zh"), "pt_text_links": spoken("pt"), "zh_texts": has("text_url_zh"), "pt_texts": has("text_url_pt"), "both_texts": has("text_url_zh") & has("text_url_pt"),
    }
    return cards.agg(F.count("*").alias("cards"), *[F.count_if(e).alias(n) for n, e in flags.items()])


def boundary_metrics(cards: DataFrame) -> DataFrame:
    """Valid case numbers and types, contaminated cards, and whether six tenths are valid and none contaminated."""
    number = F.coalesce(text.squeeze(F.col("case_number")).rlike(r"^[0-9]{1,6}/[0-9]{4}$"), F.lit(False))
    a = cards.agg(
        F.count("*").alias("cards"), F.count_if(number).alias("valid_numbers"), F.count_if(extract.valid_case_type(F.col("case_type"))).alias("valid_types"),
        F.count_if(contaminated(F.col("raw_card_text"))).alias("contaminated"),
    )
    least = F.greatest(F.lit(1), F.floor(F.col("cards") * 0.6))
    return a.withColumn("success", (F.col("cards") > 0) & (F.col("contaminated") == 0) & (F.col("valid_numbers") >= least) & (F.col("valid_types") >= least))


def page_validity(cards: DataFrame, page: str) -> DataFrame:
    """Per page: cards, those with a case number and with a document, and the first rule it fails."""
    a = cards.groupBy(page).agg(
        F.count("*").alias("cards"),
        F.count_if(F.coalesce(F.trim("case_number") != "", F.lit(False))).alias("with_case"),
        F.count_if(F.coalesce(F.trim("pdf_url") != "", F.lit(False)) | F.coalesce(F.trim("text_url_or_action") != "", F.lit(False))).alias("with_document"),
    )
    why = F.when(F.col("cards") < 5, "too_few_cards").when(F.col("with_case") < 3, "too_few_case_numbers").when(F.col("with_document") < 3, "too_few_documents")
    return a.withColumn("failed_rule", F.coalesce(why, F.lit(""))).withColumn("valid", F.col("failed_rule") == "")


def card_metrics(cards: DataFrame) -> DataFrame:
    """Counters of a card set and whether each field reaches six tenths."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    fields = {"case": has("case_number"), "date": has("decision_date"), "document": has("pdf_url") | has("text_url_or_action"), "type": has("case_type")}
    out = cards.agg(F.count("*").alias("cards"), *[F.count_if(e).alias(f"with_{n}") for n, e in fields.items()])
    for n in fields:
        out = out.withColumn(f"{n}_ok", F.coalesce(F.col(f"with_{n}") / F.col("cards") >= 0.6, F.lit(False)))
    return out


def true_cards(metrics: DataFrame) -> DataFrame:
    """Whether case, date and document each reach their share: the counters of ``card_metrics`` with ``are_cards``."""
    return metrics.withColumn("are_cards", F.col("case_ok") & F.col("date_ok") & F.col("document_ok"))


def partial_success(useful: Column, finished: Column) -> Column:
    """State of a crawl: done, partial where it stopped after useful work, failed otherwise."""
    return F.when(finished, "success").when(useful, "partial_success").otherwise("failed")


def success(attempted: Column, failed: Column, least: int = 1, worst: float = 0.5) -> Column:
    """Enough successes and not too many failures; nothing attempted counts as all failed."""
    ratio = F.when(attempted > 0, failed / attempted).otherwise(1.0)
    return (attempted - failed >= least) & (ratio <= worst)
