"""Query analysis: language signals, type, strategy, sub-queries; all per row, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicon, queries, text

# Query type -> (strategy, retrieval mode, whether to decompose; None: as the connectors say).
STRATEGIES = {
    "case_number_lookup_pt_mixed": ("exact_case_number_heavy_with_pt_context_retention", "exact_case_number_heavy_bm25_pt_context", False),
    "case_number_lookup": ("prefer_exact_case_number_path_then_hybrid_fallback", "exact_case_number_heavy_bm25", False),
    "portuguese_or_mixed": ("language_aware_bm25_path", "bm25_language_aware_pt_or_mixed", None),
    "mixed_fact_legal_query": ("decomposition_aware_hybrid_retrieval", "decomposition_aware_bm25_hybrid", True),
    "multi_issue_legal_query": ("decomposition_aware_hybrid_retrieval", "decomposition_aware_bm25_hybrid", True),
    "single_legal_concept": ("direct_hybrid_skeleton_bm25_first", "direct_bm25_or_hybrid_skeleton", False),
    "ambiguous_or_noisy": ("conservative_direct_retrieval", "conservative_direct_bm25", False),
}


def held_words(c: Column) -> Column:
    """Portuguese legal words a text holds, the longest first."""
    return F.filter(F.array(*[F.lit(w) for w in sorted(lexicon.PT_WORDS, key=lambda w: (-len(w), w))]), lambda w: F.contains(c, w))


def signal_summary() -> Column:
    """The signals of a query in one line, over the columns of ``signals``."""
    yes = lambda c: F.when(F.col(c), "True").otherwise("False")
    words = F.when(F.col("pt_hits") > 0, F.array_join(F.slice("pt_words", 1, 6), ", ")).otherwise("none")
    return F.concat(
        F.lit("pt_lexicon_hits="), F.col("pt_hits").cast("string"), F.lit("["), words, F.lit("]; latin_words="), F.col("latin_words").cast("string"), F.lit("; cjk_chars="),
        F.col("han_signs").cast("string"), F.lit("; case_number="), yes("has_case_number"), F.lit("; pt_case_style="), yes("pt_case_style"), F.lit("; mixed_language="), yes("mixed"),
        F.lit("; multi_issue_hint="), yes("multi_issue"),
    )


def signals(df: DataFrame, query: str) -> DataFrame:
    """Adds the signals the classification needs to a table of queries."""
    q = queries.pt_query(F.col(query))
    d = df.withColumn("normalized_query", q).withColumn("__l", text.replace_variants(F.lower("normalized_query")))
    n, low = F.col("normalized_query"), F.col("__l")
    han = F.length(F.regexp_replace(n, f"[^{text.HAN}]", ""))
    words = F.size(F.regexp_extract_all(low, F.lit("([a-zà-öø-ÿ]+)")))
    ascii_letters = F.length(F.regexp_replace(n, "[^A-Za-z]", ""))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    signs = F.length(F.regexp_replace(n, r"[^\p{L}\p{N}]", ""))
    return (
        d.withColumn("pt_words", held_words(low))
        .withColumn("pt_hits", F.size("pt_words"))
        .withColumn("latin_words", words)
        .withColumn("pt_case_style", text.count_held(low, lexicon.PT_CASE_HINTS) > 0)
        .withColumn("han_signs", han)
        .withColumn("has_case_number", low.rlike(r"(?U)\b[0-9]{1,6}/[0-9]{4}(?:/[a-z]{1,3})?\b"))
        .withColumn("mixed", ((han >= 1) & (words >= 2)) | ((han >= 2) & (F.contains(low, F.lit("liberdade condicional")) | F.contains(low, F.lit("recurso")))))
        .withColumn("letters_mixed", (ascii_letters >= 6) & (han >= 2))
        .withColumn("multi_issue", text.count_held(padded, lexicon.ISSUE_CONNECTORS) >= 2)
        .withColumn("concepts", text.count_held(n, lexicon.CONCEPTS))
        .withColumn("facts", text.count_held(n, lexicon.FACTS))
        .withColumn("connectors", reduce(lambda a, b: a + b, [text.occurrences(n, t) for t in lexicon.CONNECTORS]))
        .withColumn("noisy", (F.length(n) <= 2) | (signs == 0) | (1 - signs / F.greatest(F.length(n), F.lit(1)) > 0.45) | F.lower(n).isin(*lexicon.NOISE))
        .drop("__l")
    )


def route(df: DataFrame, query: str = "query") -> DataFrame:
    """Query type and strategy of every query; the first matching rule holds."""
    s = signals(df, query)
    c = F.col
    kind = (
        F.when(c("has_case_number") & ((c("pt_hits") > 0) | c("mixed")), "case_number_lookup_pt_mixed")
        .when(c("normalized_query").rlike(r"(?U)\b[0-9]{1,5}/[0-9]{4}\b"), "case_number_lookup")
        .when((c("pt_hits") > 0) | c("letters_mixed") | c("mixed"), "portuguese_or_mixed")
        .when(c("noisy"), "ambiguous_or_noisy")
        .when((c("concepts") >= 1) & (c("facts") >= 1), "mixed_fact_legal_query")
        .when((c("concepts") >= 2) | ((c("concepts") >= 1) & (c("connectors") >= 2)), "multi_issue_legal_query")
        .when(c("concepts") == 1, "single_legal_concept")
        .otherwise("ambiguous_or_noisy")
    )
    out = s.withColumn("query_type", kind)

    def part(i: int) -> Column:
        return reduce(lambda w, kv: w.when(c("query_type") == kv[0], kv[1][i]), STRATEGIES.items(), F.when(F.lit(False), F.lit(None)))

    return (
        out.withColumn("routing_strategy", part(0))
        .withColumn("retrieval_mode", part(1))
        .withColumn("decomposition_recommended", F.coalesce(part(2).cast("boolean"), c("multi_issue")))
    )


def well_routed(summary: Column, normalized: Column, kind: Column, strategy: Column) -> Column:
    """Whether a query with Portuguese or mixed signals went to a path that heeds them; other queries pass."""
    marks = ("legis artis", "erro ostensivo", "liberdade condicional", "processo")
    signs = (text.count_held(F.lower(normalized), marks) > 0) | F.contains(F.lower(summary), F.lit("mixed_language=true"))
    heeding = ("language_aware_bm25_path", "exact_case_number_heavy_with_pt_context_retention", "prefer_exact_case_number_path_then_hybrid_fallback")
    return F.when(~signs, True).when(kind == "ambiguous_or_noisy", False).otherwise(strategy.isin(*heeding))


def execution(mode: Column, decompose: Column, exact_branch: bool = True) -> Column:
    """Which retrieval a route runs: exact, fan_out or direct; without the exact branch case numbers are searched directly."""
    other = F.when(decompose, "fan_out").otherwise("direct")
    return F.when(F.startswith(mode, F.lit("exact_case_number_heavy")), "exact").otherwise(other) if exact_branch else other
