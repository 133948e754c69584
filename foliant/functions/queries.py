"""Query normalisers and issue decomposition as column expressions over a table of queries.

A null query is read as an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon, text

# Punctuation of Chinese queries -> ASCII.
PUNCTUATION = {"，": ",", "。": ".", "；": ";", "：": ":", "（": "(", "）": ")", "【": "[", "】": "]", "「": '"', "」": '"', "、": " ", "／": "/", "－": "-", "—": "-", "–": "-", "‧": "."}
# Spellings of the number sign in Portuguese queries, replaced one after the other wherever they stand.
NUMBER_SIGNS = ("n o", "n. o", "n º")
# Fixed value: a case number in a Chinese query, with what surrounds it.
WRITTEN_CASE = r"(?:第\s*)?(\d{1,5})\s*[/／]\s*(\d{2,4})(?:\s*[/／]\s*([A-Za-z]))?\s*(?:號)?"
CASE_NUMBER = r"\b[0-9]{1,5}/[0-9]{4}\b"
CONNECTOR = r"[，,、;；]+|\s+|\b(?:與|和|及|或|並|且|還有)\b"
CASE_LABEL = "案件編號 "
SUB_ISSUES, QUERY_TERMS, SUBQUERIES = 6, 10, 8


def _listed(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def written_case(c: Column) -> Column:
    """Case numbers in one form: no ordinal words, blanks or leading zeros."""
    marked = F.regexp_replace(c, WRITTEN_CASE, "\u0001$1/$2/$3\u0002")
    bare = F.translate(F.regexp_replace(marked, "/\u0002", ""), "\u0002", "")
    return F.translate(F.regexp_replace(bare, "\u00010+(?=[0-9])", "\u0001"), "\u0001", "")


def zh_query(c: Column, variants: dict[str, str] | None = None, expansions: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(normalized, expanded, rules, expansions): width, punctuation, case numbers, variants, then expansions behind the query."""
    def punctuated(q: Column, n: Column) -> Column:
        p = F.translate(n, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
        low = F.lower(text.squeeze(F.replace(p, F.lit("第 "), F.lit("第"))))
        return text.let(F.struct(p.alias("p"), low.alias("low")), lambda s: numbered(q, n, s["p"], s["low"]))

    def numbered(q: Column, n: Column, p: Column, low: Column) -> Column:
        return text.let(written_case(low), lambda w: finish(q, n, p, low, w, text.squeeze(F.regexp_replace(w, r"\s*/\s*", "/"))))

    def finish(q: Column, n: Column, p: Column, low: Column, written: Column, before: Column) -> Column:
        return text.let(text.replace_variants(before, variants), lambda v: result(q, n, p, low, written, before, v))

    def result(q: Column, n: Column, p: Column, low: Column, written: Column, before: Column, v: Column) -> Column:
        def of_terms(terms: Column) -> Column:
            rules = F.array_compact(
                F.array(
                    F.when(n != q, "unicode_nfkc"), F.when(p != n, "punctuation_width_normalization"), F.when(written != low, "case_number_format_normalization"),
                    F.when(reduce(lambda a, b: a | b, [F.contains(before, F.lit(k)) for k in (variants or lexicon.VARIANTS)]), "legal_variant_mapping"),
                    F.when(F.size(terms) > 0, "high_value_legal_query_expansion"),
                )
            )
            return F.struct(v.alias("normalized"), F.trim(F.concat_ws(" ", F.array(v), terms)).alias("expanded"), rules.alias("rules"), terms.alias("expansions"))

        return text.let(F.array_distinct(F.transform(text.expansion_terms(v, expansions), F.lower)), of_terms)

    q = F.coalesce(c, F.lit(""))
    # the one Arrow function stands outside of all lambdas
    return text.let(F.struct(q.alias("q"), text.nfkc(q).alias("n")), lambda s: punctuated(s["q"], s["n"]))


def pt_query(c: Column) -> Column:
    """Portuguese and mixed queries: width, the number sign, blanks round a slash.

    The spellings of the number sign are replaced wherever they stand, also inside words.
    """
    q = text.squeeze_ends(text.nfkc(F.coalesce(c, F.lit(""))))
    q = F.translate(q, "（）　", "() ")
    for s in NUMBER_SIGNS:
        q = F.replace(q, F.lit(s), F.lit("nº"))
    q = F.regexp_replace(q, r"(?iuU)\bprocesso\s+n\s*[ºo]?\b", "processo nº")
    return text.squeeze(F.regexp_replace(q, r"(?U)\s*/\s*", "/"))


def issue_query(c: Column) -> Column:
    """Queries to be decomposed: plain brackets, blanks squeezed, then every run of separators to a space."""
    q = text.squeeze(F.translate(F.coalesce(c, F.lit("")), "（）", "()"))
    return F.trim(F.regexp_replace(q, "[，,、;；]+", " "))


def canonical_terms(q: Column, table: dict[str, str]) -> Column:
    """Canonical forms of the terms a query holds, in the order of the table, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(k)), v) for k, v in table.items()])))


def fact_terms(q: Column) -> Column:
    """Fact terms a query holds, then its short segments that hold one."""
    facts = lambda c: F.filter(_listed(lexicon.ISSUE_FACTS), lambda t: F.contains(c, t))
    segments = F.transform(F.split(q, "(?U)" + CONNECTOR), text.squeeze_ends)
    known = [*lexicon.ISSUE_CONCEPTS, *lexicon.ISSUE_STEPS]
    kept = F.filter(
        segments,
        lambda s: ~s.isin(*known) & ~s.rlike("^[0-9]{1,5}/[0-9]{4}$") & (F.length(s) >= 2) & (F.length(s) <= 12) & ~s.rlike(r"[()\[\]{}]") & (F.size(facts(s)) > 0),
    )
    return F.array_distinct(F.concat(facts(q), kept))


def decomposed(c: Column) -> Column:
    """struct(normalized, main_issue, sub_issues, query_terms, subqueries) of a query."""
    def of(q: Column) -> Column:
        parts = F.struct(
            F.array_distinct(F.regexp_extract_all(q, F.lit(f"(?U)({CASE_NUMBER})"))).alias("cases"), canonical_terms(q, lexicon.ISSUE_CONCEPTS).alias("legal"),
            canonical_terms(q, lexicon.ISSUE_STEPS).alias("steps"), fact_terms(q).alias("facts"),
        )
        return text.let(parts, lambda p: issues(q, p))

    def head(a: Column) -> Column:
        return F.try_element_at(a, F.lit(1))

    def issues(q: Column, p: Column) -> Column:
        short_case = F.when(F.length(q) <= 24, F.concat(F.lit(CASE_LABEL), head(p["cases"])))
        main = F.coalesce(head(p["legal"]), head(p["steps"]), short_case, head(p["facts"]), q)
        return text.let(main, lambda m: subissues(q, p, m))

    def subissues(q: Column, p: Column, m: Column) -> Column:
        named = F.transform(p["cases"], lambda n: F.concat(F.lit(CASE_LABEL), n))
        subs = F.slice(F.filter(F.array_distinct(F.concat(p["legal"], p["steps"], named, p["facts"])), lambda x: x != m), 1, SUB_ISSUES)
        return text.let(subs, lambda s: result(q, p, m, s))

    def result(q: Column, p: Column, m: Column, subs: Column) -> Column:
        raw = text.squeeze_ends(F.coalesce(c, F.lit("")))
        terms = F.array_distinct(F.concat(p["legal"], p["steps"]))
        case = head(p["cases"])
        with_case = F.when(F.size(terms) > 0, F.concat_ws(" ", case, F.array_join(F.slice(terms, 1, 2), " "))).otherwise(F.concat(F.lit(CASE_LABEL), case))
        candidates = F.concat(
            F.array(
                raw, F.when(q != raw, q), m, F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 4), " ")), F.when(case.isNotNull(), with_case),
                F.when((F.size(p["legal"]) > 0) & (F.size(p["facts"]) > 0), F.concat_ws(" ", head(p["legal"]), head(p["facts"]))),
            ),
            F.slice(subs, 1, 3),
        )
        kept = F.filter(F.transform(candidates, text.squeeze_ends), lambda x: x.isNotNull() & (x != ""))
        return F.struct(
            q.alias("normalized"), m.alias("main_issue"), subs.alias("sub_issues"),
            F.slice(F.array_distinct(F.concat(p["cases"], p["legal"], p["steps"], p["facts"])), 1, QUERY_TERMS).alias("query_terms"),
            F.slice(F.array_distinct(kept), 1, SUBQUERIES).alias("subqueries"),
        )

    return text.let(issue_query(c), of)


def subqueries(c: Column, decompose: bool = True) -> Column:
    """What is searched for a query: its sub-queries, or itself where there are none or none are wanted."""
    alone = F.array(text.squeeze_ends(F.coalesce(c, F.lit(""))))
    if not decompose:
        return alone
    got = decomposed(c)["subqueries"]
    return F.when(F.size(got) > 0, got).otherwise(alone)
