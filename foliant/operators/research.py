"""From requests to responses: searched, merged, cited, enriched with metadata, shown as cards, for many requests in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import queries, text

from . import cards, dedupe, lookup, search

#: hits of a request and findings of a report
DEFAULT_TOP_K, FINDINGS, LEAST_FINDINGS = 5, 5, 3
MODEL, BASELINE = "model_generated", "deterministic_baseline"
CORE = ["authoritative_case_number", "court", "language", "case_type", "case_summary", "holding", "pdf_url", "text_url_or_action"]
LISTS = ["legal_basis", "disputed_issues"]

# Sentences of a report.
SCOPE = (
    'Local deterministic legal retrieval pass over prepared {3} chunks; query="{0}", hits={1}, citations={2}. '
    "Findings are assembled from bound citation previews only."
)
NO_FINDING = "No preliminary finding could be grounded because no citation record was produced for the current query."
REUSED = "Additional supporting excerpt reused due to limited unique hits; source preview: {0}."

#: a retriever takes (query_id, query) rows and k, and gives (query_id, id, score, rank) rows
Retriever = Callable[[DataFrame, int], DataFrame]
Normalizer = Callable[[Column], Column]
Fusion = Callable[[list[DataFrame], int], DataFrame]
Reranker = Callable[[DataFrame], DataFrame]


def checked(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a query must not be blank and top_k, five where none is given, not be below 1; rejected rows say why."""
    q = text.squeeze_ends(F.coalesce("query", F.lit("")))
    k = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K))
    why = F.when(F.col("query").isNull(), "query is missing").when(q == "", "query must not be blank").when(k < 1, "top_k must be at least 1")
    x = requests.withColumn("why", why)
    ok = x.where("why IS NULL").drop("why").withColumn("query", q).withColumn("top_k", k.cast("int"))
    return ok, x.where("why IS NOT NULL")


def hybrid(
    queries_df: DataFrame, k: int, retrievers: list[Retriever], fuse: Fusion = search.pass_through, rerank: Reranker = search.unchanged, normalize: Normalizer | None = None
) -> DataFrame:
    """Hits of one retriever, or of several by a fusion, reranked; ``normalize`` is applied to the query first."""
    asked = queries_df.withColumn("query", normalize(F.col("query"))) if normalize else queries_df
    return rerank(fuse([r(asked, k) for r in retrievers], k))


def fan_out(requests: DataFrame, retriever: Retriever, k: int, decompose: bool = True) -> DataFrame:
    """(query_id, id, score, matched_subqueries, rank): the sub-queries of every request searched in one plan and merged.

    Best score wins, ties go to the smaller id; the sub-queries that found a row keep their order.
    """
    subs = requests.select("query_id", F.posexplode(queries.subqueries(F.col("query"), decompose)).alias("i", "query"))
    # a number of its own per sub-query: at most eight of each request
    numbered = subs.select((F.col("query_id") * 8 + F.col("i")).alias("query_id"), "query")
    hits = retriever(numbered, k).join(numbered.withColumnRenamed("query", "subquery"), "query_id")
    hits = hits.select(F.floor(F.col("query_id") / 8).cast("bigint").alias("request"), "id", "score", "subquery", (F.col("query_id") * 100_000 + F.col("rank")).alias("hit_ord"))
    merged = hits.groupBy("request", "id").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("hit_ord", "subquery"))).alias("qs"))
    w = W.partitionBy("request").orderBy(F.col("score").desc(), F.col("id"))
    ranked = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 1))
    return ranked.select(F.col("request").alias("query_id"), "id", "score", "rank", F.array_distinct(F.transform("qs", lambda q: q["subquery"])).alias("matched_subqueries"))


def by_route(routed: DataFrame, exact: Retriever, direct: Retriever, k: int, exact_branch: bool = True) -> DataFrame:
    """Hits of every routed query by the retrieval its route names, in one plan of as many branches as are taken."""
    from . import routing

    x = routed.withColumn("path", routing.execution(F.col("retrieval_mode"), F.col("decomposition_recommended"), exact_branch))
    asked = lambda path: x.where(F.col("path") == path).select("query_id", F.col("normalized_query").alias("query"))
    branches = {"direct": lambda: direct(asked("direct"), k), "fan_out": lambda: fan_out(asked("fan_out"), direct, k)}
    if exact_branch:
        branches["exact"] = lambda: exact(asked("exact"), k)
    # a branch that no query takes would index all documents for nothing
    taken = {r[0] for r in x.select("path").distinct().collect()} or {"direct"}
    out = None
    for path, hits in branches.items():
        if path not in taken:
            continue
        part = hits().select("query_id", "id", "rank", "score", F.lit(path).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


def first_hits(hits: DataFrame, case: str) -> DataFrame:
    """First hit of each case of a request, blank cases aside, with its place among them."""
    known = hits.where(F.trim(F.coalesce(case, F.lit(""))) != "")
    first = known.groupBy("query_id", F.trim(case).alias("case_id")).agg(F.min_by(F.struct(*hits.columns), "rank").alias("hit"))
    w = W.partitionBy("query_id").orderBy("hit.rank")
    return first.withColumn("place", F.row_number().over(w))


def metadata_index(rows: DataFrame, order: str) -> DataFrame:
    """Last row of each case number."""
    return dedupe.last_wins(rows.where(dedupe.present(F.col("authoritative_case_number"))), [F.trim("authoritative_case_number")], F.col(order))


def enriched(cases: DataFrame, model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases with the metadata of the first source by completeness, then by presence, else of the hit itself.

    ``cases`` has query_id, case_id, place and hit; core fields that the source leaves empty come from the hit.
    """
    fields = [*CORE, *LISTS]
    pack = lambda df, name: df.select(F.trim("authoritative_case_number").alias("case_id"), F.struct(*fields).alias(name))
    x = cases.join(pack(model, "m"), "case_id", "left").join(pack(baseline, "b"), "case_id", "left")
    full = lambda n: F.coalesce(F.col(n).isNotNull() & lookup.complete(CORE, LISTS, f"{n}."), F.lit(False))
    there = lambda n: F.col(n).isNotNull()
    choice = F.when(full("m"), "m").when(full("b"), "b").when(there("m"), "m").when(there("b"), "b").otherwise("hit")
    x = x.withColumn("__from", choice)

    def chosen(f: str) -> Column:
        return F.when(F.col("__from") == "m", F.col(f"m.{f}")).when(F.col("__from") == "b", F.col(f"b.{f}"))

    out = []
    for f in CORE:
        own = F.coalesce(chosen(f), F.lit(""))
        if f in ("case_summary", "holding"):
            out.append(own.alias(f))
        else:
            hit = F.col("case_id") if f == "authoritative_case_number" else F.trim(F.coalesce(F.col(f"hit.{f}"), F.lit("")))
            out.append(F.coalesce(F.nullif(own, F.lit("")), hit).alias(f))
    out += [F.coalesce(chosen(f), F.array().cast("array<string>")).alias(f) for f in LISTS]
    source = F.when(F.col("__from") == "m", MODEL).otherwise(BASELINE)
    return x.select("query_id", F.col("place").alias("rank"), source.alias("metadata_source"), F.coalesce("hit.authoritative_decision_date", F.lit("")).alias("authoritative_decision_date"), *out)


def with_cards(rows: DataFrame) -> DataFrame:
    """Adds title, subtitle and tags."""
    c = F.col
    return (
        rows.withColumn("card_title", cards.card_title(c("authoritative_case_number"), c("case_type"), c("court")))
        .withColumn("card_subtitle", cards.card_subtitle(c("language"), c("authoritative_decision_date"), c("metadata_source")))
        .withColumn("card_tags", cards.card_tags(c("case_type"), c("language"), c("metadata_source"), c("legal_basis")))
    )


def findings(citations: DataFrame) -> DataFrame:
    """(query_id, findings): up to five findings of the first citations, filled up to three with the last one.

    ``citations`` are of bounded number per query (its hits). A query without any has no row here; ``report`` gives it the placeholder.
    """
    shown = text.clean_preview(F.coalesce(F.col("chunk_text_preview"), F.lit("")))
    part = F.format_string(
        "Retrieved excerpt suggests: %s (court=%s, date=%s, rank=%s).", shown, F.coalesce("court", F.lit("")), F.coalesce("authoritative_decision_date", F.lit("")), F.col("source_rank").cast("string")
    )
    each = citations.select("query_id", "source_rank", part.alias("finding"), F.concat(F.lit(REUSED.split("{0}")[0]), shown, F.lit(REUSED.split("{0}")[1])).alias("again"), "citation_label")
    rows = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_rank", "finding", "again", "citation_label"))).alias("c"))
    first = F.transform(F.slice("c", 1, FINDINGS), lambda x: F.struct(x["finding"].alias("finding_text"), F.array(x["citation_label"]).alias("citation_labels")))
    last = F.element_at("c", -1)
    fill = F.array_repeat(F.struct(last["again"].alias("finding_text"), F.array(last["citation_label"]).alias("citation_labels")), F.greatest(F.lit(LEAST_FINDINGS) - F.size("c"), F.lit(0)))
    return rows.select("query_id", F.concat(first, fill).alias("findings"))


def report(requests: DataFrame, citations: DataFrame, hits: DataFrame, cases: int = 5, corpus: str = "court") -> DataFrame:
    """Scope (which names the corpus), findings, first cases and sources of every request; a request without hits has one placeholder finding."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    cited = citations.groupBy("query_id").agg(F.count("*").alias("citations"))
    sources = citations.groupBy("query_id", "chunk_id").agg(F.min("source_rank").alias("r")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))).alias("s"))
    top = citations.where(F.trim(F.coalesce("authoritative_case_number", F.lit(""))) != "").groupBy("query_id", F.trim("authoritative_case_number").alias("n")).agg(F.min("source_rank").alias("r"))
    top = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("t"))
    x = requests.join(counts, "query_id", "left").join(cited, "query_id", "left").join(findings(citations), "query_id", "left").join(sources, "query_id", "left").join(top, "query_id", "left")
    none = F.array(F.struct(F.lit(NO_FINDING).alias("finding_text"), F.array().cast("array<string>").alias("citation_labels")))
    scope = F.lit(SCOPE.split("{0}")[0].replace("{3}", corpus))
    head, mid = SCOPE.split("{0}")[1].split("{1}")
    between, tail = mid.split("{2}")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return x.select(
        "query_id", F.concat(scope, F.col("query"), F.lit(head), number("hits"), F.lit(between), number("citations"), F.lit(tail)).alias("research_scope"),
        F.coalesce("findings", none).alias("findings"), F.coalesce(F.transform(F.slice("t", 1, max(cases, 1)), lambda v: v["n"]), F.array().cast("array<string>")).alias("top_cases"),
        F.coalesce(F.transform("s", lambda v: v["chunk_id"]), F.array().cast("array<string>")).alias("sources"),
    )


def responses(requests: DataFrame, shown: DataFrame) -> DataFrame:
    """One envelope per request: query, top_k, counters, whether every card is whole, and the cards in order."""
    whole = lambda: F.bool_and(
        (F.col("authoritative_case_number") != "") & (F.col("court") != "") & (F.col("language") != "") & (F.col("case_type") != "") & (F.col("pdf_url") != "") & (F.col("text_url_or_action") != "")
    )
    ok = shown.groupBy("query_id").agg(whole().alias("whole"))
    env = cards.envelope(shown, requests.select("query_id"), 0)
    x = requests.join(env.drop("top_k"), "query_id").join(ok, "query_id", "left")
    n = F.col("result_count")
    diagnostics = F.struct(
        n.alias("retrieved_cases_count"), n.alias("case_cards_built"), F.col("diagnostics.model_generated_used").alias("model_generated_metadata_used_count"),
        F.col("diagnostics.fallback_used").alias("deterministic_fallback_used_count"), F.coalesce(F.col("whole") & (n > 0), F.lit(False)).alias("success_flag"),
    )
    return x.select("schema_version", "query_id", "query", F.greatest("top_k", F.lit(1)).alias("top_k"), "result_count", diagnostics.alias("diagnostics"), F.coalesce("results", F.array()).alias("results"))
