"""Queries of indexing, retrieval, routing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import lexicon, queries, text
from foliant.operators import evaluation, research, routing, search
from foliant.sources.tables import cut_lineage, table

from . import fields, sql

#: retrieval depth of the reports
TOP = 10
WEIGHTS = {"authoritative_case_number": 4.0, "case_type": 2.0, "bm25_text": 1.5, "chunk_text": 1.0}
#: stated query set: rows whose id is divisible by this
EVERY = 20


def _chunk_fields() -> dict:
    return {
        "authoritative_case_number": text.mixed_tokens(F.col("authoritative_case_number")),
        "case_type": text.mixed_tokens(F.col("case_type")),
        "bm25_text": text.mixed_tokens(text.ranking_text(F.col("chunk_text"))),
        "chunk_text": text.mixed_tokens(F.col("chunk_text")),
    }


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


def chunk_search(spark: SparkSession, d: str, id_col: str = "ord"):
    """Retriever over the chunks: four weighted fields, queries normalised and expanded, case numbers rewarded; ties by ingest ordinal."""
    docs = table(spark, d, "case_chunks")

    def run(asked: DataFrame, k: int) -> DataFrame:
        tokens = text.mixed_tokens(F.col("expanded"))
        asked = cut_lineage(asked.select("query_id", queries.zh_query(F.col("query"))["expanded"].alias("expanded")))
        s = search.bm25(docs, "ord", _chunk_fields(), WEIGHTS, asked, tokens)
        number = F.regexp_replace(F.lower("authoritative_case_number"), text.BLANK, "")
        s = search.case_bonus(s, docs, "ord", number, asked, search.case_references(tokens))
        hits = search.top_k(_rounded(s), k, "id")
        if id_col != "ord":
            hits = docs.select(F.col("ord").alias("id"), F.col(id_col).alias("__name")).join(F.broadcast(hits), "id").drop("id").withColumnRenamed("__name", "id")  # k rows a stated query
        return hits.select("query_id", "id", "score", "rank")

    return run


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """Weighted ranking of the chunks for the stated evaluation items, normalised and expanded, with the case bonus."""
    hits = chunk_search(spark, d)(_items(spark, d).withColumnRenamed("text", "query"), TOP)
    return hits.select("query_id", F.col("id").alias("ord"), "rank", F.round("score", 4).alias("score"))


_BM25_FIELDS = {
    "authoritative_case_number": (sql.mixed_tokens("authoritative_case_number"), 4.0),
    "case_type": (sql.mixed_tokens("case_type"), 2.0),
    "bm25_text": (sql.mixed_tokens(sql.ranking_text("chunk_text")), 1.5),
    "chunk_text": (sql.mixed_tokens("chunk_text"), 1.0),
}
_ITEMS_SQL = f"WITH {fields.forms_sql(f'(SELECT * FROM eval_items WHERE item_id % {EVERY} = 0)', 'item_id', 'text')} SELECT item_id AS query_id, {sql.mixed_tokens('expanded')} AS tokens FROM forms"


def light_bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """Single-field BM25 over the summaries."""
    rows = table(spark, d, "research_result_items")
    s = search.bm25(rows, "ord", {"t": text.light_tokens(F.col("case_summary"))}, {"t": 1.0}, _items(spark, d), text.light_tokens(F.col("text")))
    return search.top_k(_rounded(s), TOP, "id").select("query_id", F.col("id").alias("ord"), "rank", F.round("score", 4).alias("score"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document and total frequency of every term of the summaries."""
    rows = table(spark, d, "research_result_items")
    return search.term_stats(search.term_counts(rows, "ord", {"t": text.mixed_tokens(F.col("case_summary"))}))


def exact_search(spark: SparkSession, d: str):
    """Retriever by exact case number; queries with fewer than three such rows, or without a number, are filled up by plain ranking."""
    docs = table(spark, d, "case_chunks")

    def run(asked: DataFrame, k: int) -> DataFrame:
        asked = cut_lineage(asked.select("query_id", "query", text.case_identity(F.col("query")).alias("case_id")))
        rows = docs.select(F.col("ord").alias("id"), "ord", text.case_identity(F.col("authoritative_case_number")).alias("case_id")).where("case_id IS NOT NULL")
        # no query sees more than the first rows of a case, so a hot case is no hot join
        first = search.first_of_each(rows, "case_id", "ord", max(k, search.ENOUGH_EXACT))
        first = cut_lineage(first.join(asked.select("case_id").distinct(), "case_id", "left_semi"))
        exact = first.join(asked.where("case_id IS NOT NULL"), "case_id").select("query_id", "id", "ord")
        whole = {"t": text.light_tokens(F.concat_ws(" ", F.coalesce("authoritative_case_number", F.lit("")), text.ranking_text(F.coalesce("chunk_text", F.lit(""))), F.coalesce("chunk_text", F.lit(""))))}
        # a query with enough exact rows shows no other: the ranking is asked for the rest alone
        enough = first.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") >= search.ENOUGH_EXACT)
        few = asked.join(enough, "case_id", "left_anti")
        pool = search.bm25_top_k(docs, "ord", whole, {"t": 1.0}, few, text.light_tokens(F.col("query")), max(2 * k, 10)).select("query_id", "id", F.col("id").alias("ord"), "score")
        return search.exact_with_fallback(exact, pool, k)

    return run


def exact_case_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the exact case number of the stated items."""
    ask = table(spark, d, "research_result_items").where(F.col("ord") % EVERY == 0).select(F.col("ord").alias("query_id"), F.coalesce("authoritative_case_number", F.lit("")).alias("query"))
    return exact_search(spark, d)(ask, TOP).select("query_id", "ord", "rank", F.round("score", 4).alias("score"), "source")


def dense_top(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors by inner product for the stated query vectors, against all rows."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = search.dense_top_k(rows, rows.where(F.col("id") % EVERY == 0), TOP)
    return got.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 5).alias("score"))


def hashed_ngram_top(spark: SparkSession, d: str) -> DataFrame:
    """Hashed n-gram vectors of summaries, ranked for the stated items."""
    docs = search.hashed_vectors(table(spark, d, "research_result_items"), "ord", text.char_ngrams(F.col("case_summary")))
    asked = search.hashed_vectors(_items(spark, d), "query_id", text.char_ngrams(F.col("text")))
    got = search.dense_top_k(docs, asked, TOP, places=9)
    return got.select("query_id", F.col("id").alias("ord"), "rank", F.round("score", 5).alias("score"))


def fused_top(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of the ranked and the hashed lists."""
    lists = [
        f(spark, d).select("query_id", F.col("ord").alias("id"), "rank", "ord") for f in (light_bm25_top, hashed_ngram_top)
    ]
    return search.fused(lists, TOP).select("query_id", "ord", "rank", F.round("score", 6).alias("score"))


def fan_out_merged(spark: SparkSession, d: str) -> DataFrame:
    """Each item decomposed, its sub-queries searched in one plan and merged by chunk, with how many of them found it."""
    asked = _items(spark, d).withColumnRenamed("text", "query")
    got = research.fan_out(asked, chunk_search(spark, d, "chunk_id"), TOP)
    return got.select("query_id", F.col("id").alias("chunk_id"), "rank", F.round("score", 4).alias("score"), F.size("matched_subqueries").alias("queries"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Requests from end to end: checked, decomposed, searched, merged, first hit per case, metadata, cards, envelope."""
    asked, _ = research.checked(_items(spark, d).select("query_id", F.col("text").alias("query"), F.lit(None).cast("int").alias("top_k")))
    asked = cut_lineage(asked)
    hits = research.fan_out(asked, chunk_search(spark, d, "chunk_id"), research.DEFAULT_TOP_K)
    chunks = table(spark, d, "case_chunks")
    facts = chunks.join(F.broadcast(hits.select(F.col("id").alias("chunk_id")).distinct()), "chunk_id", "left_semi")
    facts = facts.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c not in ("chunk_id", "ord")]), "ord").alias("c")).select("chunk_id", "c.*")
    full = hits.withColumnRenamed("id", "chunk_id").join(facts, "chunk_id")
    cases = research.first_hits(full, "authoritative_case_number")
    meta = table(spark, d, "case_metadata")
    by = lambda source: research.metadata_index(meta.where(F.col("metadata_source") == source), "ord")
    shown = research.with_cards(research.enriched(cases, by(research.MODEL), by(research.BASELINE)))
    out = research.responses(asked, shown)
    shows = lambda f: F.array_join(F.transform("results", lambda r: r[f]), "; ")
    return out.select(
        "query_id", "top_k", "result_count", "diagnostics.model_generated_metadata_used_count", "diagnostics.deterministic_fallback_used_count", "diagnostics.success_flag", shows("card_title").alias("titles"), shows("card_subtitle").alias("subtitles")
    )


def overlap_top(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose legal basis shares most with that of the stated rows.

    Rows of one basis set count once: sets meet on an element, and of a set only its
    first rows can be among the best.
    """
    rows = table(spark, d, "research_result_items").select("ord", F.array_sort(F.array_distinct("legal_basis")).alias("s")).where("size(s) > 0")
    first = search.first_of_each(rows, "s", "ord", 6)
    sets = rows.select("s").distinct()
    cells = sets.select("s", F.explode("s").alias("basis"))
    asked = sets.join(rows.where(F.col("ord") % EVERY == 0).select("s").distinct(), "s", "left_semi").select(F.col("s").alias("q"), F.explode("s").alias("basis"))
    shared = asked.join(cells, "basis").groupBy("q", "s").agg(F.count("*").alias("n"))
    near = shared.join(first, "s").select("q", "ord", F.round(F.col("n") / F.size("q"), 6).alias("score"))
    near = search.top_k(near, 6, "ord", ["q"]).drop("rank")  # one more, for the row itself
    found = rows.where(F.col("ord") % EVERY == 0).select(F.col("ord").alias("query_id"), F.col("s").alias("q")).join(near, "q").where("ord <> query_id")
    return search.top_k(found, 5, "ord").select("query_id", "ord", "rank", "score")


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Type and strategy of every card title, read as a query."""
    r = routing.route(table(spark, d, "research_result_items").select("ord", "card_title"), "card_title")
    return r.select("ord", "query_type", "routing_strategy", "retrieval_mode", "decomposition_recommended")


def route_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which retrieval the route of every card title runs, with and without the exact branch, whether it heeds the language, and its signals."""
    r = routing.route(table(spark, d, "research_result_items").select("ord", "card_title"), "card_title").withColumn("summary", routing.signal_summary())
    mode, more = F.col("retrieval_mode"), F.col("decomposition_recommended")
    return r.select(
        "ord", routing.execution(mode, more).alias("path"), routing.execution(mode, more, False).alias("demo_path"),
        routing.well_routed(F.col("summary"), F.col("normalized_query"), F.col("query_type"), F.col("routing_strategy")).alias("heeds_language"), "summary",
    )


def routed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the stated card titles by the retrieval their route names."""
    titles = table(spark, d, "research_result_items").where(F.col("ord") % EVERY == 0).select(F.col("ord").alias("query_id"), "card_title")
    routed = cut_lineage(routing.route(titles, "card_title").select("query_id", "normalized_query", "retrieval_mode", "decomposition_recommended"))
    got = research.by_route(routed, exact_search(spark, d), chunk_search(spark, d), TOP)
    return got.select("query_id", "path", F.col("id").alias("ord"), "rank", F.round("score", 4).alias("score"))


def query_parts(spark: SparkSession, d: str) -> DataFrame:
    """Sub-queries of every card title."""
    return table(spark, d, "research_result_items").where("card_title IS NOT NULL").select("ord", F.posexplode(queries.subqueries(F.col("card_title"))).alias("position", "subquery"))


def _ranked_citations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cites = table(spark, d, "citation_records").where("source_rank IS NOT NULL").select("ord", "chunk_id", "source_rank", "retrieval_source", text.case_key(F.col("authoritative_case_number")).alias("case_id"))
    truth = table(spark, d, "case_chunks").groupBy("chunk_id").agg(F.min_by("authoritative_case_number", "ord").alias("c")).select("chunk_id", text.case_key(F.col("c")).alias("truth"))
    return cites, truth


def hit_rates_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Share of citations, per retrieval source and in total, whose case is that of their chunk within the first five ranks."""
    cites, truth = _ranked_citations(spark, d)
    x = cites.join(truth, "chunk_id", "left").select(
        F.coalesce("retrieval_source", F.lit("")).alias("kind"), F.when(F.col("case_id") == F.col("truth"), F.col("source_rank")).alias("first_rank")
    )
    return evaluation.hit_rates(x, "kind", 5)


SLICES = ["bm25", "dense", "hybrid_decomposed", "exact_case_number", "graph", "web"]


def slice_table(spark: SparkSession, d: str) -> DataFrame:
    """Fixed slices with hits, empty ones included."""
    cites, truth = _ranked_citations(spark, d)
    x = cites.join(truth, "chunk_id", "left").select(F.col("retrieval_source").alias("slice"), F.coalesce(F.col("case_id") == F.col("truth"), F.lit(False)).alias("hit"))
    return evaluation.slice_summary(x, SLICES)


def strongest_slice(spark: SparkSession, d: str) -> DataFrame:
    """Best and worst slice."""
    return evaluation.strongest_and_weakest(slice_table(spark, d))


def first_case_hits(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cases of each source in order of their best score, with their rank (first hit per case)."""
    c = table(spark, d, "citation_records").where("score IS NOT NULL AND trim(authoritative_case_number) <> '' AND retrieval_source IS NOT NULL")
    best = c.groupBy(F.col("retrieval_source"), text.case_key(F.col("authoritative_case_number")).alias("case_id")).agg(
        F.max("score").alias("score"), F.min_by("ord", F.struct((-F.col("score")).alias("s"), F.col("ord"))).alias("ord")
    )
    return search.top_k(best, TOP, "ord", ["retrieval_source"]).select("retrieval_source", "case_id", "ord", "rank", F.round("score", 6).alias("score"))


def _rule_table(spark: SparkSession) -> DataFrame:
    """Rules of a regression pack, one of each kind."""
    rows = [("R1", "case_number_at_rank", 1, 1, "417/2021", None), ("R2", "case_number_in_top_k", 3, 3, "417/2021", None), ("R3", "any_case_number_in_top_k", 5, 5, None, ["417/2021", "1/1999"]), ("R4", "unheard_of", 1, 1, "417/2021", None)]
    return spark.createDataFrame(rows, "query_id string, rule_type string, rank int, top_k int, case_number string, case_numbers array<string>")


def pass_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a pack held against the ranked cases of each source, ten at most."""
    per = first_case_hits(spark, d).groupBy("retrieval_source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "case_id"))), lambda x: x["case_id"]).alias("cases"))
    rules = _rule_table(spark)
    x = per.join(F.broadcast(rules.select("query_id", F.struct(*[c for c in rules.columns if c != "query_id"]).alias("rule"))))  # a pack is a few rows
    return x.select("retrieval_source", "rule.rule_type", evaluation.pass_rule(F.col("rule"), F.col("cases")).alias("passed"))


def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of the pack that passes, per source."""
    r = pass_rules(spark, d).groupBy("retrieval_source").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))
    return r


def source_changes(spark: SparkSession, d: str) -> DataFrame:
    """First hit rank of every chunk by one source against another, and what became of it."""
    cites, truth = _ranked_citations(spark, d)
    hit = cites.join(truth, "chunk_id").where(F.col("case_id") == F.col("truth")).groupBy("chunk_id", "retrieval_source").agg(F.min("source_rank").alias("first_rank"))
    keys = cites.select("chunk_id").distinct()
    of = lambda s: keys.join(hit.where(F.col("retrieval_source") == s), "chunk_id", "left").select("chunk_id", "first_rank")
    return evaluation.before_after(of("bm25"), of("dense"), "chunk_id", "first_rank").groupBy("change").agg(F.count("*").alias("chunks"))


def citation_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each chunk in score order with label and group key."""
    from foliant.operators import cards

    c = table(spark, d, "citation_records").withColumn("query_id", F.col("chunk_id")).drop("source_rank", "citation_label", "source_group_key")
    return cards.citations(c, [F.col("score").desc_nulls_last(), F.col("ord")]).select("ord", "source_rank", "citation_label", "source_group_key")


def preliminary_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the best citations of every source, read as one request each."""
    c = table(spark, d, "citation_records").where("retrieval_source IS NOT NULL AND score > 0")
    best = search.top_k(c.withColumn("query_id", F.col("retrieval_source")).drop("source_rank"), 2, "ord").withColumnRenamed("rank", "source_rank")
    x = research.findings(best).select("query_id", F.posexplode("findings").alias("position", "f"))
    return x.select(F.col("query_id").alias("retrieval_source"), "position", F.md5("f.finding_text").alias("finding"), F.array_join("f.citation_labels", ",").alias("labels"))


def overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    """Set overlap, token overlap and containment of returned items against the metadata of their case, averaged per language."""
    items = table(spark, d, "research_result_items").where("trim(pdf_url) <> ''")
    meta = table(spark, d, "case_metadata").where("trim(pdf_url) <> ''").groupBy("pdf_url").agg(
        F.max_by(F.struct(F.col("legal_basis").alias("lb"), F.col("holding").alias("h")), "ord").alias("m")
    )
    e = F.array().cast("array<string>")
    x = items.join(meta, "pdf_url").select(
        F.coalesce("language", F.lit("")).alias("language"),
        evaluation.set_overlap(F.coalesce("m.lb", e), F.coalesce("legal_basis", e)).alias("s"),
        evaluation.set_overlap(text.overlap_tokens(F.coalesce("m.h", F.lit(""))), text.overlap_tokens(F.coalesce("holding", F.lit("")))).alias("t"),
        evaluation.containment(F.col("m.h"), F.col("holding")).alias("c"),
    )
    return x.groupBy("language").agg(F.count("*").alias("rows"), *[F.round(F.avg(a), 6).alias(n) for a, n in (("s", "set_overlap"), ("t", "token_overlap"), ("c", "containment"))])


QUERIES = {
    f.__name__: f
    for f in (
        bm25_top, light_bm25_top, term_statistics, exact_case_lookup, dense_top, hashed_ngram_top, fused_top, fan_out_merged, overlap_top, routes,
        query_parts, route_paths, routed_hits, responses, pass_rates, source_changes, preliminary_findings, hit_rates_by_source, slice_table, strongest_slice, first_case_hits, pass_rules, citation_ranks, overlap_scores,
    )
}

_LIGHT_SQL = sql.bm25("research_result_items", "ord", {"t": (sql.light_tokens("case_summary"), 1.0)}, f"SELECT item_id AS query_id, {sql.light_tokens('text')} AS tokens FROM eval_items WHERE item_id % {EVERY} = 0", "ord", TOP)
_CASE_ID = (
    "CASE WHEN regexp_extract(h, '([0-9]{1,6})\\s*/\\s*([0-9]{4})', 1) <> '' THEN coalesce(nullif(ltrim(regexp_extract(h, '([0-9]{1,6})\\s*/\\s*([0-9]{4})', 1), '0'), ''), '0') || '/' || "
    "regexp_extract(h, '([0-9]{1,6})\\s*/\\s*([0-9]{4})', 2) || CASE WHEN regexp_extract(h, '[0-9]{1,6}\\s*/\\s*[0-9]{4}\\s*[-/]\\s*([A-Za-z]{1,3})\\b', 1) <> '' "
    "THEN '-' || upper(regexp_extract(h, '[0-9]{1,6}\\s*/\\s*[0-9]{4}\\s*[-/]\\s*([A-Za-z]{1,3})\\b', 1)) ELSE '' END END"
)
_WHOLE_SQL = f"concat_ws(' ', coalesce(authoritative_case_number, ''), {sql.ranking_text("coalesce(chunk_text, '')")}, coalesce(chunk_text, ''))"
_POOL_SQL = sql.bm25("case_chunks", "ord", {"t": (sql.light_tokens(_WHOLE_SQL), 1.0)}, f"SELECT ord AS query_id, {sql.light_tokens("coalesce(authoritative_case_number, '')")} AS tokens FROM research_result_items WHERE ord % {EVERY} = 0", "ord", 2 * TOP).replace("round(score, 4)", "round(score, 9)")
_EXACT_SQL = f"""
WITH ask AS (SELECT ord AS query_id, {_CASE_ID} AS c FROM (SELECT *, {sql.half('authoritative_case_number')} AS h FROM research_result_items WHERE ord % {EVERY} = 0)),
 docs AS (SELECT ord, {_CASE_ID} AS c FROM (SELECT *, {sql.half('authoritative_case_number')} AS h FROM case_chunks)),
 e AS (SELECT query_id, docs.ord FROM ask JOIN docs USING (c)),
 enough AS (SELECT query_id FROM e GROUP BY 1 HAVING count(*) >= 3),
 pool AS ({_POOL_SQL}),
 u AS (SELECT query_id, ord, 100.0 AS score, 100.0 AS own, 'exact' AS source FROM e UNION ALL
       SELECT query_id, ord, least(score, 9.9), score, 'fallback' FROM pool p WHERE query_id NOT IN (SELECT query_id FROM enough) AND NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = p.query_id AND e.ord = p.ord)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, own DESC, ord) AS rank FROM u)
SELECT query_id, ord, rank, round(score, 4) AS score, source FROM r WHERE rank <= {TOP}"""


def _vectors(rel: str, idc: str, c: str) -> str:
    h = "md5(g)"
    parts = [f"coalesce(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n})), [])" for n in (2, 3, 4)]
    grams = " || ".join([*parts, f"coalesce(regexp_extract_all(t, '[{text.HAN}]'), [])"])
    texts = f"SELECT {idc} AS id, regexp_replace(lower({sql.nfkc(c)}), {sql.q(text.BLANK)}, '', 'g') AS t FROM {rel}"
    return (
        f"SELECT id, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, ('0x' || substr({h}, 1, 8))::BIGINT % 768 AS b, "
        f"sum(CASE WHEN ('0x' || substr({h}, 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM (SELECT id, unnest({grams}) AS g FROM ({texts})) GROUP BY ALL) WHERE w <> 0"
    )


_HASHED_SQL = f"""
WITH dv AS ({_vectors('research_result_items', 'ord', 'case_summary')}), qv AS ({_vectors(f'(SELECT * FROM eval_items WHERE item_id % {EVERY} = 0)', 'item_id', 'text')}),
 s AS (SELECT qv.id AS query_id, dv.id AS ord, sum(qv.w * dv.w) AS score FROM qv JOIN dv ON qv.b = dv.b GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM s WHERE round(score, 9) > 0)
SELECT query_id, ord, rank, round(score, 5) AS score FROM r WHERE rank <= {TOP}"""
_RANKED_SQL = f"""
WITH t AS (SELECT chunk_id, {sql.case_key('arg_min(authoritative_case_number, ord)')} AS truth FROM case_chunks WHERE authoritative_case_number IS NOT NULL GROUP BY 1),
 x AS (SELECT retrieval_source, coalesce({sql.case_key('c.authoritative_case_number')} = truth, false) AS hit, source_rank FROM citation_records c LEFT JOIN t USING (chunk_id) WHERE source_rank IS NOT NULL)
"""
_FIRST_SQL = f"""
SELECT retrieval_source, case_id, ord, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_source ORDER BY score DESC, ord) AS rank FROM (
 SELECT retrieval_source, case_id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_source, case_id ORDER BY score DESC, ord) AS rn FROM
 (SELECT retrieval_source, score, ord, {sql.case_key('authoritative_case_number')} AS case_id FROM citation_records WHERE score IS NOT NULL AND trim(authoritative_case_number) <> '' AND retrieval_source IS NOT NULL)) WHERE rn = 1 AND score > 0)) WHERE rank <= {TOP}"""
_SLICE_SQL = (
    _RANKED_SQL
    + ", d AS (SELECT unnest(range(0, 6))::INT AS position, unnest("
    + sql.listed(SLICES)
    + """) AS slice), a AS (SELECT retrieval_source AS slice, count(*) AS queries, count(*) FILTER (hit) AS hits FROM x GROUP BY 1)
SELECT slice, position, coalesce(queries, 0) AS queries, coalesce(hits, 0) AS hits, CASE WHEN queries > 0 THEN round(hits / queries, 6) ELSE 0.0 END AS hit_rate, coalesce(queries, 0) < 3 AS small FROM d LEFT JOIN a USING (slice)"""
)



def _unknown(c: str) -> str:
    return f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'unknown' ELSE trim({c}) END"


_LABEL_SQL = f"concat_ws('｜', {_unknown('court')}, {_unknown('authoritative_case_number')}, {_unknown('authoritative_decision_date')})"

ORACLE_SQL = {
    "bm25_top": sql.bm25("case_chunks", "ord", _BM25_FIELDS, _ITEMS_SQL, "ord", TOP, "authoritative_case_number"),
    "light_bm25_top": _LIGHT_SQL,
    "term_statistics": f"SELECT term, count(DISTINCT ord) AS df, count(*) AS total FROM (SELECT ord, unnest({sql.mixed_tokens('case_summary')}) AS term FROM research_result_items) GROUP BY term",
    "exact_case_lookup": _EXACT_SQL,
    "dense_top": f"""SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0) WHERE rank <= {TOP} AND score > 0""",
    "hashed_ngram_top": _HASHED_SQL,
    "fused_top": f"""WITH a AS ({_LIGHT_SQL}), b AS ({_HASHED_SQL}), u AS (SELECT query_id, ord, rank FROM a UNION ALL SELECT query_id, ord, rank FROM b),
 s AS (SELECT query_id, ord, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY ALL)
 SELECT query_id, ord, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ord) AS rank FROM s) WHERE rank <= {TOP}""",
    "overlap_top": f"""WITH c AS (SELECT ord, unnest(list_distinct(legal_basis)) AS basis FROM research_result_items), q AS (SELECT * FROM c WHERE ord % {EVERY} = 0), n AS (SELECT ord, count(*) AS n FROM q GROUP BY 1),
 s AS (SELECT q.ord AS query_id, c.ord, round(count(*) / any_value(n.n), 6) AS score FROM q JOIN c USING (basis) JOIN n ON n.ord = q.ord WHERE c.ord <> q.ord GROUP BY ALL)
 SELECT query_id, ord, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM s) WHERE rank <= 5""",
    "hit_rates_by_source": _RANKED_SQL
    + """SELECT coalesce(kind, '*') AS kind, count(*) AS queries, count(*) FILTER (hit AND source_rank <= 5) AS hits, round(avg(CASE WHEN hit THEN 1.0::DOUBLE / source_rank ELSE 0 END), 6) AS mean_reciprocal_rank,
 round(count(*) FILTER (hit AND source_rank <= 5) / count(*), 6) AS hit_rate FROM (SELECT coalesce(retrieval_source, '') AS kind, hit, source_rank FROM x) GROUP BY ROLLUP (kind)""",
    "slice_table": _SLICE_SQL,
    "strongest_slice": f"WITH s AS ({_SLICE_SQL}) SELECT (SELECT slice FROM s WHERE queries > 0 ORDER BY hit_rate DESC, queries, slice DESC LIMIT 1) AS strongest, (SELECT slice FROM s WHERE queries > 0 ORDER BY hit_rate, queries, slice LIMIT 1) AS weakest",
    "first_case_hits": _FIRST_SQL,
    "pass_rules": f"""WITH f AS ({_FIRST_SQL}), k AS (SELECT unnest(['case_number_at_rank', 'case_number_in_top_k', 'any_case_number_in_top_k', 'unheard_of']) AS rule_type, unnest([1, 3, 5, 1]) AS k)
 SELECT retrieval_source, rule_type, bool_or(CASE rule_type WHEN 'case_number_at_rank' THEN rank = k AND case_id = '417/2021' WHEN 'case_number_in_top_k' THEN rank <= k AND case_id = '417/2021'
 WHEN 'any_case_number_in_top_k' THEN rank <= k AND case_id IN ('417/2021', '1/1999') ELSE false END) AS passed FROM f, k GROUP BY ALL""",
    "citation_ranks": f"""SELECT ord, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC NULLS LAST, ord) AS source_rank,
 {_LABEL_SQL} AS citation_label, concat_ws('::', {_unknown('court')}, {_unknown('authoritative_case_number')}, {_unknown('authoritative_decision_date')}, {_unknown('retrieval_source')}) AS source_group_key FROM citation_records""",
    "pass_rates": f"WITH f AS ({{0}}) SELECT retrieval_source, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate FROM f GROUP BY 1",
    "source_changes": f"""WITH t AS (SELECT chunk_id, {sql.case_key('arg_min(authoritative_case_number, ord)')} AS truth FROM case_chunks WHERE authoritative_case_number IS NOT NULL GROUP BY 1), c AS (SELECT * FROM citation_records WHERE source_rank IS NOT NULL),
 h AS (SELECT chunk_id, retrieval_source AS s, min(source_rank) AS r FROM c JOIN t USING (chunk_id) WHERE {sql.case_key('c.authoritative_case_number')} = truth GROUP BY ALL),
 k AS (SELECT DISTINCT chunk_id FROM c), x AS (SELECT b.r AS b, a.r AS a FROM k LEFT JOIN (SELECT * FROM h WHERE s = 'bm25') b USING (chunk_id) LEFT JOIN (SELECT * FROM h WHERE s = 'dense') a USING (chunk_id))
 SELECT CASE WHEN b IS NULL AND a IS NOT NULL THEN 'gained' WHEN b IS NOT NULL AND a IS NULL THEN 'lost' ELSE 'kept' END AS change, count(*) AS chunks FROM x GROUP BY 1""",
    "preliminary_findings": f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY retrieval_source ORDER BY score DESC, ord) AS rk FROM citation_records WHERE retrieval_source IS NOT NULL AND score > 0),
 p AS (SELECT *, CASE WHEN length({sql.squeeze("coalesce(chunk_text_preview, '')")}) <= 180 THEN {sql.squeeze("coalesce(chunk_text_preview, '')")} ELSE rtrim(substr({sql.squeeze("coalesce(chunk_text_preview, '')")}, 1, 179)) || '…' END AS pv, {_LABEL_SQL} AS lb FROM c WHERE rk <= 2),
 n AS (SELECT retrieval_source, count(*) AS n FROM p GROUP BY 1),
 f AS (SELECT retrieval_source, rk - 1 AS position, 'Retrieved excerpt suggests: ' || pv || ' (court=' || coalesce(court, '') || ', date=' || coalesce(authoritative_decision_date, '') || ', rank=' || rk || ').' AS t, lb FROM p
   UNION ALL SELECT retrieval_source, unnest(range(n, 3)), 'Additional supporting excerpt reused due to limited unique hits; source preview: ' || pv || '.', lb FROM p JOIN n USING (retrieval_source) WHERE rk = n)
 SELECT retrieval_source, position::INT AS position, md5(t) AS finding, lb AS labels FROM f""",
}


def _any(c: str, terms) -> str:
    return f"len(list_filter({sql.listed(terms)}, lambda x: contains({c}, x)))"


def _routes_sql(more: str = "") -> str:
    low = "lower(n)"
    for k, v in sorted(lexicon.VARIANTS.items(), key=lambda kv: -len(kv[0])):
        low = f"replace({low}, {sql.q(k)}, {sql.q(v)})"
    connectors = " + ".join(f"((length(n) - length(replace(n, {sql.q(t)}, ''))) // {len(t)})" for t in lexicon.CONNECTORS)
    edge, end = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
    kinds = " ".join(f"WHEN '{k}' THEN %s" for k in routing.STRATEGIES)
    strategy = "CASE query_type " + kinds % tuple(f"'{v[0]}'" for v in routing.STRATEGIES.values()) + " END"
    mode = "CASE query_type " + kinds % tuple(f"'{v[1]}'" for v in routing.STRATEGIES.values()) + " END"
    decompose = "CASE query_type " + kinds % tuple({True: "true", False: "false", None: "multi_issue"}[v[2]] for v in routing.STRATEGIES.values()) + " END"
    n = f"translate(trim({sql.nfkc("coalesce(card_title, '')")}), '（）　', '() ')"
    for sign in queries.NUMBER_SIGNS:
        n = f"replace({n}, {sql.q(sign)}, 'nº')"
    n = f"regexp_replace({n}, '(?i)\\bprocesso\\s+n\\s*[ºo]?\\b', 'processo nº', 'g')"
    return f"""
WITH a AS (SELECT ord, {sql.squeeze("regexp_replace(" + n + ", '\\s*/\\s*', '/', 'g')")} AS n FROM research_result_items),
 b AS (SELECT *, {low} AS l FROM a),
 c AS (SELECT *, {_any('l', lexicon.PT_WORDS)} AS pt, length(regexp_replace(n, '[^{text.HAN}]', '', 'g')) AS han, len(regexp_extract_all(l, '[a-zà-öø-ÿ]+')) AS words,
   length(regexp_replace(n, '[^A-Za-z]', '', 'g')) AS letters, regexp_matches(l, {sql.q(edge + '[0-9]{1,6}/[0-9]{4}(?:/[a-z]{1,3})?' + end)}) AS has_case,
   regexp_matches(n, {sql.q(edge + '[0-9]{1,5}/[0-9]{4}' + end)}) AS is_case, {_any("' ' || l || ' '", lexicon.ISSUE_CONNECTORS)} >= 2 AS multi_issue,
   {_any('n', lexicon.CONCEPTS)} AS concepts, {_any('n', lexicon.FACTS)} AS facts, {connectors} AS connectors, length(regexp_replace(n, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS signs FROM b),
 d AS (SELECT *, (han >= 1 AND words >= 2) OR (han >= 2 AND (contains(l, 'liberdade condicional') OR contains(l, 'recurso'))) AS mixed,
   length(n) <= 2 OR signs = 0 OR 1 - signs / greatest(length(n), 1) > 0.45 OR lower(n) IN ({', '.join(map(sql.q, lexicon.NOISE))}) AS noisy FROM c),
 e AS (SELECT *, CASE WHEN has_case AND (pt > 0 OR mixed) THEN 'case_number_lookup_pt_mixed' WHEN is_case THEN 'case_number_lookup' WHEN pt > 0 OR (letters >= 6 AND han >= 2) OR mixed THEN 'portuguese_or_mixed'
   WHEN noisy THEN 'ambiguous_or_noisy' WHEN concepts >= 1 AND facts >= 1 THEN 'mixed_fact_legal_query' WHEN concepts >= 2 OR (concepts >= 1 AND connectors >= 2) THEN 'multi_issue_legal_query'
   WHEN concepts = 1 THEN 'single_legal_concept' ELSE 'ambiguous_or_noisy' END AS query_type FROM d)
SELECT ord, query_type, {strategy} AS routing_strategy, {mode} AS retrieval_mode, {decompose} AS decomposition_recommended{more} FROM e"""


def _parts_sql() -> str:
    return f"WITH {fields.issue_parts_sql('(SELECT * FROM research_result_items WHERE card_title IS NOT NULL)', 'ord', 'card_title')} SELECT ord, unnest(range(0, len(parts)))::INT AS position, unnest(parts) AS subquery FROM (SELECT ord, CASE WHEN len(parts) > 0 THEN parts ELSE [raw] END AS parts FROM i7)"


def _overlap_sql() -> str:
    toks = lambda c: f"list_distinct(regexp_extract_all(lower({sql.half('coalesce(' + c + ', chr(32))')}), '[a-zà-öø-ÿ0-9{text.HAN}]+'))"
    share = lambda e, p: f"CASE WHEN len({e}) = 0 AND len({p}) = 0 THEN 1.0 WHEN len({e}) = 0 THEN 0.0 ELSE len(list_intersect({e}, {p})) / len({e}) END"
    return f"""
WITH m AS (SELECT pdf_url, legal_basis AS lb, holding AS h FROM (SELECT *, row_number() OVER (PARTITION BY pdf_url ORDER BY ord DESC) AS rn FROM case_metadata WHERE trim(pdf_url) <> '') WHERE rn = 1),
 x AS (SELECT coalesce(language, '') AS language, list_distinct(coalesce(m.lb, [])) AS e1, list_distinct(coalesce(i.legal_basis, [])) AS p1, {toks('m.h')} AS e2, {toks('i.holding')} AS p2, coalesce(m.h, '') AS e3, coalesce(i.holding, '') AS p3
   FROM research_result_items i JOIN m USING (pdf_url) WHERE trim(i.pdf_url) <> '')
SELECT language, count(*) AS rows, round(avg({share('e1', 'p1')}), 6) AS set_overlap, round(avg({share('e2', 'p2')}), 6) AS token_overlap,
 round(avg(CASE WHEN e3 = '' AND p3 = '' THEN 1.0 WHEN e3 = '' OR p3 = '' THEN 0.0 WHEN contains(p3, e3) OR contains(e3, p3) THEN 1.0 ELSE 0.0 END), 6) AS containment FROM x GROUP BY 1"""


ORACLE_SQL |= {"routes": _routes_sql(), "query_parts": _parts_sql(), "overlap_scores": _overlap_sql()}


def _fan_out_sql(k: int, name: str = "f") -> str:
    """CTEs ending in ``name``: (query_id, chunk_id, rank, score, queries)."""
    parts = fields.issue_parts_sql(f"(SELECT * FROM eval_items WHERE item_id % {EVERY} = 0)", "item_id", "text")
    asked = f"WITH {fields.forms_sql('subs', 'query_id', 'sub')} SELECT query_id, {sql.mixed_tokens('expanded')} AS tokens FROM forms"
    ranked = sql.bm25("case_chunks", "ord", _BM25_FIELDS, asked, "ord", k, "authoritative_case_number").replace("round(score, 4)", "round(score, 9)")
    return f"""{parts},
 subs AS (SELECT item_id * 8 + i AS query_id, sub FROM (SELECT item_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS sub FROM (SELECT item_id, CASE WHEN len(parts) > 0 THEN parts ELSE [raw] END AS parts FROM i7))),
 hits AS ({ranked}),
 mrg AS (SELECT h.query_id // 8 AS query_id, c.chunk_id, max(h.score) AS score, count(DISTINCT s.sub)::INT AS queries FROM hits h JOIN subs s ON s.query_id = h.query_id JOIN case_chunks c ON c.ord = h.ord GROUP BY ALL),
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM mrg) WHERE rank <= {k})"""


ORACLE_SQL["fan_out_merged"] = f"WITH {_fan_out_sql(TOP)} SELECT query_id, chunk_id, rank, round(score, 4) AS score, queries FROM f"
ORACLE_SQL["pass_rates"] = ORACLE_SQL["pass_rates"].replace("{0}", ORACLE_SQL["pass_rules"])


def _paths_sql() -> str:
    flag = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    words = sorted(lexicon.PT_WORDS, key=lambda w: (-len(w), w))
    held = f"list_filter({sql.listed(words)}, lambda x: contains(l, x))"
    summary = (
        f"'pt_lexicon_hits=' || pt || '[' || CASE WHEN pt > 0 THEN array_to_string({held}[1:6], ', ') ELSE 'none' END || ']; latin_words=' || words || '; cjk_chars=' || han || '; case_number=' || {flag('has_case')} "
        f"|| '; pt_case_style=' || {flag(_any('l', lexicon.PT_CASE_HINTS) + ' > 0')} || '; mixed_language=' || {flag('mixed')} || '; multi_issue_hint=' || {flag('multi_issue')}"
    )
    inner = _routes_sql(f", n, mixed, {summary} AS summary")
    heed = "routing_strategy IN ('language_aware_bm25_path', 'exact_case_number_heavy_with_pt_context_retention', 'prefer_exact_case_number_path_then_hybrid_fallback')"
    signs = f"({_any('lower(n)', ('legis artis', 'erro ostensivo', 'liberdade condicional', 'processo'))} > 0 OR mixed)"
    return f"""SELECT ord, CASE WHEN starts_with(retrieval_mode, 'exact_case_number_heavy') THEN 'exact' WHEN decomposition_recommended THEN 'fan_out' ELSE 'direct' END AS path, CASE WHEN decomposition_recommended THEN 'fan_out' ELSE 'direct' END AS demo_path,
 CASE WHEN NOT {signs} THEN true WHEN query_type = 'ambiguous_or_noisy' THEN false ELSE {heed} END AS heeds_language, summary FROM ({inner})"""


ORACLE_SQL["route_paths"] = _paths_sql()


def _responses_sql() -> str:
    core = ["authoritative_case_number", "court", "language", "case_type", "case_summary", "holding", "pdf_url", "text_url_or_action"]
    full = lambda a: " AND ".join([sql.present(f"{a}.{c}") for c in core] + [f"coalesce(len({a}.{c}) > 0, false)" for c in ("legal_basis", "disputed_issues")])
    src = lambda n: f"(SELECT * FROM (SELECT *, trim(authoritative_case_number) AS k, row_number() OVER (PARTITION BY trim(authoritative_case_number) ORDER BY ord DESC) AS rn FROM case_metadata WHERE metadata_source = '{n}' AND {sql.present('authoritative_case_number')}) WHERE rn = 1)"
    pick = lambda f: f"coalesce(nullif(CASE w WHEN 'm' THEN m.{f} WHEN 'b' THEN b.{f} END, ''), " + ("case_id" if f == core[0] else f"trim(coalesce(h.{f}, ''))") + f") AS {f}"
    given = lambda c, word: f"CASE WHEN coalesce({c}, '') = '' THEN '{word}' ELSE {c} END"
    return f"""WITH {_fan_out_sql(research.DEFAULT_TOP_K)},
 ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ord) AS rn FROM case_chunks) WHERE rn = 1),
 hh AS (SELECT f.query_id, f.rank AS hit_rank, ch.*, trim(ch.authoritative_case_number) AS case_id FROM f JOIN ch USING (chunk_id) WHERE {sql.present('ch.authoritative_case_number')}),
 fh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY hit_rank) AS r1 FROM hh) WHERE r1 = 1),
 w AS (SELECT h.query_id, h.case_id, h.hit_rank, CASE WHEN m.k IS NOT NULL AND {full('m')} THEN 'm' WHEN b.k IS NOT NULL AND {full('b')} THEN 'b' WHEN m.k IS NOT NULL THEN 'm' WHEN b.k IS NOT NULL THEN 'b' ELSE 'hit' END AS w FROM fh h LEFT JOIN {src('model_generated')} m ON m.k = h.case_id LEFT JOIN {src('deterministic_baseline')} b ON b.k = h.case_id),
 e AS (SELECT h.query_id, h.hit_rank, w.w, coalesce(h.authoritative_decision_date, '') AS dd, {', '.join(pick(c) for c in core if c not in ('case_summary', 'holding'))} FROM fh h JOIN w USING (query_id, case_id) LEFT JOIN {src('model_generated')} m ON m.k = h.case_id LEFT JOIN {src('deterministic_baseline')} b ON b.k = h.case_id),
 g AS (SELECT *, CASE WHEN w = 'm' THEN 'model_generated' ELSE 'deterministic_baseline' END AS ms FROM e),
 t AS (SELECT query_id, count(*) AS n, count(*) FILTER (w = 'm') AS mm, bool_and({' AND '.join(f"{c} <> ''" for c in core if c not in ('case_summary', 'holding'))}) AS ok,
   string_agg(coalesce(nullif(concat_ws('｜', nullif(authoritative_case_number, ''), nullif(case_type, ''), nullif(court, '')), ''), '未命名案例'), '; ' ORDER BY hit_rank) AS titles,
   string_agg({given('language', 'unknown-language')} || ' · ' || {given('dd', 'unknown-date')} || ' · metadata:' || ms, '; ' ORDER BY hit_rank) AS subtitles FROM g GROUP BY 1)
SELECT i.item_id AS query_id, {research.DEFAULT_TOP_K} AS top_k, coalesce(n, 0)::INT AS result_count, coalesce(mm, 0) AS model_generated_metadata_used_count, coalesce(n - mm, 0) AS deterministic_fallback_used_count, coalesce(ok AND n > 0, false) AS success_flag, coalesce(titles, '') AS titles, coalesce(subtitles, '') AS subtitles
FROM eval_items i LEFT JOIN t ON t.query_id = i.item_id WHERE i.item_id % {EVERY} = 0"""


ORACLE_SQL["responses"] = _responses_sql()
