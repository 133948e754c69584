"""Queries of corpus building: de-duplication, layout, metadata joins, quality, cards, crawl history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import extract, text, urls
from foliant.operators import cards, chunking, dedupe, evaluation, lookup, multivalue, quality
from foliant.sources import corpus
from foliant.sources.tables import table
from foliant.streaming import crawl

from . import sql

CARDS = "playwright_result_cards_selector_driven"
MODEL, BASELINE, RULES = "model_generated", "deterministic_baseline", "deterministic_v1"
META_TEXTS = ["court", "case_type", "case_summary", "holding", "pdf_url"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One assistant judge per row, with position."""
    return multivalue.split_values(table(spark, d, CARDS))


def ordered_dedupe_reasons(spark: SparkSession, d: str) -> DataFrame:
    """First row of each sentence id wins; rows kept and dropped per court, by reason."""
    m = table(spark, d, "merge_case_rows")
    return dedupe.reason_counts(m, F.col("sentence_id"), F.col("ord"), F.coalesce("court", F.lit(""))).withColumnRenamed("grp", "court")


def first_cards(spark: SparkSession, d: str) -> DataFrame:
    """First card of each (court, case, date, addresses), nulls being equal."""
    c = table(spark, d, CARDS)
    return dedupe.first_wins(c, [F.col(k) for k in ("court", "case_number", "decision_date", "pdf_url", "text_url_or_action")], F.col("ord")).select("ord", "case_number", "page_number")


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows and first row of each tagged duplicate key of the cards."""
    c = table(spark, d, CARDS)
    key = dedupe.duplicate_key(F.array("text_url_zh", "text_url_pt"), F.array("pdf_url"), F.col("court"), F.col("case_number"), F.col("decision_date"))
    return c.select(key.alias("dup_key"), "ord").groupBy("dup_key").agg(F.count("*").alias("rows"), F.min("ord").alias("first_ord"))


def card_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Canonical address, sentence id, language and kind of every card's text link."""
    u = F.col("text_url_or_action")
    return table(spark, d, CARDS).select("ord", urls.canonical(u).alias("address"), urls.sentence_id(u).alias("sentence_id"), urls.language(u).alias("language"), urls.kind(u).alias("kind"))


def page_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the signature of their cards, and whether an earlier page has the same."""
    s = dedupe.page_signatures(table(spark, d, CARDS), ["page_number"], "case_number", "decision_date", "text_url_or_action")
    return s.select("page_number", "cards", "repeats_earlier")


def corpus_layout(spark: SparkSession, d: str) -> DataFrame:
    """Folder of every case in the corpus, made unique."""
    return corpus.layout(table(spark, d, "merge_case_rows")).select("ord", "language", "year", "case_slug", "full_text_path")


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every full text."""
    m = table(spark, d, "merge_case_rows").select("ord", "authoritative_case_number", "authoritative_decision_date", "language", "full_text")
    return chunking.chunk_rows(m, "full_text", "authoritative_case_number", "authoritative_decision_date", "language").select("ord", "chunk_index", "chunk_id", "chunk_text")


def chunk_counters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, cases, characters and chunks per case, by language and in total."""
    c = table(spark, d, "case_chunks").select(F.coalesce("language", F.lit("")).alias("language"), "authoritative_case_number", F.length("chunk_text").alias("n"))
    per_case = c.groupBy("language", F.coalesce(F.trim("authoritative_case_number"), F.lit("")).alias("case_id")).agg(F.count("*").alias("chunks"), F.sum("n").alias("n"))
    g = per_case.rollup("language").agg(F.sum("chunks").alias("chunks"), F.countDistinct("case_id").alias("cases"), F.sum("n").alias("characters"))
    return g.select(F.coalesce("language", F.lit("*")).alias("language"), "chunks", "cases", "characters", F.round(F.col("chunks") / F.col("cases"), 6).alias("chunks_per_case"))


def case_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Per case: chunks, languages, text length, first and last row; blank cases together."""
    k = F.when(dedupe.present(F.col("authoritative_case_number")), F.trim("authoritative_case_number")).otherwise("UNKNOWN_CASE")
    g = table(spark, d, "case_chunks").groupBy(k.alias("case_id")).agg(
        F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.sum(F.length("chunk_text")).alias("characters"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
    )
    return g


def metadata_attached(spark: SparkSession, d: str) -> DataFrame:
    """Merged rows with the last metadata row of their sentence id."""
    rows = table(spark, d, "merge_case_rows").select("ord", F.trim("sentence_id").alias("sentence_id"))
    meta = table(spark, d, "case_metadata").select(F.trim("sentence_id").alias("sentence_id"), "case_type", "holding", "ord")
    return lookup.attach(rows, meta, "sentence_id", ["case_type", "holding"], "ord").select("ord", "sentence_id", "case_type", "holding", "attached")


def _by_source(spark: SparkSession, d: str, source: str) -> DataFrame:
    """Last row of one metadata source per sentence id."""
    m = table(spark, d, "case_metadata").where((F.col("metadata_source") == source) & dedupe.present(F.col("sentence_id")))
    return m.groupBy(F.trim("sentence_id").alias("key")).agg(F.max_by(F.struct(*META_TEXTS, "legal_basis", "disputed_issues"), "ord").alias(source))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "merge_case_rows").where(dedupe.present(F.col("sentence_id"))).select(F.trim("sentence_id").alias("key")).distinct()
    out = keys
    for s in (MODEL, BASELINE, RULES):
        out = out.join(_by_source(spark, d, s), "key", "left")
    return out


def row_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which source a case takes its metadata from: complete ones first, then any, then the fallback."""
    x = _sources(spark, d)
    choice = lookup.row_priority(
        x,
        [(s, F.col(s).isNotNull(), F.coalesce(F.col(s).isNotNull() & lookup.complete(META_TEXTS, ["legal_basis", "disputed_issues"], f"{s}."), F.lit(False))) for s in (MODEL, BASELINE)],
    )
    return x.select("key", choice.alias("metadata_source"))


def field_choice(spark: SparkSession, d: str) -> DataFrame:
    """Summary and holding of each case, each from its first source with a value, with that source's name."""
    x = _sources(spark, d)
    cols = [F.col("key")]
    for f in ("case_summary", "holding"):
        value, source = lookup.first_value(*[(s, F.col(f"{s}.{f}")) for s in (MODEL, BASELINE, RULES)])
        cols += [value.alias(f), source.alias(f"{f}_source")]
    return x.select(*cols)


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many cases each source covers that no earlier one does."""
    keys = table(spark, d, "merge_case_rows").where(dedupe.present(F.col("sentence_id"))).select(F.trim("sentence_id").alias("key")).distinct()
    return lookup.coverage(keys, "key", {s: _by_source(spark, d, s).select("key") for s in (MODEL, BASELINE, RULES)})


def baseline_against_model(spark: SparkSession, d: str) -> DataFrame:
    """Rows by field and comparison status."""
    x = _sources(spark, d).where(F.col(BASELINE).isNotNull())
    return lookup.field_status(x, META_TEXTS, BASELINE, MODEL).groupBy("field_name", "status").agg(F.count("*").alias("cases"))


def two_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Holding by sentence id, else by address."""
    items = table(spark, d, "research_result_items").select("ord", urls.sentence_id(F.col("text_url_or_action")).alias("sid"), "pdf_url")
    meta = table(spark, d, "case_metadata").where(dedupe.present(F.col("holding")))
    a = meta.where(dedupe.present(F.col("sentence_id"))).groupBy(F.col("sentence_id").alias("sid")).agg(F.max_by("holding", "ord").alias("holding"))
    b = meta.where(dedupe.present(F.col("pdf_url"))).groupBy("pdf_url").agg(F.max_by("holding", "ord").alias("holding"))
    return lookup.two_keys(items, a, b, "sid", "pdf_url", "holding").select("ord", "holding")


def population(spark: SparkSession, d: str) -> DataFrame:
    """Filled fields of the metadata and their share."""
    return evaluation.population(table(spark, d, "case_metadata"), META_TEXTS, ["legal_basis", "disputed_issues"])


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents that pass the two text rules, per cleaned language."""
    x = table(spark, d, "documents").select(F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("lang"), quality.good_text(F.col("text")).alias("a"), quality.good_detail(F.col("text")).alias("b"))
    return x.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("a").alias("good"), F.count_if("b").alias("good_detail"))


def page_validity(spark: SparkSession, d: str) -> DataFrame:
    """First rule each result page fails."""
    return quality.page_validity(table(spark, d, CARDS), "page_number")


def card_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters over all cards."""
    return quality.card_metrics(table(spark, d, CARDS))


def contaminated_cards(spark: SparkSession, d: str) -> DataFrame:
    """Whether every card holds several cards, looks like a result, and is no rule between cards."""
    raw = F.col("raw_card_text")
    links = F.when(dedupe.present(F.col("pdf_url")), 1).otherwise(0) + F.when(dedupe.present(F.col("text_url_or_action")), 1).otherwise(0)
    return table(spark, d, CARDS).select("ord", quality.contaminated(raw).alias("contaminated"), quality.result_like(raw, links).alias("result_like"), quality.separator(F.lit(None).cast("string"), raw).alias("separator"))


def card_lines(spark: SparkSession, d: str) -> DataFrame:
    """Number and type read from the lines of every card, its cleaned type and whether that is valid."""
    raw = F.coalesce("raw_card_text", F.lit(""))
    lines = extract.head_lines(raw, 1000)
    x = table(spark, d, CARDS).select("ord", "case_type", extract.case_number_and_type(lines, raw).alias("r"))
    return x.select("ord", "r.case_number", F.col("r.case_type").alias("line_type"), extract.clean_case_type(F.col("case_type")).alias("clean_type"), extract.valid_case_type(F.col("case_type")).alias("valid"))


def card_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cards by each of the keys in use: addresses, document else raw text, and the bare triples."""
    c = F.col
    x = table(spark, d, CARDS)
    first = lambda *cols: F.coalesce(*[F.nullif(c(n), F.lit("")) for n in cols])
    keys = {
        "addresses": dedupe.card_key(c("court"), c("case_number"), c("decision_date"), [c("text_url_zh"), c("text_url_pt")], [c("pdf_url")]),
        "document_or_raw": dedupe.raw_card_key(c("court"), c("case_number"), c("decision_date"), first("pdf_url", "text_url_or_action"), c("raw_card_text")),
        "date_case_raw": [c("decision_date"), c("case_number"), c("raw_card_text")], "subject_case_raw": [c("subject"), c("case_number"), c("raw_card_text")],
    }
    out = None
    for name, key in keys.items():
        kept = dedupe.first_wins(x, key, c("ord")).agg(F.lit(name).alias("key_name"), F.count("*").alias("cards"), F.sum("ord").alias("ords"))
        out = kept if out is None else out.unionByName(kept)
    return out


def link_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the cards by kind and language."""
    return quality.link_metrics(table(spark, d, CARDS))


def boundary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Valid numbers and types of the cards, contaminated ones, and the verdict on the set."""
    return quality.boundary_metrics(table(spark, d, CARDS))


def populated_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Filled leaves of the metadata read as nested records."""
    m = table(spark, d, "case_metadata").select(F.struct("authoritative_case_number", "court", "language", "case_type").alias("core"), F.struct("case_summary", "holding", "legal_basis", "disputed_issues").alias("digest"))
    return evaluation.populated_leaves(m)


def normal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Ranking form, preview and clipped form of every summary, as digests and texts."""
    c = F.col("case_summary")
    return table(spark, d, "research_result_items").select("ord", F.md5(text.ranking_text(c)).alias("ranking_md5"), F.md5(text.preview(c)).alias("preview_md5"), text.clip(c, 60).alias("clipped"))


def case_cards(spark: SparkSession, d: str) -> DataFrame:
    """Title, subtitle and tags of every returned item."""
    c = F.col
    return table(spark, d, "research_result_items").select(
        "ord",
        cards.card_title(c("authoritative_case_number"), c("case_type"), c("court")).alias("title"),
        cards.card_subtitle(c("language"), c("authoritative_decision_date"), c("metadata_source")).alias("subtitle"),
        F.array_join(cards.card_tags(c("case_type"), c("language"), c("metadata_source"), c("legal_basis")), ";").alias("tags"),
    )


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """One response per language over its ten latest items: counters and the order of the cards."""
    from foliant.operators import search

    items = table(spark, d, "research_result_items").where("language IS NOT NULL")
    ranked = search.top_k(items.select(F.col("language").alias("query_id"), F.unix_timestamp("returned_at").cast("double").alias("score"), "ord", F.coalesce("metadata_source", F.lit("")).alias("metadata_source")), 10, "ord")
    env = cards.envelope(ranked.select("query_id", "rank", "ord", "metadata_source"), items.select(F.col("language").alias("query_id")).distinct(), 10)
    return env.select("query_id", "schema_version", "result_count", "diagnostics.model_generated_used", "diagnostics.fallback_used", "diagnostics.success", F.array_join(F.transform("results", lambda r: r["ord"].cast("string")), ",").alias("ords"))


def latest_by_court(spark: SparkSession, d: str) -> DataFrame:
    """First and last decision date per court, dd/MM/yyyy and yyyy-MM-dd read as dates, others left out."""
    day = F.coalesce(F.try_to_date(F.trim("authoritative_decision_date"), "dd/MM/yyyy"), F.try_to_date(F.trim("authoritative_decision_date"), "yyyy-MM-dd"))
    x = table(spark, d, "merge_case_rows").select(F.coalesce("court", F.lit("")).alias("court"), day.alias("day"))
    return x.groupBy("court").agg(F.count("*").alias("rows"), F.count("day").alias("dated"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


def new_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Crawl rounds (days): cards, sentence ids met first, and whether the crawl has converged."""
    c = table(spark, d, CARDS).select(F.to_date("crawled_at").alias("round"), urls.sentence_id(F.col("text_url_or_action")).alias("sid"))
    return crawl.convergence(crawl.new_per_round(c, "round", "sid"), "round", most=60).select(F.col("round").cast("string").alias("round"), "records", "new_keys", "quiet_rounds", "decision")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type with their mean value (batch form of the windowed stream)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean_value"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "events", "mean_value")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user, ended by half an hour without an event: how many, their events and the longest (batch form of the stream)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id IS NOT NULL")
    s = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per window of two hours that begins every hour."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("events"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("begin"), "events")


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A property taken from the JSON text of every event, counted."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("events"))


def card_headers(spark: SparkSession, d: str) -> DataFrame:
    """Date, case number and type read from the raw text of every card."""
    return table(spark, d, CARDS).select("ord", text.header(F.col("raw_card_text")).alias("h")).select("ord", "h.*")


def clean_bases(spark: SparkSession, d: str) -> DataFrame:
    """Legal bases of every returned item as a clean list: trimmed, each once whatever its case, eight at most as shown."""
    got = text.distinct_ignoring_case(F.coalesce("legal_basis", F.array().cast("array<string>")), 8)
    return table(spark, d, "research_result_items").select("ord", F.array_join(got, "; ").alias("bases"), F.size(got).alias("n"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parts behind blank-followed terminators per chunk (the plain splitter; Chinese without blanks stays whole)."""
    parts = text.spaced_sentences(F.col("chunk_text"))
    return table(spark, d, "case_chunks").select("ord", F.coalesce(F.size(parts), F.lit(0)).alias("parts"), F.md5(F.array_join(parts, "|")).alias("digest"))


def text_routes(spark: SparkSession, d: str) -> DataFrame:
    """Full texts and documents by the length route of a prompt, at its own limits."""
    texts = table(spark, d, "merge_case_rows").select(F.col("full_text").alias("t")).unionAll(table(spark, d, "documents").select(F.col("text").alias("t")))
    return texts.groupBy(text.length_route(F.coalesce("t", F.lit(""))).alias("route")).agg(F.count("*").alias("texts"))


def paragraphs_kept(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document in the paragraph-keeping form."""
    return table(spark, d, "case_chunks").select("ord", F.md5(text.keep_paragraphs(F.col("chunk_text"))).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        p5_found, ordered_dedupe_reasons, first_cards, duplicate_keys, card_addresses, page_repeats, corpus_layout, packed_chunks, chunk_counters, case_profiles,
        metadata_attached, row_choice, field_choice, coverage_counts, baseline_against_model, two_key_lookup, population, text_quality, page_validity, card_metrics,
        contaminated_cards, card_lines, card_sets, link_metrics, boundary_metrics, populated_leaves, normal_texts, case_cards, envelopes, latest_by_court, new_per_day, event_windows, event_sessions, sliding_events, event_properties, card_headers, clean_bases, sentence_counts, text_routes, paragraphs_kept,
    )
}

_P = sql.present


def _src(name: str) -> str:
    """Last row of a source per key."""
    cols = ", ".join([*META_TEXTS, "legal_basis", "disputed_issues"])
    return f"SELECT trim(sentence_id) AS key, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY trim(sentence_id) ORDER BY ord DESC) AS rn FROM case_metadata WHERE metadata_source = '{name}' AND {_P('sentence_id')}) WHERE rn = 1"


_KEYS = f"SELECT DISTINCT trim(sentence_id) AS key FROM merge_case_rows WHERE {_P('sentence_id')}"
_WITH = f"WITH k AS ({_KEYS}), m AS ({_src(MODEL)}), b AS ({_src(BASELINE)}), r AS ({_src(RULES)})"


def _complete(a: str) -> str:
    return " AND ".join([_P(f"{a}.{c}") for c in META_TEXTS] + [f"coalesce(len({a}.{c}) > 0, false)" for c in ("legal_basis", "disputed_issues")])


def _field(f: str) -> str:
    v = f"coalesce(CASE WHEN {_P('m.' + f)} THEN m.{f} END, CASE WHEN {_P('b.' + f)} THEN b.{f} END, CASE WHEN {_P('r.' + f)} THEN r.{f} END, '') AS {f}"
    return v + f", CASE WHEN {_P('m.' + f)} THEN '{MODEL}' WHEN {_P('b.' + f)} THEN '{BASELINE}' WHEN {_P('r.' + f)} THEN '{RULES}' ELSE 'empty' END AS {f}_source"


def _canonical(c: str) -> str:
    t = f"regexp_replace(trim({c}), '#.*$', '')"
    t = f"CASE WHEN regexp_matches({t}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {t} WHEN starts_with({t}, '//') THEN 'https:' || {t} ELSE 'https://' || {t} END"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({t}, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&')"
    return (
        f"CASE WHEN coalesce(trim({c}), '') <> '' THEN lower(regexp_extract({t}, '^([^:]+)://', 1)) || '://' || lower(regexp_extract({t}, '^[^:]+://([^/?]*)', 1)) || "
        f"regexp_replace(regexp_extract({t}, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )


def _keyed(cols: list[str]) -> str:
    return "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(_canonical(c) for c in cols) + "], lambda x: x IS NOT NULL))), '|')"


_SID = "nullif(regexp_extract({0}, '(?i)/sentence/(?:zh|pt)/([0-9]+)', 1), '')"
_URL_LANG = "CASE WHEN contains(lower({0}), '/zh/') THEN 'zh' WHEN contains(lower({0}), '/pt/') THEN 'pt' ELSE 'unknown' END"
_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_GOOD = "coalesce(length(text) >= {0} AND " + _WORDS + " >= 60, false)"
_DAY = "coalesce(try_strptime(trim(authoritative_decision_date), '%d/%m/%Y'), try_strptime(trim(authoritative_decision_date), '%Y-%m-%d'))::DATE"
_U = "text_url_or_action"
_DATES = extract.ANY_DATE[1:-1].replace("\\d", "[0-9]")
_CASE, _PREFIXED = "[0-9]{1,6}/[0-9]{4}", "(?i)[A-Z]{1,8}-?[0-9]{1,6}/[0-9]{2,4}"


def _hits(pattern: str) -> str:
    """How often a pattern is met as a word in r; what lies between words is doubled, as each match takes its borders."""
    head = "(?i)" if pattern.startswith("(?i)") else ""
    doubled = "regexp_replace(r, '([^\\p{L}\\p{N}_/])', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({doubled}, '{head}(?:^|[^\\p{{L}}\\p{{N}}_]){pattern.removeprefix('(?i)')}(?:$|[^\\p{{L}}\\p{{N}}_])'))"


def _marks() -> str:
    return " + ".join(f"(length(r) - length(replace(r, '{x}', ''))) // {len(x)}" for x in quality.CARD_LABELS)


def _number(c: str) -> str:
    """First case number as a word in a text, plain before prefixed; '' where there is none."""
    one = lambda p: f"regexp_extract({c}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({p.removeprefix('(?i)')})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"
    return f"coalesce(nullif({one(_CASE)}, ''), nullif({one(_PREFIXED)}, ''), '')"


def _clean(c: str) -> str:
    v = sql.squeeze(f"coalesce({c}, '')")
    bare = sql.squeeze(f"regexp_replace({v}, '^[-:：,，.]+', '')")
    return f"CASE WHEN NOT regexp_matches({v}, '^/[0-9]{{2,4}}$') AND NOT regexp_matches({bare}, '^/[0-9]{{2,4}}$') AND {bare} <> '' THEN {bare} END"


def _card_keys() -> dict[str, str]:
    q = lambda c: sql.squeeze(f"coalesce({c}, '')")
    joined = lambda cols: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(map(q, cols))}], lambda x: x <> ''))), '|')"
    t = joined(["text_url_zh", "text_url_pt"])
    doc = q("coalesce(nullif(pdf_url, ''), nullif(text_url_or_action, ''))")
    blank = f"({q('case_number')} = '' AND {q('decision_date')} = '' AND {doc} = '')"
    return {
        "addresses": f"{q('court')}, {q('case_number')}, {q('decision_date')}, CASE WHEN {t} <> '' THEN {t} ELSE {joined(['pdf_url'])} END",
        "document_or_raw": f"court, CASE WHEN NOT {blank} THEN {q('case_number')} END, CASE WHEN NOT {blank} THEN {q('decision_date')} END, CASE WHEN {blank} THEN 'raw:' || {q('raw_card_text')} ELSE {doc} END",
        "date_case_raw": "decision_date, case_number, raw_card_text",
        "subject_case_raw": "subject, case_number, raw_card_text",
    }


ORACLE_SQL = {
    "ordered_dedupe_reasons": f"""WITH x AS (SELECT coalesce(court, '') AS court, CASE WHEN {_P('sentence_id')} THEN trim(sentence_id) END AS k, ord FROM merge_case_rows),
 y AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY ord) = 1 AS kept FROM x)
 SELECT court, count(*) AS seen, count(*) FILTER (kept) AS kept, count(*) FILTER (k IS NULL) AS without_key, count(*) FILTER (k IS NOT NULL AND NOT kept) AS duplicates FROM y GROUP BY 1""",
    "first_cards": f"SELECT ord, case_number, page_number FROM (SELECT *, row_number() OVER (PARTITION BY court, case_number, decision_date, pdf_url, text_url_or_action ORDER BY ord) AS rn FROM {CARDS}) WHERE rn = 1",
    "duplicate_keys": f"""SELECT dup_key, count(*) AS rows, min(ord) AS first_ord FROM (SELECT ord, CASE WHEN t <> '' THEN 'text:' || t WHEN p <> '' THEN 'pdf:' || p
 ELSE 'meta:' || concat_ws('|', coalesce(trim(court), ''), coalesce(trim(case_number), ''), coalesce(trim(decision_date), '')) END AS dup_key
 FROM (SELECT *, {_keyed(['text_url_zh', 'text_url_pt'])} AS t, {_keyed(['pdf_url'])} AS p FROM {CARDS})) GROUP BY 1""",
    "card_addresses": f"""SELECT ord, {_canonical(_U)} AS address, {_SID.format(_U)} AS sentence_id, {_URL_LANG.format(_U)} AS language,
 CASE WHEN regexp_matches({_U}, '(?i)\\.pdf($|[?#])') THEN 'pdf' WHEN {_SID.format(_U)} IS NOT NULL AND {_URL_LANG.format(_U)} = 'zh' THEN 'text_zh' WHEN {_SID.format(_U)} IS NOT NULL AND {_URL_LANG.format(_U)} = 'pt' THEN 'text_pt' ELSE 'other' END AS kind FROM {CARDS}""",
    "page_repeats": f"""WITH s AS (SELECT page_number, count(*) AS cards, list_sort(list_distinct(list(concat_ws('|', coalesce(case_number, ''), coalesce(decision_date, ''), coalesce(text_url_or_action, ''))))) AS sig FROM {CARDS} GROUP BY 1)
 SELECT page_number, cards, page_number <> min(page_number) OVER (PARTITION BY sig) AS repeats_earlier FROM s""",
    "corpus_layout": """WITH x AS (SELECT ord, CASE WHEN coalesce(trim(language), '') <> '' THEN lower(trim(language)) ELSE 'unknown' END AS language,
 coalesce(nullif(regexp_extract(coalesce(authoritative_decision_date, ''), '((?:19|20)[0-9]{2})', 1), ''), 'unknown_year') AS year,
 regexp_replace(regexp_replace(lower(coalesce(authoritative_case_number, '')), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM merge_case_rows),
 y AS (SELECT *, CASE WHEN s = '' THEN printf('unknown_case_%04d', ord) ELSE s END AS slug FROM x),
 z AS (SELECT *, row_number() OVER (PARTITION BY language, year, slug ORDER BY ord) AS rn FROM y)
 SELECT ord, language, year, case_slug, 'cases/' || language || '/' || year || '/' || case_slug || '/full_text.txt' AS full_text_path FROM (SELECT *, CASE WHEN rn > 1 THEN slug || '__dup' || rn ELSE slug END AS case_slug FROM z)""",
    "chunk_counters": """WITH c AS (SELECT coalesce(language, '') AS language, coalesce(trim(authoritative_case_number), '') AS k, length(chunk_text) AS n FROM case_chunks)
 SELECT coalesce(language, '*') AS language, count(*) AS chunks, count(DISTINCT k) AS cases, sum(n)::BIGINT AS characters, round(count(*) / count(DISTINCT k), 6) AS chunks_per_case FROM c GROUP BY ROLLUP (language)""",
    "case_profiles": f"""SELECT CASE WHEN {_P('authoritative_case_number')} THEN trim(authoritative_case_number) ELSE 'UNKNOWN_CASE' END AS case_id, count(*) AS chunks,
 coalesce(array_to_string(list_sort(list_distinct(list(language))), ','), '') AS languages, sum(length(chunk_text))::BIGINT AS characters, min(ord) AS first_ord, max(ord) AS last_ord FROM case_chunks GROUP BY 1""",
    "metadata_attached": f"""WITH m AS (SELECT trim(sentence_id) AS k, arg_max(coalesce(case_type, chr(0)), ord) AS case_type, arg_max(coalesce(holding, chr(0)), ord) AS holding FROM case_metadata WHERE {_P('sentence_id')} GROUP BY 1)
 SELECT r.ord, trim(r.sentence_id) AS sentence_id, coalesce(nullif(m.case_type, chr(0)), '') AS case_type, coalesce(nullif(m.holding, chr(0)), '') AS holding, m.k IS NOT NULL AS attached FROM merge_case_rows r LEFT JOIN m ON m.k = trim(r.sentence_id)""",
    "row_choice": f"""{_WITH} SELECT k.key, CASE WHEN m.key IS NOT NULL AND {_complete('m')} THEN '{MODEL}' WHEN b.key IS NOT NULL AND {_complete('b')} THEN '{BASELINE}' WHEN m.key IS NOT NULL THEN '{MODEL}' WHEN b.key IS NOT NULL THEN '{BASELINE}' ELSE 'fallback' END AS metadata_source
 FROM k LEFT JOIN m USING (key) LEFT JOIN b USING (key)""",
    "field_choice": f"{_WITH} SELECT k.key, {_field('case_summary')}, {_field('holding')} FROM k LEFT JOIN m USING (key) LEFT JOIN b USING (key) LEFT JOIN r USING (key)",
    "coverage_counts": f"""{_WITH} SELECT CASE WHEN m.key IS NOT NULL THEN '{MODEL}' WHEN b.key IS NOT NULL THEN '{BASELINE}' WHEN r.key IS NOT NULL THEN '{RULES}' ELSE 'unresolved' END AS resolved_by, count(*) AS keys
 FROM k LEFT JOIN m USING (key) LEFT JOIN b USING (key) LEFT JOIN r USING (key) GROUP BY 1""",
    "baseline_against_model": f"{_WITH}, x AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field_name, m.key IS NULL AS pending, coalesce(trim(b.{f}), '') AS bv, coalesce(trim(m.{f}), '') AS mv FROM k JOIN b USING (key) LEFT JOIN m USING (key)" for f in META_TEXTS
    )
    + ") SELECT field_name, CASE WHEN pending THEN 'model_pending' WHEN mv = '' THEN 'model_missing_field' WHEN bv = '' THEN 'baseline_missing_field' WHEN bv = mv THEN 'match' ELSE 'different' END AS status, count(*) AS cases FROM x GROUP BY ALL",
    "two_key_lookup": f"""WITH m AS (SELECT * FROM case_metadata WHERE {_P('holding')}), a AS (SELECT sentence_id AS sid, arg_max(holding, ord) AS holding FROM m WHERE {_P('sentence_id')} GROUP BY 1), b AS (SELECT pdf_url, arg_max(holding, ord) AS holding FROM m WHERE {_P('pdf_url')} GROUP BY 1)
 SELECT i.ord, coalesce(a.holding, b.holding) AS holding FROM research_result_items i LEFT JOIN a ON a.sid = {_SID.format('i.text_url_or_action')} LEFT JOIN b ON b.pdf_url = i.pdf_url""",
    "population": " UNION ALL ".join(
        [f"SELECT '{c}' AS field_name, count(*) FILTER ({_P(c)}) AS filled, round(count(*) FILTER ({_P(c)}) / count(*), 6) AS share FROM case_metadata" for c in META_TEXTS]
        + [f"SELECT '{c}', count(*) FILTER (coalesce(len({c}) > 0, false)), round(count(*) FILTER (coalesce(len({c}) > 0, false)) / count(*), 6) FROM case_metadata" for c in ("legal_basis", "disputed_issues")]
    ),
    "text_quality": f"""SELECT lower(trim(coalesce(lang, ''))) AS lang, count(*) AS documents, count(*) FILTER ({_GOOD.format(200)}) AS good,
 count(*) FILTER ({_GOOD.format(240)} AND NOT (length(text) < 420 AND regexp_matches(text, '{quality.CASE}') AND regexp_matches(text, '{quality.DATE}'))) AS good_detail FROM documents GROUP BY 1""",
    "page_validity": f"""SELECT *, failed_rule = '' AS valid FROM (SELECT *, CASE WHEN cards < 5 THEN 'too_few_cards' WHEN with_case < 3 THEN 'too_few_case_numbers' WHEN with_document < 3 THEN 'too_few_documents' ELSE '' END AS failed_rule FROM
 (SELECT page_number, count(*) AS cards, count(*) FILTER ({_P('case_number')}) AS with_case, count(*) FILTER ({_P('pdf_url')} OR {_P('text_url_or_action')}) AS with_document FROM {CARDS} GROUP BY 1))""",
    "card_metrics": f"""SELECT *, with_case / cards >= 0.6 AS case_ok, with_date / cards >= 0.6 AS date_ok, with_document / cards >= 0.6 AS document_ok, with_type / cards >= 0.6 AS type_ok FROM
 (SELECT count(*) AS cards, count(*) FILTER ({_P('case_number')}) AS with_case, count(*) FILTER ({_P('decision_date')}) AS with_date, count(*) FILTER ({_P('pdf_url')} OR {_P('text_url_or_action')}) AS with_document, count(*) FILTER ({_P('case_type')}) AS with_type FROM {CARDS})""",
    "contaminated_cards": f"""SELECT ord, r = '' OR {_hits(_CASE)} + {_hits(_PREFIXED)} > 1 OR len(regexp_extract_all(r, '{_DATES}')) > 1 OR {_marks()} > 6 AS contaminated,
 length(coalesce(raw_card_text, '')) >= 20 AND (coalesce(regexp_matches(raw_card_text, '{quality.CASE}'), false) OR (coalesce(regexp_matches(raw_card_text, '{_DATES}'), false) AND links > 0) OR (links >= 2 AND length(coalesce(raw_card_text, '')) >= 40)) AS result_like, length(r) < 4 AS separator
 FROM (SELECT *, {sql.squeeze("coalesce(raw_card_text, '')")} AS r, {_P('pdf_url')}::INT + {_P('text_url_or_action')}::INT AS links FROM {CARDS})""",
    "card_lines": f"""WITH l AS (SELECT ord, case_type, coalesce(raw_card_text, '') AS raw, list_filter(list_transform(string_split(coalesce(raw_card_text, ''), chr(10)), lambda x: {sql.squeeze('x')}), lambda x: x <> '') AS ls FROM {CARDS}),
 n AS (SELECT *, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {{'n': {_number('ls[i]')}, 'x': ls[i], 'nx': coalesce(ls[i + 1], '')}}), lambda r: r.n <> '')[1] AS r FROM l),
 k AS (SELECT *, {_clean("substr(r.x, instr(r.x, r.n) + length(r.n))")} AS behind, {_clean("substr(r.x, 1, instr(r.x, r.n) - 1)")} AS before, {_clean('r.nx')} AS nxt FROM n)
 SELECT ord, coalesce(r.n, nullif({_number('raw')}, '')) AS case_number, CASE WHEN r.n IS NOT NULL THEN coalesce(behind, CASE WHEN NOT regexp_matches(before, '{_DATES}') THEN before END, CASE WHEN {_number('nxt')} = '' AND NOT regexp_matches(nxt, '{_DATES}') THEN nxt END) END AS line_type,
 {_clean('case_type')} AS clean_type, {sql.squeeze("coalesce(case_type, '')")} <> '' AND NOT regexp_matches({sql.squeeze("coalesce(case_type, '')")}, '^/[0-9]{{2,4}}$') AS valid FROM k""",
    "card_sets": " UNION ALL ".join(f"SELECT '{n}' AS key_name, count(*) AS cards, sum(o)::BIGINT AS ords FROM (SELECT min(ord) AS o FROM {CARDS} GROUP BY {k})" for n, k in _card_keys().items()),
    "link_metrics": f"""SELECT count(*) AS cards, count(*) FILTER ({_P('pdf_url')}) AS cards_with_pdf, count(*) FILTER ({_P(_U)}) AS cards_with_text, count(*) FILTER ({_P('pdf_url')} AND {_P(_U)}) AS cards_with_both,
 count(*) FILTER (coalesce(text_link_language = 'zh', false) OR coalesce(regexp_matches({_U}, '(?i)/sentence/zh/[0-9]+'), false)) AS zh_text_links, count(*) FILTER (coalesce(text_link_language = 'pt', false) OR coalesce(regexp_matches({_U}, '(?i)/sentence/pt/[0-9]+'), false)) AS pt_text_links,
 count(*) FILTER ({_P('text_url_zh')}) AS zh_texts, count(*) FILTER ({_P('text_url_pt')}) AS pt_texts, count(*) FILTER ({_P('text_url_zh')} AND {_P('text_url_pt')}) AS both_texts FROM {CARDS}""",
    "boundary_metrics": f"""SELECT *, cards > 0 AND contaminated = 0 AND valid_numbers >= greatest(1, floor(cards * 0.6)) AND valid_types >= greatest(1, floor(cards * 0.6)) AS success FROM (SELECT count(*) AS cards,
 count(*) FILTER (coalesce(regexp_matches({sql.squeeze('case_number')}, '^[0-9]{{1,6}}/[0-9]{{4}}$'), false)) AS valid_numbers, count(*) FILTER ({sql.squeeze("coalesce(case_type, '')")} <> '' AND NOT regexp_matches({sql.squeeze("coalesce(case_type, '')")}, '^/[0-9]{{2,4}}$')) AS valid_types,
 count(*) FILTER (r = '' OR {_hits(_CASE)} + {_hits(_PREFIXED)} > 1 OR len(regexp_extract_all(r, '{_DATES}')) > 1 OR {_marks()} > 6) AS contaminated FROM (SELECT *, {sql.squeeze("coalesce(raw_card_text, '')")} AS r FROM {CARDS}))""",
    "populated_leaves": "SELECT (" + " + ".join([f"count(*) FILTER ({_P(c)})" for c in ("authoritative_case_number", "court", "language", "case_type", "case_summary", "holding")] + [f"count(*) FILTER (coalesce(len({c}) > 0, false))" for c in ("legal_basis", "disputed_issues")]) + ")::BIGINT AS populated, count(*) * 8 AS total FROM case_metadata",
    "normal_texts": f"""SELECT ord, md5({sql.ranking_text('case_summary')}) AS ranking_md5, md5(CASE WHEN length({sql.squeeze('case_summary')}) <= 220 THEN {sql.squeeze('case_summary')} ELSE substr({sql.squeeze('case_summary')}, 1, 220) || '...' END) AS preview_md5,
 CASE WHEN length(case_summary) <= 60 THEN case_summary ELSE substr(case_summary, 1, 57) || '...' END AS clipped FROM research_result_items""",
    "case_cards": """SELECT ord, coalesce(nullif(concat_ws('｜', nullif(authoritative_case_number, ''), nullif(case_type, ''), nullif(court, '')), ''), '未命名案例') AS title,
 concat_ws(' · ', coalesce(nullif(language, ''), 'unknown-language'), coalesce(nullif(authoritative_decision_date, ''), 'unknown-date'), 'metadata:' || coalesce(nullif(metadata_source, ''), 'unknown')) AS subtitle,
 array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END], lambda x: x <> '') || list_transform(list_filter(list_transform(coalesce(legal_basis, [])[1:2], lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), lambda x: 'basis:' || x), ';') AS tags
 FROM (SELECT *, trim(coalesce(case_type, '')) AS a, trim(coalesce(language, '')) AS b, trim(coalesce(metadata_source, '')) AS c FROM research_result_items)""",
    "envelopes": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY epoch(returned_at)::BIGINT DESC, ord) AS rank FROM research_result_items WHERE language IS NOT NULL AND returned_at IS NOT NULL),
 t AS (SELECT language, count(*) AS n, count(*) FILTER (metadata_source = 'model_generated') AS m, string_agg(ord::VARCHAR, ',' ORDER BY rank) AS ords FROM r WHERE rank <= 10 GROUP BY 1)
 SELECT language AS query_id, '1' AS schema_version, n AS result_count, m AS model_generated_used, n - m AS fallback_used, n > 0 AS success, ords FROM t""",
    "latest_by_court": f"SELECT coalesce(court, '') AS court, count(*) AS rows, count({_DAY}) AS dated, min({_DAY})::VARCHAR AS first_day, max({_DAY})::VARCHAR AS last_day FROM merge_case_rows GROUP BY 1",
    "new_per_day": f"""WITH c AS (SELECT crawled_at::DATE AS d, {_SID.format(_U)} AS sid FROM {CARDS}), f AS (SELECT d, count(*) AS new_keys FROM (SELECT sid, min(d) AS d FROM c WHERE sid IS NOT NULL GROUP BY 1) GROUP BY 1),
 p AS (SELECT c.d, count(*) AS records, coalesce(any_value(f.new_keys), 0) AS new_keys FROM c LEFT JOIN f ON f.d = c.d GROUP BY 1),
 q AS (SELECT *, row_number() OVER (ORDER BY d) AS no, sum((new_keys > 0)::INT) OVER (ORDER BY d) AS run FROM p),
 s AS (SELECT *, sum((new_keys = 0)::INT) OVER (PARTITION BY run ORDER BY d) AS quiet FROM q)
 SELECT d::VARCHAR AS round, records, new_keys, quiet AS quiet_rounds, CASE WHEN quiet >= 2 THEN 'converged' WHEN no >= 60 THEN 'round_limit' ELSE 'go_on' END AS decision FROM s""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS events, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2",
    "sliding_events": "SELECT strftime(b, '%Y-%m-%d %H:%M') AS begin, count(*) AS events FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY 1",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL),
 b AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a), c AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY ALL)
 SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY 1""",
    "event_properties": "SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS events FROM events GROUP BY 1, 2",
}

_LINE = sql.squeeze("raw_card_text")
_REST = f"regexp_extract({_LINE}, '[0-9]{{1,2}}/[0-9]{{1,2}}/(?:19|20)[0-9]{{2}}(.*)$', 1)"
_NUM = "[0-9]{1,5}/[0-9]{4}(?:-[A-Z]{1,3})?"
_MARKED = "regexp_replace(chunk_text, '([。.!?；;])\\s+', '\\1' || chr(1), 'g')"
ORACLE_SQL |= {
    "card_headers": f"""SELECT ord, nullif(regexp_extract({_LINE}, '([0-9]{{1,2}}/[0-9]{{1,2}}/(?:19|20)[0-9]{{2}})', 1), '') AS decision_date, nullif(regexp_extract({_REST}, '({_NUM})', 1), '') AS case_number,
 nullif(trim(regexp_replace(regexp_extract({_REST}, '{_NUM}(.*)$', 1), '^[^\\p{{L}}]+', '')), '') AS case_type FROM {CARDS}""",
    "clean_bases": """WITH a AS (SELECT ord, list_filter(list_transform(coalesce(legal_basis, []), lambda x: trim(x)), lambda x: x <> '') AS l FROM research_result_items),
 b AS (SELECT ord, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:8] AS l FROM a) SELECT ord, coalesce(array_to_string(l, '; '), '') AS bases, len(l)::INT AS n FROM b""",
    "sentence_counts": f"SELECT ord, coalesce(len(p), 0)::INT AS parts, md5(array_to_string(p, '|')) AS digest FROM (SELECT ord, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM case_chunks)",
    "text_routes": "SELECT CASE WHEN length(t) <= 3800 THEN 'short' WHEN length(t) <= 14000 THEN 'medium' ELSE 'long' END AS route, count(*) AS texts FROM (SELECT coalesce(full_text, '') AS t FROM merge_case_rows UNION ALL SELECT coalesce(text, '') FROM documents) GROUP BY 1",
    "paragraphs_kept": r"""SELECT ord, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chunk_text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM case_chunks""",
}

_PARAS = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_FIXED = r"list_filter(list_transform(range(0, length(x[1]), 1200), lambda i: regexp_replace(substr(x[1], i + 1, 1200), '^\s+|\s+$', '', 'g')), lambda y: y <> '')"
_OPEN = "acc[len(acc)]"
# the chunks are folded in a list whose last element is the open one
ORACLE_SQL["packed_chunks"] = f"""WITH p AS (SELECT ord, authoritative_case_number AS cn, authoritative_decision_date AS dd, language, {_PARAS} AS ps FROM merge_case_rows WHERE full_text IS NOT NULL),
 f AS (SELECT *, list_reduce([['']] || list_transform(ps, lambda y: [y]), lambda acc, x: CASE WHEN length(x[1]) > 1600 THEN CASE WHEN {_OPEN} = '' THEN acc[1:len(acc) - 1] ELSE acc END || {_FIXED} || ['']
   WHEN length(CASE WHEN {_OPEN} = '' THEN x[1] ELSE {_OPEN} || chr(10) || chr(10) || x[1] END) <= 1200 THEN acc[1:len(acc) - 1] || [CASE WHEN {_OPEN} = '' THEN x[1] ELSE {_OPEN} || chr(10) || chr(10) || x[1] END]
   ELSE CASE WHEN {_OPEN} = '' THEN acc[1:len(acc) - 1] ELSE acc END || [x[1]] END) AS cs FROM p),
 c AS (SELECT *, list_filter(cs, lambda y: y <> '') AS ok FROM f), e AS (SELECT ord, cn, dd, language, unnest(ok) AS chunk_text, unnest(range(0, len(ok)))::INT AS chunk_index FROM c)
SELECT ord, chunk_index, replace(coalesce(cn, ''), '/', '_') || '_' || coalesce(language, '') || '_' || printf('c%04d', chunk_index) || '_' || substr(sha1(coalesce(cn, '') || '|' || coalesce(dd, '') || '|' || coalesce(language, '') || '|' || chunk_index || '|' || chunk_text), 1, 12) AS chunk_id, chunk_text FROM e"""
