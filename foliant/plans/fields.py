"""Queries of field extraction, normal forms and field evaluation, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import extract, lexicon, queries, text
from foliant.operators import evaluation, lookup
from foliant.sources.tables import table

from . import sql

LIST_GLUE = " | "


def _list(c):
    return F.array_join(c, LIST_GLUE)


def chunk_fields(spark: SparkSession, d: str) -> DataFrame:
    """Summary, holding, legal basis and disputed issues of every chunk, by the improved rules."""
    c = F.col
    return table(spark, d, "case_chunks").select(
        "ord", extract.case_summary(c("language"), c("chunk_text"), c("case_type")).alias("case_summary"), extract.holding(c("language"), c("chunk_text")).alias("holding"),
        _list(extract.legal_basis(c("language"), c("chunk_text"))).alias("legal_basis"), _list(extract.disputed_issues(c("language"), c("chunk_text"), c("case_type"))).alias("disputed_issues"),
    )


def plain_fields(spark: SparkSession, d: str) -> DataFrame:
    """Summary and holding of every merged text by the first and the draft rule set."""
    c = F.col
    return table(spark, d, "merge_case_rows").select(
        "ord", extract.plain_summary(c("language"), c("full_text")).alias("case_summary"), extract.plain_holding(c("language"), c("full_text")).alias("holding"),
        extract.draft_holding(c("full_text")).alias("draft_holding"),
    )


def _v1(t, kind) -> dict:
    return {
        "case_summary": extract.v1_summary(t), "holding": extract.v1_holding(t), "disputed_issues": extract.v1_issues(t, kind), "legal_basis": extract.v1_legal_basis(t),
        "reasoning_summary": extract.v1_reasoning(t), "doctrinal_point": extract.v1_point(t),
    }


def v1_fields(spark: SparkSession, d: str) -> DataFrame:
    """The six fields of schema version 1 of every merged text."""
    x = table(spark, d, "merge_case_rows").select("ord", "case_type", text.squeeze(F.coalesce("full_text", F.lit(""))).alias("t"))
    return x.select("ord", *[(_list(v) if n in ("disputed_issues", "legal_basis") else v).alias(n) for n, v in _v1(F.col("t"), F.col("case_type")).items()])


def v1_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per field of schema version 1: filled rows and where their values came from: a model, a fallback, or nowhere.

    A case takes a source's row by its sentence id, else by its case number.
    """
    cases = table(spark, d, "merge_case_rows").where(F.trim("sentence_id") != "").select("ord", F.trim("sentence_id").alias("sid"), F.trim("authoritative_case_number").alias("cn"), "case_type", text.squeeze(F.coalesce("full_text", F.lit(""))).alias("t"))
    meta = table(spark, d, "case_metadata")
    fields = ["case_summary", "holding", "disputed_issues", "legal_basis"]
    x = cases
    for name, source in (("m", "model_generated"), ("b", "deterministic_baseline")):
        rows = meta.where(F.col("metadata_source") == source)
        pick = F.max_by(F.struct(*fields), "ord").alias(name)
        by_id = rows.where(F.trim("sentence_id") != "").groupBy(F.trim("sentence_id").alias("sid")).agg(pick)
        by_number = rows.where(F.trim("authoritative_case_number") != "").groupBy(F.trim("authoritative_case_number").alias("cn")).agg(pick.alias(f"{name}2"))
        x = x.join(by_id, "sid", "left").join(by_number, "cn", "left").withColumn(name, F.coalesce(name, f"{name}2")).drop(f"{name}2")
    rules = _v1(F.col("t"), F.col("case_type"))
    cells = []
    for f in fields:
        if f in ("disputed_issues", "legal_basis"):
            own = [F.array_join(text.distinct_ignoring_case(F.coalesce(F.col(f"{s}.{f}"), F.array().cast("array<string>")), 12), LIST_GLUE) for s in ("m", "b")] + [_list(rules[f])]
        else:
            own = [text.squeeze(F.col(f"{s}.{f}")) for s in ("m", "b")] + [rules[f]]
        _, source = lookup.first_value(("model_generated", own[0]), ("deterministic_fallback", own[1]), ("deterministic_fallback", own[2]))
        cells.append(F.struct(F.lit(f).alias("field_name"), source.alias("source")))
    return x.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.field_name", "c.source").agg(F.count("*").alias("rows"))


def holding_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Best holding sentence of every chunk with its score; without one the last two sentences and a null score."""
    return extract.best_holdings(table(spark, d, "case_chunks").where("chunk_text IS NOT NULL"), ["ord"], "language", "chunk_text")


def legal_basis_counts(spark: SparkSession, d: str) -> DataFrame:
    """Articles the merged texts rest on, in the form of their language: rows per article."""
    x = table(spark, d, "merge_case_rows").select("ord", F.explode(extract.legal_basis(F.col("language"), F.col("full_text"), 100_000)).alias("basis"))
    return x.groupBy("basis").agg(F.count("*").alias("rows"))


def detail_fields(spark: SparkSession, d: str) -> DataFrame:
    """Case number, date and title read from the first lines of every document."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", extract.detail_case_number(t).alias("case_number"), extract.detail_date(t).alias("decision_date"), extract.detail_title(t).alias("title"))


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length route of every merged text at the production limits and a digest of what its prompt holds."""
    t = F.col("full_text")
    route = text.length_route(F.coalesce(t, F.lit("")))
    shown = F.when(route == "short", text.squeeze(F.coalesce(t, F.lit("")))).when(route == "medium", extract.medium_text(t)).otherwise(extract.long_snippets(t))
    return table(spark, d, "merge_case_rows").select("ord", route.alias("route"), F.length(shown).alias("length"), F.md5(shown).alias("digest"))


def query_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every card title as a Chinese query in its normal form, with the rules applied and the expanded form."""
    x = table(spark, d, "research_result_items").select("ord", queries.zh_query(F.col("card_title")).alias("q"))
    return x.select("ord", "q.normalized", "q.expanded", F.array_join("q.rules", ",").alias("rules"))


def issue_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every holding decomposed as a query: main issue, sub-issues, terms."""
    x = table(spark, d, "research_result_items").where("holding IS NOT NULL").select("ord", queries.decomposed(F.col("holding")).alias("q"))
    return x.select("ord", "q.main_issue", _list(F.col("q.sub_issues")).alias("sub_issues"), _list(F.col("q.query_terms")).alias("query_terms"), F.size("q.subqueries").alias("subqueries"))


def traditional_forms(spark: SparkSession, d: str) -> DataFrame:
    """Summaries and holdings in traditional signs, with what changed and the script of the row."""
    s, h = (extract.to_traditional(F.col(c), lexicon.TRADITIONAL) for c in ("case_summary", "holding"))
    x = table(spark, d, "case_metadata").select("ord", s.alias("s"), h.alias("h"))
    script = F.when((F.col("s.script") == "traditional_chinese") | (F.col("h.script") == "traditional_chinese"), "traditional_chinese").otherwise("not_applicable")
    return x.select("ord", F.md5("s.text").alias("case_summary"), F.md5("h.text").alias("holding"), (F.col("s.changed") | F.col("h.changed")).alias("changed"), F.coalesce(script, F.lit("not_applicable")).alias("script"))


def field_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Returned items held against the last metadata of their case number: averages of every score, items missing, weakest field."""
    e = F.array().cast("array<string>")
    fields = ["case_summary", "holding", "legal_basis", "disputed_issues"]
    key = text.case_key(F.col("authoritative_case_number")).alias("case_id")
    known = table(spark, d, "case_metadata").select(key, "ord", F.struct(*fields).alias("r")).where("case_id <> ''").groupBy("case_id").agg(F.max_by("r", "ord").alias("m"))
    x = table(spark, d, "research_result_items").select(key, *fields).join(known, "case_id", "left")
    tokens = lambda c: extract.evaluation_tokens(F.coalesce(F.col(c), F.lit("")))
    items = lambda c: F.coalesce(F.col(c), e)
    scored = x.select(
        F.col("m").isNotNull().alias("found"), evaluation.set_overlap(tokens("m.case_summary"), tokens("case_summary")).alias("s"), evaluation.containment(extract.evaluation_text(F.col("m.case_summary")), extract.evaluation_text(F.col("case_summary"))).alias("sc"),
        evaluation.set_overlap(tokens("m.holding"), tokens("holding")).alias("h"), evaluation.exact_list(items("m.legal_basis"), items("legal_basis")).alias("le"),
        evaluation.normal_overlap(items("m.legal_basis"), items("legal_basis")).alias("ln"), evaluation.normal_overlap(items("m.disputed_issues"), items("disputed_issues")).alias("dn"),
    )
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(F.col("found"), F.col(c))), 6), F.lit(0.0))
    a = scored.agg(
        F.count("*").alias("rows"), F.count_if("found").alias("evaluated"), mean("s").alias("case_summary"), mean("sc").alias("case_summary_containment"), mean("h").alias("holding"),
        mean("le").alias("legal_basis_exact"), mean("ln").alias("legal_basis"), mean("dn").alias("disputed_issues"),
    )
    return a.withColumn("weakest", evaluation.weakest({f: F.col(f) for f in fields}))


def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the metadata with a complete value, per field."""
    return evaluation.completeness(table(spark, d, "case_metadata"), ["case_summary", "holding"], ["legal_basis", "disputed_issues"])


def issue_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose disputed issues share most tokens with the first issue of the stated rows, read as a query; token sets meet once, whatever the number of rows that have them."""
    from foliant.operators import search

    rows = table(spark, d, "research_result_items")
    tokens = F.array_sort(F.array_distinct(extract.usage_tokens(F.array_join("disputed_issues", " "))))
    sets = rows.select("ord", tokens.alias("s")).where("size(s) > 0")
    # the best k rows of a set are its first k; others of the set can only follow
    first = search.first_of_each(sets, "s", "ord", 5)
    asked = rows.where(F.col("ord") % 20 == 0).select(F.col("ord").alias("query_id"), F.array_distinct(extract.usage_tokens(F.try_element_at("disputed_issues", F.lit(1)))).alias("q")).where("size(q) > 0")
    terms = sets.select("s").distinct().select("s", F.explode("s").alias("t"))
    meet = asked.select("query_id", "q", F.explode("q").alias("t")).join(terms, "t").groupBy("query_id", "q", "s").agg(F.count("*").alias("n"))
    scores = meet.select("query_id", "s", F.round(F.col("n") / F.size("q"), 6).alias("score")).join(first, "s").select("query_id", "ord", "score")
    return search.top_k(scores, 5, "ord").select("query_id", "ord", "rank", "score")


def contains_all(spark: SparkSession, d: str) -> DataFrame:
    """The first three case numbers, in order, one of whose chunks holds all terms of each stated term list, per language."""
    terms = {"appeal": ("上訴", "理由"), "court": ("tribunal", "decisão"), "evidence": ("recurso", "sentença", "autos")}
    low = F.lower("chunk_text")
    hit = F.explode(F.array_compact(F.array(*[F.when(extract_all(low, t), n) for n, t in terms.items()])))
    x = table(spark, d, "case_chunks").where(F.trim("authoritative_case_number") != "").select(F.trim("authoritative_case_number").alias("case_id"), "language", hit.alias("term_list"))
    from foliant.operators import search

    each = x.where("language IS NOT NULL").distinct().withColumn("key", F.concat_ws("/", "term_list", "language"))
    return search.first_of_each(each, "key", "case_id", 3).select("term_list", "language", "case_id")


def extract_all(c, terms):
    """Whether a text holds every term."""
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(c, F.lit(t))
    return out


def search_records(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the ranking record and of the vector text of every chunk."""
    t = text.ranking_text(F.coalesce("chunk_text", F.lit("")))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("authoritative_case_number", "case_type", "court", "language")] + [F.nullif(t, F.lit("")), F.nullif(F.col("chunk_text"), F.lit(""))]
    return table(spark, d, "case_chunks").select("ord", F.md5(t).alias("bm25_text"), F.md5(F.concat_ws("\n", *parts)).alias("vector_text"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_fields, plain_fields, v1_fields, v1_sources, holding_sentences, legal_basis_counts, detail_fields, prompt_texts, query_forms, issue_parts, traditional_forms,
        field_evaluation, field_completeness, issue_matches, contains_all, search_records,
    )
}

# ---- the same in SQL

_q, _sq = sql.q, sql.squeeze


def _first(parts: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


def _clip(c: str, n: int) -> str:
    t = _sq(c)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {n - 3}) || '...' END"


def _sentences(c: str, end: str = extract.PLAIN_END, blanks: str = "[\\s\\p{Z}]+") -> str:
    marked = f"regexp_replace({c}, {_q(end + blanks)}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {_sq('x')}), lambda x: x <> '')"


def _summary_sentence(c: str, lang: str) -> str:
    s = _sq(c)
    for p in (r"（[^）]{0,80}參見[^）]*）", r"(?i)\([^\)]{0,80}cf\.[^\)]*\)", r"^[IVXLCM]+\s*[\-–—.]\s*", r"^\d+\s*[\-–—.)]\s*", r"^\*+\s*"):
        s = f"regexp_replace({s}, {_q(p)}, '', 'g')"
    s = _sq(s)
    return f"CASE WHEN {lang} = 'zh' THEN regexp_replace(replace({s}, '裁判摘要', ''), '^[ ：]+|[ ：]+$', '', 'g') ELSE regexp_replace({s}, '(?i)^(sum[áa]rio|resumo)\\s*', '') END"


def _heading_value(t: str, heads: tuple[str, ...]) -> str:
    return _clip(_first([f"trim(regexp_replace(regexp_extract({t}, {_q(f'(?i)(?:^|[ ])(?:{h})[ ]*[:：][ ]*(.+)')}, 1), '^[-•‧·]+', ''))" for h in heads]), 220)


def _terms(c: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({c}, '[、，,;；]+'), lambda x: {_sq('x')}), lambda x: x <> '')"
    return f"list_transform({parts}, lambda x: regexp_replace(x, '^[-:：.。 ]+|[-:：.。 ]+$', '', 'g'))"


def _block(t: str, heads: tuple[str, ...], stops: tuple[str, ...]) -> str:
    ends = ", ".join(f"nullif(length(regexp_extract({t}, {_q(f'(?is)^.*?(?:{h})[ ]*[:：]?')})), 0)" for h in heads)
    rest = f"substr({t}, list_min([{ends}]) + 1)"
    cut = ", ".join(f"CASE WHEN regexp_matches({rest}, {_q(f'(?i){s}')}) THEN length(regexp_extract({rest}, {_q(f'(?is)^(.*?)(?:{s})')}, 1)) END" for s in stops)
    return f"coalesce({_sq(f'substr({rest}, 1, coalesce(list_min([{cut}]), length({rest})))')}, '')"


def _score(s: str, lang: str) -> str:
    points = lambda k: " + ".join(f"{n} * contains(lower({s}), {_q(w)})::INT" for words, n in zip(extract.HOLDING[k], (4, 1), strict=True) for w in words)
    return f"(CASE WHEN {lang} = 'zh' THEN {points('zh')} ELSE {points('pt')} END - CASE WHEN length({s}) > 260 OR length({s}) < 8 THEN 2 ELSE 0 END)"


_LANG = "coalesce(language, '')"
_HOLD = f"""
s AS (SELECT *, {_sentences('t')} AS ss FROM base),
 r AS (SELECT *, CASE WHEN len(ss) > 4 THEN len(ss) // 2 ELSE 0 END AS skip FROM s),
 e AS (SELECT ord, unnest(ss) AS x, unnest(range(0, len(ss))) AS i, skip, {_LANG} AS lang FROM r),
 v AS (SELECT *, {_score('x', 'lang')} AS score FROM e WHERE i >= skip),
 b AS (SELECT ord, score, x FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, length(x), i DESC) AS rn FROM v WHERE score > 0) WHERE rn = 1),
 h AS (SELECT r.ord, b.score::INT AS score, {_clip(_summary_sentence("coalesce(b.x, array_to_string(r.ss[greatest(len(r.ss) - 1, 1):], ' '))", _LANG), 220)} AS sentence FROM r LEFT JOIN b USING (ord) WHERE len(ss) > 0)"""


def _distinct(c: str, n: int) -> str:
    clean = f"list_filter(list_transform({c}, lambda x: trim(x)), lambda x: x <> '')"
    return f"list_filter({clean}, lambda x, i: list_position(list_transform({clean}, lambda y: lower(y)), lower(x)) = i)[1:{n}]"


def _basis(t: str) -> str:
    zh = f"list_transform(regexp_extract_all({t}, {_q(extract.ZH_ARTICLE[1:-1])}), lambda x: regexp_replace(x, '\\s+', '', 'g'))"
    pt = f"list_transform(regexp_extract_all({t}, {_q('(?i)' + extract.PT_ARTICLE[6:-1])}), lambda x: lower({_sq('x')}))"
    return f"CASE WHEN {_LANG} = 'zh' THEN {zh} ELSE {pt} END"


def _issues(t: str) -> str:
    other = "CASE WHEN coalesce(case_type, '') <> '' THEN [case_type] ELSE [] END"

    def branch(k: str) -> str:
        lists = [_terms(f"regexp_extract({t}, {_q('(?i)' + p)}, 1)") for p in extract.ISSUE_PATTERNS[k]]
        return "coalesce(" + ", ".join(f"CASE WHEN len({x}) > 0 THEN {x}[1:8] END" for x in lists) + f", {other})"

    return f"CASE WHEN {_LANG} = 'zh' THEN {branch('zh')} ELSE {branch('pt')} END"


def _summary(t: str) -> str:
    def branch(k: str, head: str, glue: str, tail: str, limit: int, budget: int) -> str:
        terms = _terms(_heading_value(t, extract.ISSUE_LINES[k]))
        listed = f"CASE WHEN len({terms}) > 0 THEN {_clip(f'({_q(head)} || array_to_string({terms}, {_q(glue)}) || {_q(tail)})', limit)} ELSE '' END"
        block = f"list_filter(list_transform({_sentences(_block(t, extract.SUMMARY_HEADS[k], extract.SUMMARY_STOPS[k]))}, lambda y: {_summary_sentence('y', _LANG)}), lambda y: y <> '')"
        return _first([listed, _clip(f"array_to_string({block}[1:{budget}], ' ')", 280)])

    plain = f"list_filter(list_transform({_sentences(t)}, lambda y: {_summary_sentence('y', _LANG)}), lambda y: y <> '')"
    fallback = _clip(f"array_to_string({plain}[1:CASE WHEN {_LANG} = 'pt' THEN 1 ELSE 2 END], ' ')", 220)
    ruled = f"CASE WHEN {_LANG} = 'zh' THEN {branch('zh', '本案聚焦', '、', '。', 220, 2)} ELSE {branch('pt', 'O caso discute ', '; ', '.', 240, 1)} END"
    return f"CASE WHEN {t} = '' THEN '' ELSE {_first([ruled, fallback, _clip('coalesce(case_type, chr(32))', 120)])} END"


def _first_block(t: str, heads: tuple[str, ...], stops: tuple[str, ...]) -> str:
    return _sq(f"regexp_extract({t}, {_q('(?is)(?:' + '|'.join(heads) + r')\s*[:：]?\s*(.+?)(?:(?:' + '|'.join(stops) + ')|$)')}, 1)")


def _has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"



def _base(column: str, relation: str) -> str:
    """CTE ``base``: the rows with a column squeezed, as t."""
    return "base AS (SELECT *, " + _sq(f"coalesce({column}, '')") + f" AS t FROM {relation})"


_V1S = _sentences("t", extract.V1_END)


def _v1_sql() -> dict[str, str]:
    hits = f"list_filter({_V1S}, lambda y: {_has('lower(y)', extract.V1_HOLDING)})"
    reasons = f"list_filter({_V1S}, lambda y: {_has('y', extract.REASONS)})"
    points = f"list_filter({_V1S}, lambda y: {_has('y', extract.POINTS)})"
    last = lambda a, n: f"array_to_string({a}[greatest(len({a}) - {n - 1}, 1):], ' ')"
    parts = " || ".join(f"regexp_split_to_array(regexp_extract(t, {_q('(?i)' + p)}, 1), '[、，,;；]+')" for p in extract.V1_ISSUES)
    zh = f"list_transform(regexp_extract_all(t, {_q(extract.ZH_ARTICLE[1:-1])}), lambda x: regexp_replace(x, '\\s+', '', 'g'))"
    pt = f"list_transform(regexp_extract_all(t, {_q('(?i)' + extract.PT_ARTICLE[6:-1])}), lambda x: {_sq('x')})"
    return {
        "case_summary": _first([_clip(_first_block("t", *extract.V1_SUMMARY), 320), _clip(f"array_to_string({_V1S}[1:2], ' ')", 320)]),
        "holding": _clip(f"CASE WHEN len({hits}) > 0 THEN {last(hits, 3)} ELSE {last(_V1S, 2)} END", 260),
        "disputed_issues": f"array_to_string({_distinct(f'list_transform({parts} || [coalesce(case_type, chr(32))], lambda z: ' + _sq('z') + ')', 8)}, ' | ')",
        "legal_basis": f"array_to_string({_distinct(f'{zh} || {pt}', 12)}, ' | ')",
        "reasoning_summary": _first([_clip(_first_block("t", *extract.V1_REASONING), 360), _clip(f"CASE WHEN len({reasons}) > 0 THEN array_to_string({reasons}[1:3], ' ') ELSE array_to_string({_V1S}[1:3], ' ') END", 360)]),
        "doctrinal_point": _first([*[_clip(f"regexp_extract(t, {_q('(?i)' + p)}, 1)", 220) for p in extract.V1_POINTS], _clip(f"coalesce({points}[1], '')", 220)]),
    }


def _tokens_of(c: str) -> str:
    t = _sq(f"regexp_replace({_sq(f'lower(coalesce({c}, chr(32)))')}, '[*\\-_,.;:!?''\"()\\[\\]{{}}]+', ' ', 'g')")
    return f"list_distinct(regexp_extract_all({t}, '[a-z0-9{text.HAN}]+'))"


def _norm(c: str) -> str:
    return _sq(f"regexp_replace({_sq(f'lower({c})')}, '[*\\-_,.;:!?''\"()\\[\\]{{}}]+', ' ', 'g')")


def _overlap(e: str, p: str) -> str:
    return f"CASE WHEN len({e}) = 0 AND len({p}) = 0 THEN 1.0 WHEN len({e}) = 0 THEN 0.0 ELSE len(list_intersect({e}, {p})) / len({e}) END"


def _traditional(c: str) -> str:
    out = c
    for k, v in sorted(lexicon.TRADITIONAL.items(), key=lambda kv: -len(kv[0])):
        out = f"replace({out}, {_q(k)}, {_q(v)})"
    return f"CASE WHEN regexp_matches({c}, '[㐀-鿿]') THEN {out} ELSE {c} END"


def _evaluation_sql() -> str:
    lists = lambda c: f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda z: {_norm('z')}), lambda z: z <> ''))"
    k = sql.case_key("authoritative_case_number")
    return f"""
WITH m AS (SELECT k, case_summary AS s, holding AS h, legal_basis AS l, disputed_issues AS i FROM (SELECT *, {k} AS k, row_number() OVER (PARTITION BY {k} ORDER BY ord DESC) AS rn FROM case_metadata WHERE {k} <> '') WHERE rn = 1),
 x AS (SELECT r.*, m.*, m.k IS NOT NULL AS found FROM (SELECT *, {k} AS rk FROM research_result_items) r LEFT JOIN m ON m.k = r.rk),
 y AS (SELECT found, {_tokens_of('s')} AS s1, {_tokens_of('case_summary')} AS s2, {_norm("coalesce(s, '')")} AS c1, {_norm("coalesce(case_summary, '')")} AS c2, {_tokens_of('h')} AS h1, {_tokens_of('holding')} AS h2,
   coalesce(l, []) = coalesce(legal_basis, []) AS le, {lists('l')} AS l1, {lists('legal_basis')} AS l2, {lists('i')} AS i1, {lists('disputed_issues')} AS i2 FROM x),
 z AS (SELECT count(*) AS rows, count(*) FILTER (found) AS evaluated, coalesce(round(avg({_overlap('s1', 's2')}) FILTER (found), 6), 0.0) AS case_summary,
   coalesce(round(avg(CASE WHEN c1 = '' AND c2 = '' THEN 1.0 WHEN c1 = '' OR c2 = '' THEN 0.0 WHEN contains(c2, c1) OR contains(c1, c2) THEN 1.0 ELSE 0.0 END) FILTER (found), 6), 0.0) AS case_summary_containment,
   coalesce(round(avg({_overlap('h1', 'h2')}) FILTER (found), 6), 0.0) AS holding, coalesce(round(avg(le::INT) FILTER (found), 6), 0.0) AS legal_basis_exact,
   coalesce(round(avg({_overlap('l1', 'l2')}) FILTER (found), 6), 0.0) AS legal_basis, coalesce(round(avg({_overlap('i1', 'i2')}) FILTER (found), 6), 0.0) AS disputed_issues FROM y)
SELECT *, CASE least(case_summary, holding, legal_basis, disputed_issues) WHEN case_summary THEN 'case_summary' WHEN holding THEN 'holding' WHEN legal_basis THEN 'legal_basis' ELSE 'disputed_issues' END AS weakest FROM z"""


def forms_sql(relation: str, key: str, column: str) -> str:
    """CTEs ending in ``forms``: (key, normalized, expanded, rules) of a column of queries."""
    p = f"translate(n, {_q(''.join(queries.PUNCTUATION))}, {_q(''.join(queries.PUNCTUATION.values()))})"
    variants = "b"
    for k, v in sorted(lexicon.VARIANTS.items(), key=lambda kv: -len(kv[0])):
        variants = f"replace({variants}, {_q(k)}, {_q(v)})"
    terms = " || ".join(f"CASE WHEN contains(v, {_q(k)}) THEN {sql.listed([t.lower() for t in ts])} ELSE [] END" for k, ts in lexicon.EXPANSIONS.items())
    return f"""
a AS (SELECT {key}, coalesce({column}, '') AS q, {sql.nfkc(f"coalesce({column}, '')")} AS n FROM {relation}),
 p AS (SELECT *, {p} AS p FROM a), l AS (SELECT *, lower({_sq("replace(p, '第 ', '第')")}) AS low FROM p),
 w AS (SELECT *, replace(regexp_replace(replace(replace(regexp_replace(low, {_q(queries.WRITTEN_CASE)}, chr(1) || '\\1/\\2/\\3' || chr(2), 'g'), '/' || chr(2), ''), chr(2), ''), chr(1) || '0*([0-9])', '\\1', 'g'), chr(1), '') AS w FROM l),
 b AS (SELECT *, {_sq("regexp_replace(w, '\\s*/\\s*', '/', 'g')")} AS b FROM w), v AS (SELECT *, {variants} AS v FROM b),
 t AS (SELECT *, list_filter({terms}, lambda x: NOT contains(v, x)) AS t0 FROM v), u AS (SELECT *, list_filter(t0, lambda x, i: list_position(t0, x) = i) AS t FROM t), forms AS (SELECT {key}, v AS normalized, trim(v || CASE WHEN len(t) > 0 THEN ' ' || array_to_string(t, ' ') ELSE '' END) AS expanded, array_to_string(list_filter([CASE WHEN n <> q THEN 'unicode_nfkc' END, CASE WHEN p <> n THEN 'punctuation_width_normalization' END,
 CASE WHEN w <> low THEN 'case_number_format_normalization' END, CASE WHEN {_has('b', lexicon.VARIANTS)} THEN 'legal_variant_mapping' END, CASE WHEN len(t) > 0 THEN 'high_value_legal_query_expansion' END], lambda x: x IS NOT NULL), ',') AS rules FROM u)"""


def issue_parts_sql(relation: str, key: str, column: str) -> str:
    """(key, q, raw, cases, legal, steps, facts, main, subs, terms, subqueries) of every row of a relation."""
    ends = lambda c: f"regexp_replace({c}, {_q(f'^{text.BLANK}+|{text.BLANK}+$')}, '', 'g')"
    order = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
    canon = lambda table: "list_filter([" + ", ".join(f"CASE WHEN contains(q, {_q(k)}) THEN {_q(v)} END" for k, v in table.items()) + "], lambda x: x IS NOT NULL)"
    facts = f"list_filter({sql.listed(lexicon.ISSUE_FACTS)}, lambda x: contains(q, x))"
    known = sql.listed([*lexicon.ISSUE_CONCEPTS, *lexicon.ISSUE_STEPS])
    segments = (
        f"list_filter(list_transform(regexp_split_to_array(q, '[，,、;；]+|\\s+'), lambda x: {ends('x')}), lambda x: NOT list_contains({known}, x) AND NOT regexp_full_match(x, '[0-9]{{1,5}}/[0-9]{{4}}') "
        f"AND length(x) BETWEEN 2 AND 12 AND NOT regexp_matches(x, '[()\\[\\]{{}}]') AND {_has('x', lexicon.ISSUE_FACTS)})"
    )
    doubled = "regexp_replace(q, '([^\\p{L}\\p{N}_/])', '\\1\\1', 'g')"
    cases = f"regexp_extract_all({doubled}, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,5}}/[0-9]{{4}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"
    return f"""
i0 AS (SELECT {key}, {ends(f"coalesce({column}, '')")} AS raw, {_sq(f"translate(coalesce({column}, ''), '（）', '()')")} AS q0 FROM {relation}),
 i1 AS (SELECT *, trim(regexp_replace(q0, '[，,、;；]+', ' ', 'g')) AS q FROM i0),
 i2 AS (SELECT *, {cases} AS c0, {canon(lexicon.ISSUE_CONCEPTS)} AS l0, {canon(lexicon.ISSUE_STEPS)} AS s0, {facts} || {segments} AS f0 FROM i1),
 i3 AS (SELECT *, {order('c0')} AS cases, {order('l0')} AS legal, {order('s0')} AS steps, {order('f0')} AS facts FROM i2),
 i4 AS (SELECT *, coalesce(legal[1], steps[1], CASE WHEN length(q) <= 24 THEN {_q(queries.CASE_LABEL)} || cases[1] END, facts[1], q) AS main, legal || steps || list_transform(cases, lambda n: {_q(queries.CASE_LABEL)} || n) || facts AS u0, legal || steps AS k0, cases || legal || steps || facts AS t0 FROM i3),
 i5 AS (SELECT *, list_filter({order('u0')}, lambda x: x <> main)[1:{queries.SUB_ISSUES}] AS subs, {order('t0')}[1:{queries.QUERY_TERMS}] AS terms, {order('k0')} AS ks FROM i4),
 i6 AS (SELECT *, list_filter(list_transform([raw, CASE WHEN q <> raw THEN q END, main, CASE WHEN len(ks) > 0 THEN array_to_string(ks[1:4], ' ') END,
   CASE WHEN len(cases) > 0 AND len(ks) > 0 THEN cases[1] || ' ' || array_to_string(ks[1:2], ' ') WHEN len(cases) > 0 THEN {_q(queries.CASE_LABEL)} || cases[1] END, CASE WHEN len(legal) > 0 AND len(facts) > 0 THEN legal[1] || ' ' || facts[1] END] || subs[1:3], lambda x: {ends('x')}), lambda x: x <> '') AS p0 FROM i5),
 i7 AS (SELECT *, {order('p0')}[1:{queries.SUBQUERIES}] AS parts FROM i6)"""


def _usage(c: str) -> str:
    low = f"lower({_sq(c)})"
    return f"regexp_extract_all({low}, '[{text.HAN}]{{2,}}') || regexp_extract_all({low}, '[a-z0-9_./-]+')"


ORACLE_SQL = {
    "chunk_fields": f"WITH {_base('chunk_text', 'case_chunks')}, {_HOLD} SELECT base.ord, {_summary('t')} AS case_summary, coalesce(h.sentence, '') AS holding, array_to_string({_distinct(_basis('t'), 8)}, ' | ') AS legal_basis, array_to_string({_issues('t')}, ' | ') AS disputed_issues FROM base LEFT JOIN h USING (ord)",
    "holding_sentences": f"WITH {_base('chunk_text', 'case_chunks')}, {_HOLD} SELECT ord, score, sentence FROM h",
    "legal_basis_counts": f"WITH {_base('full_text', 'merge_case_rows')} SELECT basis, count(*) AS rows FROM (SELECT ord, unnest({_distinct(_basis('t'), 100000)}) AS basis FROM base) GROUP BY 1",
    "v1_fields": f"WITH {_base('full_text', 'merge_case_rows')} SELECT ord, " + ", ".join(f"{v} AS {n}" for n, v in _v1_sql().items()) + " FROM base",
    "traditional_forms": f"""SELECT ord, md5({_traditional('case_summary')}) AS case_summary, md5({_traditional('holding')}) AS holding, coalesce({_traditional('case_summary')} <> case_summary, false) OR coalesce({_traditional('holding')} <> holding, false) AS changed,
 CASE WHEN coalesce(regexp_matches(case_summary, '[㐀-鿿]'), false) OR coalesce(regexp_matches(holding, '[㐀-鿿]'), false) THEN 'traditional_chinese' ELSE 'not_applicable' END AS script FROM case_metadata""",
    "field_evaluation": _evaluation_sql(),
    "field_completeness": " UNION ALL ".join(
        [f"SELECT '{c}' AS field_name, count(*) FILTER (coalesce(trim({c}) <> '', false)) AS complete FROM case_metadata" for c in ("case_summary", "holding")]
        + [f"SELECT '{c}', count(*) FILTER (coalesce(len(list_filter({c}, lambda x: trim(x) <> '')) > 0, false)) FROM case_metadata" for c in ("legal_basis", "disputed_issues")]
    ),
    "query_forms": f"WITH {forms_sql('research_result_items', 'ord', 'card_title')} SELECT ord, normalized, expanded, rules FROM forms",
    "issue_parts": f"WITH {issue_parts_sql('(SELECT * FROM research_result_items WHERE holding IS NOT NULL)', 'ord', 'holding')} SELECT ord, main AS main_issue, array_to_string(subs, ' | ') AS sub_issues, array_to_string(terms, ' | ') AS query_terms, len(parts)::INT AS subqueries FROM i7",
    "issue_matches": f"""WITH s AS (SELECT ord, list_distinct({_usage("array_to_string(disputed_issues, ' ')")}) AS s FROM research_result_items), q AS (SELECT ord AS query_id, list_distinct({_usage("coalesce(disputed_issues[1], '')")}) AS q FROM research_result_items WHERE ord % 20 = 0),
 x AS (SELECT query_id, ord, round(len(list_intersect(q, s)) / len(q), 6) AS score FROM q, s WHERE len(q) > 0 AND len(s) > 0 AND len(list_intersect(q, s)) > 0)
 SELECT query_id, ord, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM x) WHERE rank <= 5""",
    "contains_all": """WITH t AS (SELECT * FROM (VALUES ('appeal', ['上訴', '理由']), ('court', ['tribunal', 'decisão']), ('evidence', ['recurso', 'sentença', 'autos'])) v(term_list, terms)),
 x AS (SELECT DISTINCT term_list, language, trim(authoritative_case_number) AS case_id FROM t, case_chunks WHERE trim(authoritative_case_number) <> '' AND language IS NOT NULL AND len(list_filter(terms, lambda w: contains(lower(chunk_text), w))) = len(terms))
 SELECT term_list, language, case_id FROM (SELECT *, row_number() OVER (PARTITION BY term_list, language ORDER BY case_id) AS rn FROM x) WHERE rn <= 3""",
    "search_records": f"""SELECT ord, md5({sql.ranking_text("coalesce(chunk_text, '')")}) AS bm25_text,
 md5(concat_ws(chr(10), nullif(authoritative_case_number, ''), nullif(case_type, ''), nullif(court, ''), nullif(language, ''), nullif({sql.ranking_text("coalesce(chunk_text, '')")}, ''), nullif(chunk_text, ''))) AS vector_text FROM case_chunks""",
}
