import json
import os
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import research
from foliant.sources import artifacts, corpus, pages, statutes

HTML = """<html><head><script>var x = 1;</script></head><body><div class="b a"><div class="card">01/02/2020 12/2020 主題 摘要 <a href="/s.pdf">PDF</a></div>
<div class="card">02/02/2020 13/2020 主題 摘要 <a href="/t.pdf">PDF</a></div><div class="card">03/02/2020 14/2020 主題 摘要 <a href="/u.pdf">PDF</a><br></div></div>
<form id="f1"><input name="q"></form><form id="f2">search court<input name="my_token" value="t1"><input name="_token" value="t2"><select></select></form></body></html>"""


def test_pages_as_elements(spark):
    df = spark.createDataFrame([("u1", HTML), ("u2", None), ("u3", ""), ("u4", "<p>only text")], "url string, html string")
    e = pages.elements(df).cache()
    assert {r.page for r in e.select("page").distinct().collect()} == {"u1", "u4"}
    outer = e.where("classes = 'a b'").first()
    assert outer.links == 3 and outer.hrefs == ["/s.pdf", "/t.pdf", "/u.pdf"] and "var x" not in outer.text
    cards = pages.repeated_cards(e).collect()
    assert len(cards) == 3 and {c.classes for c in cards} == {"card"} and all(c.score == 5 for c in cards)
    assert pages.repeated_blocks(e).count() == 0  # shorter than forty characters
    s = {r.page: r for r in pages.structure(e).collect()}
    assert (s["u1"].structure, s["u1"].card, s["u4"].structure) == ("card", 3, "unknown")
    st = {r.signature: r for r in pages.signature_stats(e).collect()}
    assert (st["div.card"].n, st["div.card"].dates, st["div.card"].cases, st["div.card"].linked) == (3, 3, 3, 3)
    assert [(r.page, r.token) for r in pages.token(e).collect()] == [("u1", "t2")]
    best = pages.best_form(e).first()
    assert best.score == 3 + 10  # two inputs, a select, two hints
    assert pages.elements(df.limit(0)).count() == 0


def test_links_scores_and_windows(spark):
    df = spark.createDataFrame([(["/x", "/a.pdf", "/detail/1"],), ([],)], "l array<string>")
    got = [tuple(r.x) for r in df.select(pages.links_of(F.col("l"), ("pdf",), ("detail",)).alias("x")).collect()]
    assert got == [("/x", "/a.pdf"), (None, None)]
    day = spark.createDataFrame([("2026-03-31",)], "d string").select(F.to_date("d").alias("d"))
    assert tuple(day.select(pages.date_window(F.col("d"), "yyyy/MM/dd").alias("w")).first().w) == ("2026/03/01", "2026/03/31")
    v = spark.createDataFrame([("a", 3, 1, True, 0, False, 200, 50), ("b", 3, 1, True, 0, False, 200, 90), ("c", 9, 0, False, 9, True, 500, 10)], "name string, m int, c int, appears boolean, fm int, is_form boolean, status int, length int")
    c = F.col
    scored = v.withColumn("score", pages.variant_score(c("m"), c("c"), c("appears"), c("fm"), c("is_form"), c("status")))
    assert [r.score for r in scored.orderBy("name").collect()] == [14, 14, 0] and pages.best_variant(scored).first().name == "b"
    assert pages.best_variant(scored.limit(0)).count() == 0
    r = spark.createDataFrame([(1, "GET", "/search", None), (2, "POST", "/x", ""), (3, "POST", "/y", "a=1")], "ord int, method string, url string, body string")
    assert pages.first_submission(r, ("search",)).first().ord == 3 and pages.first_submission(r.where("ord < 3"), ("search",)).first().ord == 1
    t = spark.createDataFrame([("<FORM> a b c 1/2020",), (None,)], "t string")
    assert [tuple(x.f) for x in t.select(pages.search_form(F.col("t"), ("a", "b", "c")).alias("f")).collect()] == [(True, 3), (False, 0)]
    assert [x.f.appears for x in t.select(pages.candidate_markers(F.col("t"), ("a", "b", "c")).alias("f")).collect()] == [True, False]


def test_artifacts(spark, tmp_path):
    def put(name, rows, at):
        p = tmp_path / name
        p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        os.utime(p, (at, at))
        return str(p)

    now = int(time.time())
    row = lambda n: {"core_case_metadata": {"authoritative_case_number": n}, "generated_digest_metadata": {"holding": "h"}}
    a = put("model_output__a.jsonl", [row("1/2020"), row("1/2020"), {"case_number": "2/2020", "holding": "x"}], now - 100)
    b = put("model_generated_metadata_output.jsonl", [row("3/2020"), "{broken"], now)
    c = put("other.jsonl", [{"case_number": "4/2020", "foo": 1}], now)
    d = put("model_output__d.jsonl", [row("5/2020")], now - 100)
    e = put("empty.jsonl", [], now)
    (tmp_path / "model_output__d_report.txt").write_text("ok")
    found = artifacts.inspected(spark, [a, b, c, d, e, str(tmp_path / "missing.jsonl")])
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert len(got) == 5 and got["model_output__a.jsonl"].case_count == 2 and got["model_output__a.jsonl"].priority == 2
    assert not got["model_generated_metadata_output.jsonl"].parseable and not got["other.jsonl"].schema_compatible and got["empty.jsonl"].parseable
    assert artifacts.latest_valid(found).first().path.endswith("model_output__d.jsonl")  # same time and priority: the one with a report
    assert artifacts.latest_valid(found.where("path LIKE '%other%'")).count() == 0
    assert artifacts.discover([a, a], str(tmp_path / "model_output__*.jsonl")) == [a, d]


def test_regression_pack(spark, tmp_path):
    rule = {"rule_type": "case_number_at_rank", "rank": 1, "case_number": "1/2020"}
    q = {"query_id": "Q1", "query_text": "t", "route_hint": "r", "expected_behavior": "e", "pass_rule": rule}
    (tmp_path / "p.json").write_text(json.dumps([q, q | {"query_id": "Q2"}]))
    got = artifacts.regression_pack(spark, str(tmp_path / "p.json")).collect()
    assert [r.query_id for r in got] == ["Q1", "Q2"] and got[0].pass_rule.rank == 1
    (tmp_path / "bad.json").write_text(json.dumps([q, {"query_id": "Q2"}]))
    with pytest.raises(Exception, match="entry 2 lacks"):
        artifacts.regression_pack(spark, str(tmp_path / "bad.json")).collect()


def test_vector_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, 0.5])], "id bigint, vector array<double>")
    artifacts.save_index(v, str(tmp_path / "i"), {"dim": "2", "model": "hash"})
    rows, header = artifacts.load_index(spark, str(tmp_path / "i"))
    assert rows.first().vector == [0.5, 0.5] and header == {"dim": "2", "model": "hash"}


def test_statute_indexes(spark, tmp_path):
    art = lambda i, code, no: {"statute_id": i, "code_slug": code, "code_label": code.upper(), "article_no": no, "full_text": f"text {i}"}
    index = {
        "by_statute_id": {"S1": art("S1", "cp", "56"), "S2": "S9"},
        "by_code_slug_and_article_no": {"cp#56": "S1", "cc:1": [art("S3", "cc", "1")], "cx_2": "NOWHERE"},
        "by_code_label": {"CPC": {"10a": "S9"}},
        "records": [art("S4", "Cr", "7")],
    }
    (tmp_path / "i.json").write_text(json.dumps(index))
    rows = spark.createDataFrame([("S9", "cpc", "CPC", "10a", "t", ["a"], "text S9", None, None), ("S10", "cz", "CZ", "3", "t", ["a"], "text S10", None, None)], statutes.SCHEMA)
    entries = statutes.index_entries(spark, str(tmp_path / "i.json"), rows).cache()

    def ask(kind, *pairs):
        q = spark.createDataFrame([(k, a) for k, a in pairs], "key string, article string")
        return {(r.key, r.article): (r.found, r.full_text) for r in statutes.by_index(q, entries, kind).collect()}

    assert ask("id", ("S1", None), (" S2 ", None), ("S10", None), ("S99", None)) == {("S1", None): (True, "text S1"), (" S2 ", None): (True, "text S9"), ("S10", None): (True, "text S10"), ("S99", None): (False, None)}
    got = ask("code", ("CP", "56"), ("cc", "1"), ("cx", "2"), ("cr", "7"), ("cz", "3"), ("cz", "9"))
    assert got == {("CP", "56"): (True, "text S1"), ("cc", "1"): (True, "text S3"), ("cx", "2"): (True, None), ("cr", "7"): (True, "text S4"), ("cz", "3"): (True, "text S10"), ("cz", "9"): (False, None)}
    assert ask("label", ("CPC", "10A"), ("cpc", "10a"), ("CZ", "3")) == {("CPC", "10A"): (True, "text S9"), ("cpc", "10a"): (False, None), ("CZ", "3"): (True, "text S10")}


CASES = "ord bigint, sentence_id string, authoritative_case_number string, authoritative_decision_date string, language string, court string, case_type string, full_text string"


def test_case_folders_round_trip(spark, tmp_path):
    root = str(tmp_path / "c")
    rows = [(1, "11", "1/2020", "01/02/2020", "PT", "x", "Recurso", "a\nb"), (2, "12", "1/2020", "05/02/2020", "pt", None, "Outro", "c"), (3, "13", None, None, None, "y", None, " ")]
    df = spark.createDataFrame(rows, CASES)
    corpus.write_files(df, root)
    assert (tmp_path / "c/cases/pt/2020/1_2020/full_text.txt").read_text() == "a\nb"
    meta = json.loads((tmp_path / "c/cases/pt/2020/1_2020__dup2/metadata.json").read_text())
    assert meta["sentence_id"] == "12" and meta["court"] == "" and (tmp_path / "c/cases/unknown/unknown_year/unknown_case_0003").is_dir()
    m = corpus.read_manifest(spark, root)
    assert m.count() == 3
    found, skipped = corpus.read_files(spark, root, m, "sentence_id string, case_type string")
    assert {(r.sentence_id, r.full_text, r.metadata.case_type) for r in found.collect()} == {("11", "a\nb", "Recurso"), ("12", "c", "Outro")} and [r.sentence_id for r in skipped.collect()] == ["13"]
    more = spark.createDataFrame([(1, "14", "1/2020", "01/03/2020", "pt", "x", "R", "d\ne")], CASES)
    corpus.write_files(more, root, mode="append", collapse=True)
    assert (tmp_path / "c/cases/pt/2020/1_2020__dup3/full_text.txt").read_text() == "d e" and corpus.read_manifest(spark, root).count() == 4
    merged = {r.sentence_id: r for r in corpus.merged_cases(spark, root).collect()}
    assert merged["11"].full_text == "a b" and merged["11"].case_type == "Recurso" and merged["13"].full_text == ""
    assert corpus.merged_cases(spark, root, language="PT").count() == 3 and corpus.merged_cases(spark, root, limit=1).count() == 1
    assert corpus.read_manifest(spark, str(tmp_path / "none")).count() == 0
    assert [r.court_ord for r in corpus.per_court({"tui": df.limit(1), "tsi": more}).orderBy("court_ord").collect()] == [0, 1]


def test_requests_are_checked(spark):
    df = spark.createDataFrame([(1, " 假釋 ", 5), (2, "  ", 5), (3, None, 5), (4, "x", 0), (5, "x", None)], "query_id int, query string, top_k int")
    ok, bad = research.checked(df)
    assert {(r.query_id, r.query, r.top_k) for r in ok.collect()} == {(1, "假釋", 5), (5, "x", 5)}
    assert {r.query_id: r.why for r in bad.collect()} == {2: "query must not be blank", 3: "query is missing", 4: "top_k must be at least 1"}


def test_reports_and_responses(spark):
    asked = spark.createDataFrame([(1, "q", 5), (2, "nada", 5)], "query_id bigint, query string, top_k int")
    cites = spark.createDataFrame([(1, 1, "c1", "1/2020", "court", "d1", "texto um", "L1"), (1, 2, "c1", "", None, None, None, "L2")], "query_id bigint, source_rank int, chunk_id string, authoritative_case_number string, court string, authoritative_decision_date string, chunk_text_preview string, citation_label string")
    r = {x.query_id: x for x in research.report(asked, cites, cites).collect()}
    assert len(r[1].findings) == 3 and r[1].findings[0].finding_text == "Retrieved excerpt suggests: texto um (court=court, date=d1, rank=1)." and r[1].findings[2].citation_labels == ["L2"]
    assert r[1].top_cases == ["1/2020"] and r[1].sources == ["c1"] and 'query="q", hits=2, citations=2.' in r[1].research_scope
    assert len(r[2].findings) == 1 and r[2].findings[0].citation_labels == [] and r[2].sources == []

    hits = "query_id bigint, rank int, authoritative_case_number string, authoritative_decision_date string, court string, language string, case_type string, pdf_url string, text_url_or_action string"
    h = spark.createDataFrame([(1, 1, "1/2020", "d", "C", "pt", "T", "p", "u"), (1, 2, "1/2020", "e", "C2", "zh", "T2", "p2", "u2"), (1, 3, "2/2020", None, "C", "pt", "T", "p", "u"), (1, 4, " ", "d", "C", "pt", "T", "p", "u")], hits)
    cases = research.first_hits(h, "authoritative_case_number")
    meta = "ord int, authoritative_case_number string, court string, language string, case_type string, case_summary string, holding string, pdf_url string, text_url_or_action string, legal_basis array<string>, disputed_issues array<string>"
    model = spark.createDataFrame([(1, "1/2020", "", "pt", "T", "s", "h", "p", "u", ["a"], ["b"])], meta)
    base = spark.createDataFrame([(1, "1/2020", "B", "pt", "T", "s2", "h2", "p", "u", ["a"], ["b"])], meta)
    shown = research.with_cards(research.enriched(cases, research.metadata_index(model, "ord"), research.metadata_index(base, "ord")))
    got = {x.authoritative_case_number: x for x in shown.collect()}
    assert got["1/2020"].metadata_source == research.BASELINE and got["1/2020"].holding == "h2"  # the model's row is not complete
    assert got["2/2020"].metadata_source == research.BASELINE and got["2/2020"].case_summary == "" and got["2/2020"].court == "C"
    out = {x.query_id: x for x in research.responses(asked, shown).collect()}
    assert out[1].result_count == 2 and out[1].diagnostics.deterministic_fallback_used_count == 2 and out[1].diagnostics.success_flag and out[1].results[0].card_title == "1/2020｜T｜B"
    assert out[2].result_count == 0 and not out[2].diagnostics.success_flag and out[2].results == []


def test_hooks_and_routes(spark):
    asked = spark.createDataFrame([(1, "A"), (2, "B")], "query_id bigint, query string")
    one = lambda q, k: q.select("query_id", F.concat(F.lit("d"), F.lower("query")).alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    two = lambda q, k: q.select("query_id", F.lit("other").alias("id"), F.lit(2.0).alias("score"), F.lit(1).alias("rank"))
    assert {r.id for r in research.hybrid(asked, 3, [one, two]).collect()} == {"da", "db"}
    assert {r.id for r in research.hybrid(asked, 3, [one], normalize=lambda c: F.concat(c, F.lit("!")), rerank=lambda h: h.where("id = 'da!'")).collect()} == {"da!"}
    routed = spark.createDataFrame([(1, "x", "exact_case_number_heavy_bm25", False), (2, "假釋、緩刑", "decomposition", True), (3, "y", "direct", False)], "query_id bigint, normalized_query string, retrieval_mode string, decomposition_recommended boolean")
    got = {r.query_id: r.path for r in research.by_route(routed, two, one, 3).collect()}
    assert got == {1: "exact", 2: "fan_out", 3: "direct"}
    assert {r.query_id: r.path for r in research.by_route(routed, two, one, 3, exact_branch=False).collect()}[1] == "direct"
    merged = research.fan_out(asked, lambda q, k: q.select("query_id", F.lit("same").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")), 3).collect()
    assert {(r.query_id, r.id, tuple(r.matched_subqueries)) for r in merged} == {(1, "same", ("A",)), (2, "same", ("B",))}
