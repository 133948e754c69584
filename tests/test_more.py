import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import text, urls
from foliant.operators.model import generate
from foliant.sources import statutes


def test_statutes(spark, tmp_path):
    idx, art = tmp_path / "i.jsonl", tmp_path / "a.jsonl"
    idx.write_text(json.dumps({"statute_id": "cc-1", "code_slug": "CC", "code_label": "Código Civil", "article_no": "1", "article_title": "índice"}) + "\n")
    art.write_text("".join(json.dumps({"statute_id": i, "code_slug": "cc", "code_label": "Código Civil", "article_no": n, "article_title": "artigo", "flags": {"x": "1"}}) + "\n" for i, n in (("cc-1", "1"), ("cc-2", "2"))))
    rows = statutes.articles(spark, str(idx), str(art))
    q = spark.createDataFrame([("cC", "1"), ("cc", "2"), ("cc", "9")], "code string, article string")
    got = {r.article: (r.found, r.article_title, r.flags) for r in statutes.by_code(q, rows).collect()}
    assert got == {"1": (True, "índice", {}), "2": (True, "artigo", {"x": "1"}), "9": (False, None, None)}
    q = spark.createDataFrame([("código civil", "1"), ("Código Civil", "1")], "label string, article string")
    assert {r.label: r.found for r in statutes.by_label(q, rows).collect()} == {"código civil": False, "Código Civil": True}
    q = spark.createDataFrame([("cc-2",), ("zz",)], "query_id_text string")
    assert {r.query_id_text: r.found for r in statutes.by_id(q, rows).collect()} == {"cc-2": True, "zz": False}
    with pytest.raises(FileNotFoundError):
        statutes.articles(spark, str(tmp_path / "none"))


def test_links(spark):
    html = '<a href="/x.pdf">p</a> <a class=a href=\'https://t/sentence/pt/5\'>t</a><a href="https://t/sentence/zh/5">z</a>'
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(urls.links(F.col("h")).alias("l"))
    r = df.select(F.transform("l", lambda x: x["kind"]).alias("k"), urls.text_link(F.col("l")).alias("t"), urls.pdf_link(F.col("l")).alias("p")).collect()
    assert (r[0].k, r[0].t, r[0].p) == (["pdf", "text_pt", "text_zh"], "https://t/sentence/zh/5", "/x.pdf")
    assert (r[1].t, r[1].p) == (None, None)


@pytest.mark.parametrize("fn, value, want", [
    (lambda c: text.header(c)["case_type"], "01/05/2018 129/2026 Processo sumário", "Processo sumário"),
    (lambda c: text.header(c)["case_number"], "129/2026 sem data", None),
    (text.as_list, "A; b；a\n ;", ["A", "b"]), (text.as_list, '["x", "X ", ""]', ["x"]), (text.as_list, None, []), (text.as_list, "", []),
    (text.json_block, 'eis: ```{"a": {"b": 1}}``` fim', '{"a": {"b": 1}}'), (text.json_block, "{quebrado", None), (text.json_block, None, None),
    (lambda c: text.block(c, ("Sumário",), ("Decisão",)), "Sumário: a b Decisão: c", "a b"),
    (lambda c: text.head_and_tail(c, 4, "~"), "abcdef", "ab~ef"), (lambda c: text.head_and_tail(c, 6), "abcdef", "abcdef"),
    (text.length_route, "x" * 3801, "medium"),
])
def test_more_text(spark, fn, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x == want


def test_model_calls(spark):
    def backend(p):
        if "falha" in p:
            raise ValueError(p)
        return p.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "falha"), (3, None)], "id int, p string")
    got = {r.id: (r.output, r.attempts, r.source) for r in generate(df, "id", "p", backend, 1, lambda p: "regra").collect()}
    assert got == {"1": ("OK", 1, "model"), "2": ("regra", 2, "fallback"), "3": (None, 0, "skipped")}


def test_tokenizer_modes(spark):
    import pytest
    from pyspark.sql import functions as F

    from foliant.functions import text

    df = spark.createDataFrame([("假釋 abc",)], "t string")
    plain = df.select(text.tokenizer()(F.col("t")).alias("x")).first().x
    words = lambda c: F.split(F.concat(c, F.lit("|釋放|xyz")), r"\|")
    assert df.select(text.tokenizer("auto")(F.col("t")).alias("x")).first().x == plain
    assert df.select(text.tokenizer("dictionary", words)(F.col("t")).alias("x")).first().x == [*plain, "假釋 abc", "釋放"]
    for mode in ("dictionary", "unknown"):
        with pytest.raises(ValueError):
            text.tokenizer(mode)


def test_cards_shown_and_ordered(spark):
    from pyspark.sql import functions as F

    from foliant.operators import cards, lookup, quality, search

    df = spark.createDataFrame([("9/2020", "05/03/2020", "a", "pt"), ("10/2020", "01/12/2019", None, "zh"), ("2/2021", "?", "", "zh")], "authoritative_case_number string, decision_date string, metadata_source string, language string")
    numbers = lambda x: [r.authoritative_case_number for r in x.collect()]
    assert numbers(df.orderBy(*cards.order_of("authoritative_case_number"))) == ["9/2020", "10/2020", "2/2021"]
    assert numbers(df.orderBy(*cards.order_of("decision_date"))) == ["2/2021", "10/2020", "9/2020"]
    assert numbers(df.orderBy(*cards.order_of("decision_date", descending=True))) == ["9/2020", "10/2020", "2/2021"]
    assert cards.shown(df).count() == 3 and cards.shown(df, source="-").count() == 2 and numbers(cards.shown(df, source="-", language="zh").orderBy("decision_date")) == ["10/2020", "2/2021"]
    x = spark.createDataFrame([("a" * 300, 0.1234565, ["b"]), (None, 2.0, [])], "t string, score double, l array<string>")
    assert [len(r.p) for r in x.select(cards.short_preview(F.col("t")).alias("p")).collect()] == [100, 0]
    assert search.reported(x).first().score == 0.123456 and [r.m for r in x.select(lookup.missing(["t"], ["l"]).alias("m")).collect()] == [False, True]
    m = spark.createDataFrame([(True, True, False), (True, True, True)], "case_ok boolean, date_ok boolean, document_ok boolean")
    assert [r.are_cards for r in quality.true_cards(m).collect()] == [False, True]
    s = spark.createDataFrame([(True, False), (False, False), (False, True)], "u boolean, f boolean")
    assert [r.s for r in s.select(quality.partial_success(F.col("u"), F.col("f")).alias("s")).collect()] == ["partial_success", "failed", "success"]


def test_comparable_records(spark):
    from pyspark.sql import functions as F

    from foliant.sources import artifacts

    core = ", ".join(f'"{f}": ""' for f in artifacts.CORE_FIELDS)
    digest = ", ".join(f'"{f}": ""' for f in artifacts.DIGEST_FIELDS)
    rows = [(f'{{"core_case_metadata": {{{core}}}, "generated_digest_metadata": {{{digest}}}}}',), (f'{{"core_case_metadata": {{{core}}}}}',), ("{}",)]
    df = spark.createDataFrame(rows, "t string").select(F.parse_json("t").alias("v"))
    assert [r.x for r in df.select(artifacts.comparable(F.col("v")).alias("x")).collect()] == [True, False, False]
