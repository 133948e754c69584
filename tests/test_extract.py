import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import extract, lexicon, queries


def one(spark, value, fn, *more):
    df = spark.createDataFrame([(value, *more)], ["t", *[f"c{i}" for i in range(len(more))]] if more else ["t"]) if value is not None else spark.createDataFrame([(None,)], "t string")
    return df.select(fn(F.col("t"), *[F.col(f"c{i}") for i in range(len(more))]).alias("x")).first().x


ZH = "案情摘要：嫌犯上訴。理由說明 第 56 條之2 及第12條。本院認為上訴理由不成立。 裁定駁回上訴。 完結。"
PT = "Assunto: Liberdade condicional; pena, recurso.\nAcordam em negar provimento ao recurso nos termos do artigo 56.º e do art. 12. Custas pelo recorrente."


def test_heading_blocks(spark):
    heads, stops = ("SUM[ÁA]RIO",), ("DECIS[ÃA]O",)
    assert one(spark, "x sumário : o réu\n recorreu. Decisão: nada", lambda c: extract.heading_block(c, heads, stops)) == "o réu recorreu."
    assert one(spark, "sem nada", lambda c: extract.heading_block(c, heads, stops)) == ""
    assert one(spark, "Sumário", lambda c: extract.heading_block(c, heads, stops)) == ""
    assert one(spark, "Sumário: a b Decisão: c Sumário: d", lambda c: extract.all_blocks(c, heads, stops)) == ["a b", "d"]
    assert one(spark, "Sumário: a b Decisão: c", lambda c: extract.first_block(c, heads, stops)) == "a b"
    assert one(spark, "x\nAssunto: •prazo do recurso\ny", lambda c: extract.heading_value(c, ("Descritores", "Assunto"))) == "prazo do recurso"


def test_improved_rules(spark):
    f = lambda fn, t, lang, *more: one(spark, t, lambda c, la, *m: fn(la, c, *m), lang, *more)
    assert f(extract.case_summary, "Assunto: Liberdade condicional; pena, recurso.", "pt", "Recurso penal") == "O caso discute Liberdade condicional; pena; recurso."
    assert f(extract.case_summary, "主題：假釋、緩刑", "zh", "x") == "本案聚焦假釋、緩刑。"
    assert f(extract.case_summary, "", "zh", "x") == ""
    assert f(extract.case_summary, "I - O réu recorreu. Nada mais.", "pt", "x") == "O réu recorreu."
    assert f(extract.holding, "Primeiro. Acordam em negar provimento. Fim aqui.", "pt") == "Acordam em negar provimento."
    assert f(extract.holding, "Um dia. Outro dia. Mais um.", "pt") == "Outro dia. Mais um."
    # five sentences: only the second half counts
    assert f(extract.holding, "Acordam em condenar. Dois aqui. Três aqui. O recurso segue. Cinco aqui.", "pt") == "O recurso segue."
    assert f(extract.legal_basis, ZH, "zh") == ["第56條", "第12條"]
    assert f(extract.legal_basis, "第 5 之 2 條、第5條及第5之2條", "zh") == ["第5之2條", "第5條"]
    assert f(extract.legal_basis, PT + " Artigo 56.º", "pt") == ["artigo 56.º", "art. 12."]
    assert f(extract.disputed_issues, "主要問題：假釋、量刑。", "zh", "刑事") == ["假釋", "量刑"]
    assert f(extract.disputed_issues, "nada", "pt", "Recurso") == ["Recurso"]


def score(s, lang):
    low, (a, b) = s.lower(), extract.HOLDING["zh" if lang == "zh" else "pt"]
    return 4 * sum(w in low for w in a) + sum(w in low for w in b) - 2 * (len(s) > 260 or len(s) < 8)


def test_best_holding_against_brute_force(spark):
    import random

    r = random.Random(4)
    words = ["acordam em", "o recurso", "tribunal", "negar provimento", "custas", "o arguido", "decisão", "nada consta", "x" * 270]
    for _ in range(25):
        sents = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) + "." for _ in range(r.randrange(1, 9))]
        skip = len(sents) // 2 if len(sents) > 4 else 0
        rated = [(score(s, "pt"), -len(s), i, s) for i, s in enumerate(sents) if i >= skip and score(s, "pt") > 0]
        want = max(rated)[3] if rated else " ".join(sents[-2:])
        got = one(spark, " ".join(sents), lambda c: extract.best_holding(F.lit("pt"), c))
        assert got.sentence == (want if len(want) <= 220 else want[:217] + "...") and got.score == (max(rated)[0] if rated else None)


def test_version_one_rules(spark):
    assert one(spark, "Relatório: o réu recorreu. Fundamentação: nada.", extract.v1_summary) == "o réu recorreu."
    assert one(spark, "Um. Dois. Três.", extract.v1_summary) == "Um. Dois."
    assert one(spark, "a decisão um. b julgar dois. c condenar três. d absolver quatro.", extract.v1_holding) == "b julgar dois. c condenar três. d absolver quatro."
    assert one(spark, "爭議焦點：甲、乙。主要問題：乙,丙。", extract.v1_issues, "刑事") == ["甲", "乙", "丙", "刑事"]
    assert one(spark, "第 1 條 artigo 2 Artigo 2", extract.v1_legal_basis) == ["第1條", "artigo 2"]
    assert one(spark, "法理：從輕。", extract.v1_point) == "從輕"
    assert one(spark, "Nada aqui. O tribunal deve julgar.", extract.v1_point) == "O tribunal deve julgar."
    assert one(spark, None, lambda c: extract.v1_holding(c)) == ""


def ref_snippets(t):
    squeeze = lambda x: re.sub(r"\s+", " ", x).strip()
    out = [t[:1800]]
    for heads, stops in extract.SNIPPET_HEADS:
        blocks = [squeeze(m.group(1)) for m in re.finditer(rf"(?:{'|'.join(heads)})\s*[:：]?\s*(.+?)(?=(?:{'|'.join(stops)})\s*[:：]?|$)", t, re.I | re.S)]
        out += [b for b in blocks if b][:1]
    held = []
    for s in re.split(r"(?<=[。！？!?；;\.])\s+", t):
        s = squeeze(s)
        if s and any(k in s.lower() for k in extract.SNIPPET_WORDS):
            held.append(s)
        if len(" ".join(held)) >= 2200:
            break
    out += [" ".join(held)] if held else []
    merged = squeeze("\n\n".join(squeeze(x) for x in [*out, t[-1500:]] if squeeze(x)))
    return merged if len(merged) <= 5200 else merged[:5197] + "..."


def test_prompt_texts_against_brute_force(spark):
    t = "".join(f"Frase número {i} sobre o artigo {i} do código. " + ("Fundamentação: razões do caso. " if i == 40 else "") for i in range(260))
    assert one(spark, t, extract.long_snippets) == ref_snippets(t)
    assert one(spark, "", extract.long_snippets) == "" and one(spark, None, extract.medium_text) == ""
    m = one(spark, t, extract.medium_text)
    assert m.startswith("Frase número 0") and "razões do caso" in m and len(m) <= 6800


def test_detail_pages(spark):
    page = "澳門特別行政區中級法院\n\n案件編號： 第 123/2020 號\n裁判日期：2020年3月5日\n主題: 假釋的前提\n摘要\n…"
    assert one(spark, page, extract.detail_case_number) == "123/2020"
    assert one(spark, page, extract.detail_date) == "2020年3月5日"
    assert one(spark, page, extract.detail_title) == "假釋的前提"
    assert one(spark, "Recurso penal\nmais texto\n摘要\nOutra", extract.detail_title) == "Recurso penal"
    assert one(spark, None, extract.detail_title) is None and one(spark, "", extract.detail_date) is None


def test_card_lines(spark):
    f = lambda t: one(spark, t, lambda c: extract.case_number_and_type(extract.head_lines(c, 100), c))
    assert tuple(f("Acórdão\n12/2020 - Recurso penal")) == ("12/2020", "Recurso penal")
    assert tuple(f("Recurso penal 12/2020")) == ("12/2020", "Recurso penal")
    assert tuple(f("12/2020\nRecurso penal")) == ("12/2020", "Recurso penal")
    assert tuple(f("12/2020\n01/02/2020")) == ("12/2020", None) and tuple(f("nada")) == (None, None)
    assert one(spark, ",:Recurso", extract.clean_case_type) == "Recurso"
    assert one(spark, "/2020", extract.clean_case_type) is None
    stops = lambda c: extract.labelled_value(c, ("摘要",), ("裁判結果",))
    assert one(spark, "主題：a 摘要：b c 裁判結果：d", stops) == "b c" and one(spark, "x", stops) is None
    assert one(spark, "Tribunal de Segunda Instância", extract.court_of) == "中級法院"


@pytest.mark.parametrize("q, want, rules", [
    ("第 0253 / 2026 號假释", "253/2026假釋", "case_number_format_normalization,legal_variant_mapping,high_value_legal_query_expansion"),
    ("１２/２０２０　Ａ", "12/2020a", "unicode_nfkc,case_number_format_normalization"),
    ("Liberdade Condicional", "liberdade condicional", ""), ("", "", ""),
])
def test_zh_queries(spark, q, want, rules):
    got = one(spark, q, queries.zh_query)
    assert got.normalized == want and ",".join(got.rules) == rules
    assert got.expanded.startswith(want) and ("提前釋放" in got.expanded) == ("假釋" in want)


def test_pt_queries(spark):
    assert one(spark, " Processo n 253 / 2026 ", queries.pt_query) == "processo nº253/2026"
    # the spelling is replaced inside words too
    assert one(spark, "decision of", queries.pt_query) == "decisionºf"


def ref_decompose(raw):
    def distinct(xs):
        return list(dict.fromkeys(xs))

    q = re.sub(r"[，,、;；]+", " ", re.sub(r"\s+", " ", raw.strip().replace("（", "(").replace("）", ")"))).strip()
    cases = distinct(re.findall(r"\b\d{1,5}/\d{4}\b", q))
    legal = distinct([v for k, v in lexicon.ISSUE_CONCEPTS.items() if k in q])
    steps = distinct([v for k, v in lexicon.ISSUE_STEPS.items() if k in q])
    facts = [t for t in lexicon.ISSUE_FACTS if t in q]
    for s in (x.strip() for x in re.split(r"[，,、;；]+|\s+|\b(?:與|和|及|或|並|且|還有)\b", q)):
        if s and s not in lexicon.ISSUE_CONCEPTS and s not in lexicon.ISSUE_STEPS and not re.fullmatch(r"\d{1,5}/\d{4}", s) and 2 <= len(s) <= 12 and not set(s) & set("()[]{}") and any(t in s for t in lexicon.ISSUE_FACTS):
            facts.append(s)
    facts = distinct(facts)
    main = (legal or steps or (["案件編號 " + cases[0]] if cases and len(q) <= 24 else []) or facts or [q])[0]
    subs = [x for x in distinct(legal + steps + ["案件編號 " + n for n in cases] + facts) if x != main][:6]
    terms = distinct(legal + steps)
    c = [raw.strip()] + ([q] if q and q != raw.strip() else []) + ([main] if main else []) + ([" ".join(terms[:4])] if terms else [])
    c += [f"{cases[0]} {' '.join(terms[:2])}"] if cases and terms else ["案件編號 " + cases[0]] if cases else []
    c += [f"{legal[0]} {facts[0]}"] if legal and facts else []
    return main, subs, distinct(cases + legal + steps + facts)[:10], distinct([x.strip() for x in c + subs[:3] if x.strip()])[:8]


@pytest.mark.parametrize("q", ["量刑过重，緩刑及上訴", "253/2026 被告的供述 與 證據", "案件 12/2020", "", "  無關的問題 ", "加重诈骗、損失（被告）; 駁回 上訴 再審 12/2020 13/2021"])
def test_decomposition_against_brute_force(spark, q):
    got = one(spark, q, queries.decomposed)
    assert (got.main_issue, got.sub_issues, got.query_terms, got.subqueries) == ref_decompose(q)


def test_traditional_and_evaluation_forms(spark):
    got = one(spark, "争议确认 ok", lambda c: extract.to_traditional(c, lexicon.TRADITIONAL))
    assert tuple(got) == ("爭議確認 ok", True, "traditional_chinese")
    assert tuple(one(spark, "abc", lambda c: extract.to_traditional(c, lexicon.TRADITIONAL))) == ("abc", False, "not_applicable")
    assert one(spark, " A-b,  C! ", extract.evaluation_text) == "a b c"
    assert one(spark, "A-b 假釋 a", extract.evaluation_tokens) == ["a", "b", "假釋"]
    assert one(spark, "假釋 a/1 釋", extract.usage_tokens) == ["假釋", "a/1"]
