import pytest
from pyspark.sql import functions as F

from foliant.functions import text, urls


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("fn, value, want", [
    (text.squeeze, " a 　 b \n c ", "a b c"),
    (text.squeeze, None, None),
    (text.keep_paragraphs, "a  b \r\n\r\n\r\n\r\n c\t\td ", "a b\n\nc d"),
    (text.multiline, "﻿a b", "a b"),
    (text.ranking_text, "Árvore_Nº ５,  foo!", "árvore no 5 foo"),
    (lambda c: text.clip(c, 10), "0123456789", "0123456789"),
    (lambda c: text.clip(c, 10), "01234567890", "0123456..."),
    (lambda c: text.preview(c, 5), "abcdefgh", "abcde..."),
    (lambda c: text.clean_preview(c, 5), "abcdefgh", "abcd…"),
    (text.spaced_sentences, "Um. Dois! 三。四。 五", ["Um.", "Dois!", "三。四。", "五"]),
    (text.case_key, "２５３ / 2026-A", "253/2026-a"),
    (text.case_identity, "Proc. n.º 0253 / 2026-a de", "253/2026-A"),
    (text.case_identity, "nenhum", None),
    (text.replace_variants, "量刑明顯過重與提前釋放", "量刑過重與假釋"),
    (text.expansion_terms, "緩刑 緩期執行", ["暫緩執行"]),
    (text.han_tokens, "甲 上訴人", ["甲", "上訴人", "上訴", "訴人", "上訴"]),
    (text.mixed_tokens, "Acórdão 253/2026", ["253/2026", "253/2026", "acórdão", "acordao"]),
    (text.mixed_tokens, "編號253/2026", ["253/2026", "編號", "編號"]),
    (text.mixed_tokens, "", []),
    (text.light_tokens, "Proc 253/2026 甲乙丙", ["proc", "253", "2026", "甲乙", "乙丙"]),
    (text.char_ngrams, "a b甲", ["ab", "b甲", "ab甲", "甲"]),
    (text.year_of, "05/03/2026", "2026"),
    (text.year_of, "?", "unknown_year"),
    (text.visible_text, "<html><script>x()</script><p>A &amp; B</p><div>C</div></html>", "A & B\nC"),
    (lambda c: text.labelled(c, ("Relator",)), "Tribunal: X\nRelator: Dr. A\nFim", "Dr. A"),
    (lambda c: text.without_lines(c, ("imprimir",), ("http",)), "a\n Imprimir \nvê http://x\nb", "a\nb"),
    (text.nfkc, "Ａ①ﬁ", "A1fi"),
    (text.fold_accents, "Árvore Ção", "arvore cao"),
    (urls.canonical, "HTTP://Ex.Example/a/?b=2&a=1#f", "http://ex.example/a?a=1&b=2"),
    (urls.canonical, "//ex.example", "https://ex.example"),
    (urls.canonical, "", None),
    (urls.sentence_id, "https://x/sentence/PT/123?q=1", "123"),
    (urls.language, "https://x/zh/1", "zh"),
    (urls.kind, "https://x/sentence/pt/1", "text_pt"),
    (lambda c: urls.page_param(c, F.lit(3)), "https://x/a?page=2&q=1", "https://x/a?q=1&page=3"),
    (lambda c: urls.page_param(c, F.lit(1)), "https://x/a?page=2", "https://x/a"),
])
def test_functions(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_slug(spark):
    df = spark.createDataFrame([("253/2026-A", 1), ("甲", 2), (None, 3)], "c string, i int")
    assert [r.x for r in df.select(text.slug(F.col("c"), F.col("i")).alias("x")).collect()] == ["253_2026_a", "unknown_case_0002", "unknown_case_0003"]
