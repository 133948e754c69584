import pytest

from foliant.llm.sentences import sentence_units, split_spans


def units(t):
    return [t[a:b] for a, b in split_spans(t)]


@pytest.mark.parametrize("text, want", [
    (None, []), ("", []), (" \n\t　", []),
    ("Sem ponto final", ["Sem ponto final"]),
    ("O Sr. Dr. J. Silva saiu. Voltou às 9:47.", ["O Sr. Dr. J. Silva saiu.", "Voltou às 9:47."]),
    ("Nos termos do art. 5.º, n.º 2, al. b). Custas a 3,5%.", ["Nos termos do art. 5.º, n.º 2, al. b).", "Custas a 3,5%."]),
    ("Pagou recibos, etc., a fls. 20 v. e foi. Fim.", ["Pagou recibos, etc., a fls. 20 v. e foi.", "Fim."]),
    ('Disse: "Não vi. Só ouvi." E saiu.', ['Disse: "Não vi. Só ouvi."', "E saiu."]),
    ("Respondeu «Nunca. Jamais.» e nada mais disse.", ["Respondeu «Nunca. Jamais.» e nada mais disse."]),
    ("pedido do arguido D. Por carta veio.", ["pedido do arguido D.", "Por carta veio."]),
    ("I - RELATÓRIO\n\nO réu pediu.", ["I - RELATÓRIO", "O réu pediu."]),
    ("A recorrente pediu ainda\nredução da pena. Não foi\natendida.", ["A recorrente pediu ainda\nredução da pena.", "Não foi\natendida."]),
    ("1. Primeiro ponto.\n\n2) Segundo ponto.", ["1. Primeiro ponto.", "2) Segundo ponto."]),
    ("他說：「我不知道。我沒看見。」其後離開。", ["他說：「我不知道。我沒看見。」", "其後離開。"]),
    ("證人答稱「不是我。」，其後沒有補充。", ["證人答稱「不是我。」，其後沒有補充。"]),
    ("沒有證據……因此不能成立。直至該日才知悉……本院認為如此！", ["沒有證據……因此不能成立。", "直至該日才知悉……", "本院認為如此！"]),
    ("誤寫為12.5元.檢察院發表意見.", ["誤寫為12.5元.", "檢察院發表意見."]),
    ("本案理由成立\n上訴人不服", ["本案理由成立", "上訴人不服"]),
    ("The rate was 3.4% on p. 12 of vol. 3. Mr. Low paid Messrs. A & Co. Ltd. in full.", ["The rate was 3.4% on p. 12 of vol. 3.", "Mr. Low paid Messrs. A & Co. Ltd. in full."]),
    ("क्या हुआ? यह ठीक है। अच्छा।", ["क्या हुआ?", "यह ठीक है।", "अच्छा।"]),
])
def test_units(text, want):
    assert units(text) == want


def test_units_cover_everything_but_blanks():
    t = "﻿Ｏ Ｄr.​ Ｓilva saiu. 「甲。乙。」丙\n\n…\nD.L. n.º 5/99/R. Fim"
    spans = split_spans(t)
    left, last = "", 0
    for a, b in spans:
        assert last <= a < b
        left, last = left + t[last:a], b
    assert not (left + t[last:]).strip()


def test_rows_repeated_long_and_empty(spark):
    long = "Uma frase longa número um. " * 5000
    rows = [(1, "A. Silva saiu. Fim.", "x"), (1, "A. Silva saiu. Fim.", "y"), (2, None, "z"), (3, long, ""), (4, " ", None)]
    df = spark.createDataFrame(rows, "ord bigint, chunk_text string, start_at string")
    got = sentence_units(df)
    assert got.columns == ["ord", "start_at", "end_at"]
    n = {r["ord"]: r["count"] for r in got.groupBy("ord").count().collect()}
    assert n == {1: 4, 3: 5000}
    assert sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [
    ("He said no. Then he left.", 2), ("It is a work of art. We saw it.", 2), ("He cited No. 12 of the Act. It was old.", 2), ("Foi ao mar. Depois voltou.", 2),
    ("Nos termos do art. V do Código, o mar. Fim", 2), ("Il habite M. Dupont.", 1), ("Il a vu M. Dupont. Elle est partie.", 2), ("First sentence.Second sentence.", 2),
    ("Veja www.Exemplo.Test agora. Fim.", 2), ("สวัสดีครับวันนี้อากาศดีมาก เราจะไปเที่ยวกันที่ทะเลพรุ่งนี้", 2),
])
def test_languages_suppress_their_own_abbreviations(text, want):
    assert len(units(text)) == want


def test_long_quotations_and_brackets_are_not_split():
    quote = "Disse «" + "Não vi nada. " * 160 + "» e saiu. Fim."
    bracket = "O réu (" + "que nada disse. " * 60 + "(nem antes.) E calou) saiu. Fim."
    title = "見《" + "甲。" * 150 + "》第一條。完。"
    assert [len(units(t)) for t in (quote, bracket, title)] == [2, 2, 2]
    assert len(units("Ficou aberta ( a frase. Outra frase. E mais uma.")) == 3
    assert len(units('Mede 5" de largo. Depois disse "não sei. Talvez" e saiu. Fim.')) == 3
