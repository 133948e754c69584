import random

from foliant.llm import truncation as T

SUBJECTS = "a recorrente,o arguido,a testemunha,o tribunal,a sociedade,o perito".split(",")
VERBS = "alegou que,confirmou que,negou que,declarou que".split(",")
FACTS = "o contrato foi celebrado sem forma escrita,a renda deixou de ser paga,o cheque foi devolvido por falta de provisão,a notificação não chegou ao destinatário".split(",")


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(FACTS)}.".capitalize()


def run(spark, rows):
    df = spark.createDataFrame(rows, "ord bigint, text string, src string, cut string")
    return {r["ord"]: r for r in T.cut_values({"t": T.field_values(df, 0, "src", "text")}).collect()}


def test_cut_and_complete_values(spark):
    r = random.Random(5)
    full = [" ".join(sentence(r) for _ in range(r.randrange(2, 5))) for _ in range(400)]
    rows = [(i, t, "s", "x") for i, t in enumerate(full)]
    inside_word = [(1000 + i, t[: t.rindex(" ") - 2], "s", "x") for i, t in enumerate(full[:20])]
    inside_sentence = [(1100 + i, t[: t.rindex(" que ") + 4], "s", "x") for i, t in enumerate(full[20:40])]
    marked = [(1200 + i, t[: t.rindex(" que ") + 6] + "...", "s", "x") for i, t in enumerate(full[40:60])]
    no_mark = [(1300 + i, t[:-1], "s", "x") for i, t in enumerate(full[60:80])]
    edge = [(1400, None, "s", "x"), (1401, "", "s", "x"), (1402, "  ", None, "x"), (1403, "I - RELATÓRIO", None, "x"), (1404, full[0], None, "x"), (1405, "...", "s", "x")]
    got = run(spark, rows + inside_word + inside_sentence + marked + no_mark + edge)
    assert all(got[i].cut for i, *_ in inside_word + inside_sentence + marked)
    assert not any(got[i].cut for i, *_ in rows + no_mark)
    assert {1400, 1401, 1402} & set(got) == set() and not got[1403].cut and not got[1404].cut


def test_repeated_rows_and_empty_table(spark):
    got = run(spark, [(1, "Uma frase só.", "s", "x"), (2, "Uma frase só.", "s", "x")])
    assert not got[1].cut and not got[2].cut
    df = spark.createDataFrame([], "ord bigint, text string, src string")
    v = T.cut_values({"t": T.field_values(df, 0, "src", "text")})
    assert v.count() == 0 and T.cut_shares(v).count() == 0


def test_streams_of_one_text_are_those_of_many():
    from foliant.llm.sentences import split_spans

    texts = ["O Dr. Silva saiu. Voltou", "", "本院認為不成立。其後離開", "a", "Fim..."]
    spans = [split_spans(t) for t in texts]
    many = T._Streams(texts, spans)
    for i, t in enumerate(texts):
        one = T._Streams([t], [spans[i]])
        if one.last[0] < 0:
            assert many.last[i] < 0
            continue
        sl = slice(many.first[i], many.last[i] + 1)
        assert (many.signs[sl] == one.signs[one.first[0] : one.last[0] + 1]).all()
        assert (many.event[sl] == one.event[one.first[0] : one.last[0] + 1]).all()
