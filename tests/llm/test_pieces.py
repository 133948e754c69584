import random

from foliant.llm.pieces import cut, oversized_pieces


def check(text, limit, overlap):
    spans = cut(text, limit, overlap)
    if len(text) <= limit:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, e), (s2, e2) in zip(spans, spans[1:]):
        assert s2 == e - overlap and e2 > e
    assert all(0 < e - s <= limit for s, e in spans)


def test_limits_and_overlap():
    rnd = random.Random(1)
    words = ["palavra", "fim.", "Artigo", "\n\n", "a", "第一條。", "\n", "", "x" * 300]
    for _ in range(200):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 700)))
        check(t, 1600, 100)
        check(t, 90, 20)
    check("x" * 10_000, 1600, 100)


def test_natural_ends_first():
    t = ("Primeira frase curta. " * 50).strip() + "\n\n" + "Outra frase. " * 60
    s, e = cut(t)[0]
    assert t[s:e].endswith("curta.") and t[e : e + 2] == "\n\n"


def test_rows(spark):
    long = "Uma frase. " * 400
    rows = [(1, long, 5), (1, long, 5), (2, "x" * 1600, 5), (3, "x" * 1601, 5), (4, None, 5), (5, "", 5)]
    df = spark.createDataFrame(rows, "ord bigint, chunk_text string, piece_no int")
    got = oversized_pieces(df)
    assert {r["ord"] for r in got.where("piece_no = 1").collect()} == {1, 3}
    for r in got.collect():
        assert len(r.piece_text) == r.end_at - r.start_at <= 1600
    assert oversized_pieces(df.limit(0)).count() == 0


def test_no_sign_is_parted():
    from foliant.llm.pieces import cut

    for sign in ("é", "👩‍⚖️", "👍🏽", "🇵🇹", "क्ष"):
        text = "x" + sign * 3000
        for _, e in cut(text, 1600, 100)[:-1]:
            rest = text[e:]
            assert not rest or rest.startswith(sign), (sign, e)
    marks = "a" + "́" * 5000
    spans = cut(marks, 1600, 100)
    assert all(e - s <= 1600 for s, e in spans) and spans[-1][1] == len(marks)
