import random

from foliant.llm.spam import page_curves, spam_pages

SUBJECTS = "a recorrente,o arguido,a testemunha,o tribunal,a sociedade,o perito,a ré,o autor,a entidade,o trabalhador".split(",")
VERBS = "alegou,confirmou,negou,declarou,requereu,apresentou,impugnou,recebeu,pagou,assinou".split(",")
OBJECTS = "o contrato,a escritura,o recibo,a certidão,o auto,a carta,o relatório,a renda,o cheque,a prova".split(",")
WHERE = "na sessão,perante o notário,sem forma escrita,no prazo legal,a fls. dos autos,em sede de recurso,por despacho,de boa fé".split(",")
KEYS = "advogado barato,registo marca,visto residência,crédito já,herança online,divórcio rápido".split(",")


def prose(r, n):
    return " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(WHERE)} e {r.choice(VERBS)} que {r.choice(OBJECTS)} não existe.".capitalize() for _ in range(n))


def corpus():
    r = random.Random(3)
    rows = [(i, prose(r, r.randrange(8, 40)), r.choice(["pt", "PT ", "pt-PT", None]), "x") for i in range(400)]
    rows += [(1000 + i, " | ".join(r.choice(KEYS) for _ in range(80)), "pt", "x") for i in range(5)]
    rows += [(1010 + i, prose(r, 1) + "\n" + "\n".join(f"{r.choice(KEYS)} - https://h{r.randrange(99)}.test/{r.randrange(999)}" for _ in range(40)), "pt", "x") for i in range(5)]
    rows += [(1020, prose(r, 30) + "\nTags: " + ", ".join(KEYS), "pt", "x"), (1021, None, "pt", "x"), (1022, "", "pt", "x"), (1023, " \n", None, "x"), (1024, "123 456", "pt", "x")]
    return rows


def test_spam_is_told_from_prose(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, tok string")
    assert {r.doc_id for r in spam_pages(df).collect()} == set(range(1000, 1005)) | set(range(1010, 1015))


def test_copies_share_the_verdict_and_empty_table(spark):
    rows = corpus()
    rows.append((2000, rows[400][1], "pt", "y"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, tok string")
    assert 2000 in {r.doc_id for r in spam_pages(df).collect()}
    assert page_curves(df.limit(0)).count() == 0


SCHEMA = "doc_id bigint, text string, lang string, tok string"


def test_one_spam_page_as_a_third_of_all_rows(spark):
    r = random.Random(5)
    keys = " ".join(r.choice(KEYS) for _ in range(80))
    other = " | ".join(r.choice(KEYS) for _ in range(90))
    rows = [(i, prose(r, r.randrange(8, 40)), "pt", "x") for i in range(400)]
    rows += [(1000 + i, keys, "pt", "x") for i in range(200)] + [(2000, other, "pt", "x")]
    assert {x.doc_id for x in spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(1000, 1200)) | {2000}


def test_a_length_class_of_spam_alone(spark):
    r = random.Random(6)
    rows = [(i, prose(r, r.randrange(8, 40)), "pt", "x") for i in range(400)]
    rows += [(1000 + i, " ".join(r.choice(KEYS) for _ in range(1400 + i)), "pt", "x") for i in range(30)] + [(2000, " ".join(KEYS * 900), "pt", "x")]
    assert {x.doc_id for x in spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(1000, 1030)) | {2000}


def test_no_known_language_has_a_fixed_reference(spark):
    r = random.Random(7)
    words = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3)) for _ in range(700)]
    rows = [(i, prose(r, r.randrange(8, 40)), "pt", "x") for i in range(400)]
    rows += [(1000, " ".join(r.choice(words[:9]) for _ in range(900)), "", "x"), (1001, " ".join(words), None, "x")]
    assert {x.doc_id for x in spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()} == {1000}


def test_other_scripts_are_read(spark):
    r = random.Random(8)
    letters = {"ru": "бвгджзклмнпрстфцчшщ", "ar": "بتثجحخدذرزسشصضطظعغفقكلمن", "ko": "가나다라마바사아자차카타파하고노도로모보"}
    rows = [(i, prose(r, r.randrange(8, 40)), "pt", "x") for i in range(400)]
    want = set()
    for n, (lang, abc) in enumerate(letters.items()):
        words = ["".join(r.choice(abc) for _ in range(r.randrange(2, 8))) for _ in range(900)]
        for i in range(40):
            common = [words[min(int(r.paretovariate(0.7)), 899)] for _ in range(r.randrange(150, 400))]
            rows.append((1000 * (n + 1) + i, " ".join(common), lang, "x"))
        rows.append((1000 * (n + 1) + 99, " ".join(r.choice(words[600:606]) for _ in range(300)), lang, "x"))
        want.add(1000 * (n + 1) + 99)
    df = spark.createDataFrame(rows, SCHEMA)
    curves = {x.doc: x for x in page_curves(df).collect()}
    assert len(curves) == len(rows) and all(c.tokens >= 150 for d, c in curves.items() if d >= 1000)
    assert {x.doc_id for x in spam_pages(df).collect()} == want


def test_a_rare_language_has_a_profile_of_its_own(spark):
    r = random.Random(9)
    words = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(1, 5))) for _ in range(900)]
    rows = [(i, prose(r, r.randrange(8, 40)), "pt", "x") for i in range(2500)]
    rows += [(5000 + i, " ".join(words[min(int(r.paretovariate(0.6)), 899)] for _ in range(r.randrange(100, 300))), "xx", "x") for i in range(22)]
    assert {c.lang for c in page_curves(spark.createDataFrame(rows, SCHEMA)).where("doc >= 5000").collect()} == {"xx"}
    assert not {x.doc_id for x in spam_pages(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rows_that_share_or_lack_an_id_stay_apart(spark):
    r = random.Random(10)
    rows = [(i, prose(r, r.randrange(8, 40)), "pt", "x") for i in range(300)]
    keys = " | ".join(r.choice(KEYS) for _ in range(80))
    rows += [(None, keys, "pt", "x"), (None, prose(r, 30), "pt", "x"), (7, keys, "pt", "y")]
    got = page_curves(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted((c.doc or 0) for c in got if c.is_spam) == [0, 7]
