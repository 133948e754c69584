from foliant.llm.one_form import look_alike_pairs, one_form

SAME = ["Arguido Ａ, n.º 12", "Аrguido A, n.º 12", "Arguido A, n.º 12", "Argui​do A, n.º 12", "Arguido A, n.º 12"]


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "ord bigint, chunk_text string, look string, spelling string")
    return {(r.ord_a, r.ord_b) for r in look_alike_pairs(df).collect()}


def test_pairs_against_brute_force(spark):
    texts = SAME + ["Arguido A, n.o 12", "Arguído A, n.º 12", "acçã̃o", "acção", "acção", "m²", "m2", "條⽂", "條文", "rectiﬁcar", "rectificar", "", "  ", None, SAME[0]]
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)]
    forms = {r["ord"]: r.one_form for r in one_form(spark.createDataFrame(rows, "ord bigint, chunk_text string, look string, spelling string")).collect()}
    want = {
        (a, b)
        for a, x in enumerate(texts)
        for b, y in enumerate(texts)
        if a < b and x and y and x.strip() and y.strip() and x != y and forms[a] == forms[b]
    }
    got = pairs(spark, rows)
    assert got == want
    n = len(SAME)
    assert {(a, b) for a in range(n) for b in range(a + 1, n)} <= got
    i = texts.index
    assert (i("m²"), i("m2")) not in got and (i(SAME[4]), i("Arguído A, n.º 12")) not in got and (i(SAME[4]), i("Arguido A, n.o 12")) not in got
    assert (i("條⽂"), i("條文")) in got and (i("rectiﬁcar"), i("rectificar")) in got and (i("acção"), i("acção")) in got


def test_hot_spelling_makes_no_pairs_of_copies(spark):
    rows = [(i, "igual", None, None) for i in range(500)] + [(999, "iguаl", None, None)]
    assert len(pairs(spark, rows)) == 500


def test_nulls_and_empty_table(spark):
    assert pairs(spark, [(1, None, None, None), (2, "", None, None)]) == set()
    df = spark.createDataFrame([], "ord bigint, chunk_text string")
    assert look_alike_pairs(df).count() == 0 and one_form(df).count() == 0


def test_chunks_come_out_in_one_form(spark, tmp_path):
    from foliant.llm.queries import ORACLE_SQL, QUERIES

    rows = [(i, t) for i, t in enumerate([*SAME, None, ""])]
    spark.createDataFrame(rows, "ord bigint, chunk_text string").write.parquet(f"{tmp_path}/case_chunks.parquet")
    got = {(r["ord"], r.one_form) for r in QUERIES["p2_chunk_forms"](spark, str(tmp_path)).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW case_chunks AS FROM read_parquet('{tmp_path}/case_chunks.parquet/*.parquet')")
    assert got == set(con.execute(ORACLE_SQL["p2_chunk_forms"]).fetchall())
    assert len({f for i, f in got if i < len(SAME)}) == 1 and len(got) == len(rows)


def test_words_of_one_script_stay_readable(spark):
    rows = [(1, "Москва столица"), (2, "Mосква"), (3, "Аcórdão\nМосква"), (4, "می‌خواهم"), (5, "میخواهم"), (6, "a‌b"), (7, None)]
    df = spark.createDataFrame(rows, "ord bigint, chunk_text string")
    got = {r.ord: r for r in one_form(df).collect()}
    assert got[1].readable_form == "Москва столица" and got[3].readable_form == "Acórdão\nМосква"
    assert got[4].one_form == got[4].readable_form == "می‌خواهم" != got[5].one_form and got[6].one_form == "ab" and got[7].one_form is None
    alike = spark.createDataFrame([(1, "Москва"), (2, "Mосква"), (3, "Mосквa")], "ord bigint, chunk_text string")
    assert {(r.ord_a, r.ord_b) for r in look_alike_pairs(alike).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_a_hot_look_gives_all_its_pairs(spark):
    rows = [(i, "texto igual" if i % 2 else "texto\u00a0igual") for i in range(120)] + [(500 + i, f"outro {i}") for i in range(50)]
    got = look_alike_pairs(spark.createDataFrame(rows, "ord bigint, chunk_text string")).collect()
    assert len(got) == len(set(got)) == 60 * 60
