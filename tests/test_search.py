import math
from collections import Counter

from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import chunking, search

DOCS = [(1, "recurso penal recurso"), (2, "recurso civil"), (3, "nada"), (4, ""), (5, None), (6, "recurso civil")]


def brute(docs, query, weights):
    toks = {i: {f: (t or "").split() for f, t in zip("ab", (d, d))} for i, d in docs}
    lens = {i: sum(len(v) for v in f.values()) for i, f in toks.items()}
    avg = sum(lens.values()) / len(docs)
    out = {}
    for term in query.split():
        df = sum(any(term in v for v in f.values()) for f in toks.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, f in toks.items():
            for name, v in f.items():
                tf = Counter(v)[term]
                if tf:
                    out[i] = out.get(i, 0) + idf * weights[name] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[i] / avg))
    return out


def test_bm25_counts_repeated_tokens_and_merged_length(spark):
    df = spark.createDataFrame(DOCS, "id int, t string")
    q = spark.createDataFrame([(1, "recurso recurso civil"), (2, "ausente")], "query_id int, q string")
    w = {"a": 4.0, "b": 1.0}
    toks = F.filter(F.split(F.col("t"), " "), lambda x: x != "")
    got = search.bm25(df, "id", {"a": toks, "b": toks}, w, q, F.split("q", " "))
    want = brute(DOCS, "recurso recurso civil", w)
    rows = {r.id: r.score for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[i] - want[i]) < 1e-9 for i in want)
    top = search.top_k(got.withColumn("score", F.round("score", 9)), 2, "id").collect()
    assert [(r.rank, r.id) for r in sorted(top, key=lambda r: r["rank"])] == [(1, 2), (2, 6)]
    assert search.top_k(got, 0, "id").count() == 1


def test_exact_then_fallback(spark):
    e = spark.createDataFrame([(1, 10, 10), (2, 1, 1), (2, 2, 2), (2, 3, 3)], "query_id int, id int, ord int")
    f = spark.createDataFrame([(1, 11, 11, 50.0), (1, 10, 10, 9.0), (2, 9, 9, 9.0)], "query_id int, id int, ord int, score double")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in search.exact_with_fallback(e, f, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 10, 100.0), (1, 2, 11, 9.9), (2, 1, 1, 100.0), (2, 2, 2, 100.0), (2, 3, 3, 100.0)]


def test_dense_top_k_against_brute_force(spark):
    import random

    r = random.Random(0)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {(x.query_id, x["rank"]): x.id for x in search.dense_top_k(df, df.where("id % 20 = 0"), 3, block=2).collect()}
    ok = [x for x in rows if x[1] and len(x[1]) == 8]
    for q, v in ok:
        if q % 20 == 0:
            best = sorted(((sum(a * b for a, b in zip(v, w)), -i) for i, w in ok), reverse=True)[:3]
            assert [got[q, k] for k in (1, 2, 3)] == [-i for _, i in best]
    assert search.dense_top_k(df, df.limit(0), 3).count() == 0


def test_hashed_vectors_are_units(spark):
    import hashlib

    df = spark.createDataFrame([(1, "abc abc"), (2, "abc"), (3, None), (4, "")], "id int, t string")
    v = {r.id: r.vector for r in search.hashed_vectors(df, "id", text.char_ngrams(F.col("t"))).collect()}
    assert set(v) == {1, 2} and all(abs(sum(x * x for x in w) - 1) < 1e-9 for w in v.values())
    want = [0.0] * 768
    for n in (2, 3, 4):
        for i in range(len("abcabc") - n + 1):
            h = hashlib.md5("abcabc"[i : i + n].encode()).digest()
            want[int.from_bytes(h[:4], "big") % 768] += 1 if h[4] % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in want))
    assert all(abs(a - b / norm) < 1e-9 for a, b in zip(v[1], want))


def test_case_bonus_counts_parts_of_a_number_once(spark):
    docs = spark.createDataFrame([(1, "253/2026"), (2, "3/2026"), (3, None), (4, "9/2020")], "id int, n string")
    q = spark.createDataFrame([(1, ["3/2026", "253/2026"]), (2, ["7/1999"]), (3, [])], "query_id int, refs array<string>")
    s = spark.createDataFrame([(1, 1, 0.5), (1, 4, 0.25), (2, 2, 1.0)], "query_id int, id int, score double")
    got = {(r.query_id, r.id): r.score for r in search.case_bonus(s, docs, "id", F.col("n"), q, F.col("refs")).collect()}
    assert got == {(1, 1): 4.5, (1, 2): 4.0, (1, 4): 0.25, (2, 2): 1.0}


def test_many_query_terms_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(DOCS, "id int, t string")
    q = spark.createDataFrame([(1, "recurso recurso civil"), (2, "ausente")], "query_id int, q string")
    toks = F.filter(F.split(F.col("t"), " "), lambda x: x != "")
    run = lambda: {r.id: round(r.score, 9) for r in search.bm25(df, "id", {"a": toks}, {"a": 2.0}, q, F.split("q", " ")).collect()}
    few = run()
    monkeypatch.setattr(search, "LITERAL_TERMS", 0)
    assert run() == few and set(few) == {1, 2, 6}


def test_capped_fallback_keeps_its_order(spark):
    e = spark.createDataFrame([], "query_id int, id int, ord int")
    f = spark.createDataFrame([(1, 5, 5, 12.0), (1, 4, 4, 11.0), (1, 3, 3, 2.0)], "query_id int, id int, ord int, score double")
    assert [r.id for r in search.exact_with_fallback(e, f, 5).orderBy("rank").collect()] == [5, 4, 3]


def test_numbers_of_a_hot_key(spark):
    from foliant.operators.ranks import numbered

    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    got = numbered(df, ["k"], [F.col("o").desc()], "n").collect()
    assert len(got) == 5000
    for key in ("hot", "b", None):
        rows = sorted((r for r in got if r.k == key), key=lambda r: -r.o)
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1, 10), (1, 11, 2, 11)], "query_id int, id int, rank int, ord int")
    b = spark.createDataFrame([(1, 11, 1, 11)], "query_id int, id int, rank int, ord int")
    assert [r.id for r in search.fused([a, b], 5).orderBy("rank").collect()] == [11, 10]


def ref_chunks(t):
    paras = [p.strip() for p in t.split("\n\n") if p.strip()]
    out, buf = [], ""
    for p in paras:
        if len(p) > 1600:
            out += [buf] if buf else []
            buf = ""
            out += [p[i : i + 1200].strip() for i in range(0, len(p), 1200) if p[i : i + 1200].strip()]
        elif len(buf) + 2 * bool(buf) + len(p) <= 1200:
            buf = f"{buf}\n\n{p}" if buf else p
        else:
            out += [buf] if buf else []
            buf = p
    return out + ([buf] if buf else [])


def test_chunks_at_the_limits(spark):
    texts = ["", "   ", "a" * 1200, "a" * 1201, "a" * 1600, "a" * 1601, "a" * 600 + "\n\n" + "b" * 598, "a" * 600 + "\n\n" + "b" * 599, "x\n\n" + "y" * 5000 + "\n\nz", None]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "ord int, t string, chunk_text string")
    got = [r.c for r in df.select(chunking.chunks(F.col("t")).alias("c")).collect()]
    assert got[:-1] == [ref_chunks(t) for t in texts[:-1]] and not got[-1]


def test_chunk_id(spark):
    import hashlib

    df = spark.createDataFrame([("1/2020", None, "pt", 0, "texto")], "a string, b string, c string, d int, e string")
    want = "1_2020_pt_c0000_" + hashlib.sha1(b"1/2020||pt|0|texto").hexdigest()[:12]
    assert df.select(chunking.chunk_id(*[F.col(c) for c in "abcde"]).alias("x")).first().x == want
