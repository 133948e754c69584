from pyspark.sql import functions as F

from foliant.operators import dedupe, lookup


def test_first_and_last_win_with_null_keys(spark):
    rows = [(3, "a", None), (1, "a", None), (2, "b", "x"), (4, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "ord int, k string, v string")
    assert {r.ord for r in dedupe.first_wins(df, [F.col("k"), F.col("v")], F.col("ord")).collect()} == {1, 2, 4}
    assert {r.ord for r in dedupe.last_wins(df, [F.col("k")], F.col("ord")).collect()} == {3, 2, 5}
    assert dedupe.first_wins(df.limit(0), [F.col("k")], F.col("ord")).count() == 0


def test_reasons(spark):
    df = spark.createDataFrame([(1, "x", "A"), (2, "x", "B"), (3, "", "B"), (4, None, "A"), (5, "y", "B")], "ord int, sid string, court string")
    got = {r.grp: tuple(r)[1:] for r in dedupe.reason_counts(df, F.col("sid"), F.col("ord"), F.col("court")).collect()}
    assert got == {"A": (2, 1, 1, 0), "B": (3, 1, 1, 1)}


def test_duplicate_key_cascade(spark):
    df = spark.createDataFrame([("HTTP://X.example/a/", None, "p", "c"), (None, "", "P.example", "c"), (None, None, None, "c")], "a string, b string, p string, c string")
    k = dedupe.duplicate_key(F.array("a", "b"), F.array("p"), F.col("c"))
    assert [r.k for r in df.select(k.alias("k")).collect()] == ["text:http://x.example/a", "pdf:https://p.example", "meta:c"]


def test_unique_suffix_and_merge(spark):
    df = spark.createDataFrame([(1, "g", "s"), (2, "g", "s"), (3, "h", "s")], "ord int, g string, s string")
    assert {(r.ord, r.s) for r in dedupe.unique_suffix(df, ["g"], "ord", "s").collect()} == {(1, "s"), (2, "s__dup2"), (3, "s")}
    hits = spark.createDataFrame([("c", 1.0, "q2", 2, "B"), ("c", 3.0, "q1", 1, "A"), ("c", 2.0, "q2", 3, "C")], "chunk_id string, score double, subquery string, hit_ord int, a string")
    r = dedupe.merge_hits(hits, ["a"]).first()
    assert (r.score, r.a, r.matched_subqueries) == (3.0, "A", ["q1", "q2"])


def test_page_signatures(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "c")], "page int, k string")
    assert {(r.page, r.repeats_earlier) for r in dedupe.page_signatures(df, ["page"], "k").collect()} == {(1, False), (2, True), (3, False)}


def test_attach_last_wins_and_default(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a", "old", 1), ("a", None, 2), ("", "z", 3)], "k string, v string, ord int")
    got = {r.k: (r.v, r.attached) for r in lookup.attach(left, right, "k", ["v"], "ord").collect()}
    assert got == {"a": ("", True), "b": ("", False), None: ("", False)}


def test_priorities_keys_and_status(spark):
    df = spark.createDataFrame([("", "b", "c"), (" ", None, ""), ("a", "b", "c")], "x string, y string, z string")
    v, s = lookup.first_value(("m", F.col("x")), ("n", F.col("y")), ("o", F.col("z")))
    assert [tuple(r) for r in df.select(v, s).collect()] == [("b", "n"), ("", "empty"), ("a", "m")]
    left = spark.createDataFrame([("1", "u1"), ("2", "u2"), (None, "u3")], "sid string, url string")
    a = spark.createDataFrame([("1", "A")], "sid string, h string")
    b = spark.createDataFrame([("u1", "B"), ("u2", "C")], "url string, h string")
    assert {r.url: r.h for r in lookup.two_keys(left, a, b, "sid", "url", "h").collect()} == {"u1": "A", "u2": "C", "u3": None}
    x = spark.createDataFrame([("k", ("v", ""), ("v", "w")), ("l", ("v", "q"), None)], "key string, b struct<f:string,g:string>, m struct<f:string,g:string>")
    got = {(r.key, r.field_name): r.status for r in lookup.field_status(x, ["f", "g"], "b", "m").collect()}
    assert got == {("k", "f"): "match", ("k", "g"): "baseline_missing_field", ("l", "f"): "model_pending", ("l", "g"): "model_pending"}


def test_coverage_and_exact(spark):
    keys = spark.createDataFrame([("1",), ("2",), ("3",)], "k string")
    s1, s2 = spark.createDataFrame([("1",), ("1",)], "k string"), spark.createDataFrame([("1",), ("2",)], "k string")
    assert {r.resolved_by: r["keys"] for r in lookup.coverage(keys, "k", {"a": s1, "b": s2}).collect()} == {"a": 1, "b": 1, "unresolved": 1}
    rows = spark.createDataFrame([("C", "1", 2, "late"), ("c", "1", 1, "early")], "code string, no string, prio int, t string")
    q = spark.createDataFrame([("c", "1"), ("c", "9")], "qc string, qn string")
    got = lookup.exact(q, rows, [F.lower("code"), F.col("no")], [F.lower("qc"), F.col("qn")], F.col("prio"))
    assert {r.qn: r.hit and r.hit.t for r in got.collect()} == {"1": "early", "9": None}
