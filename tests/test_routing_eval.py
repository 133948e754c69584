from pyspark.sql import functions as F

from foliant.functions import queries
from foliant.operators import cards, evaluation, quality, routing

LABELS = [
    ("假釋", "ambiguous_or_noisy"),  # two signs are too short
    ("關於假釋", "single_legal_concept"),
    ("253/2026", "case_number_lookup"),
    ("processo 253/2026", "case_number_lookup_pt_mixed"),
    ("liberdade condicional", "portuguese_or_mixed"),
    ("被告的上訴理由", "mixed_fact_legal_query"),
    ("量刑與緩刑的問題", "multi_issue_legal_query"),
    ("???", "ambiguous_or_noisy"),
    ("", "ambiguous_or_noisy"),
]


def test_routes(spark):
    df = spark.createDataFrame(LABELS, "query string, want string")
    for r in routing.route(df).collect():
        assert r.query_type == r.want, r
        assert r.routing_strategy and r.decomposition_recommended is not None


def test_subqueries(spark):
    df = spark.createDataFrame([("量刑過重，緩刑及上訴",), ("",)], "q string")
    got = [r.s for r in df.select(queries.subqueries(F.col("q")).alias("s")).collect()]
    assert got[0] == ["量刑過重，緩刑及上訴", "量刑過重 緩刑及上訴", "量刑過重", "量刑過重 緩刑 上訴", "緩刑", "上訴"] and got[1] == [""]
    assert [r.s for r in df.select(queries.subqueries(F.col("q"), decompose=False).alias("s")).collect()] == [["量刑過重，緩刑及上訴"], [""]]


def test_paths_and_signals(spark):
    df = spark.createDataFrame([("processo 253/2026",), ("liberdade condicional e recurso ou pena",), ("假釋的上訴及緩刑與量刑",), ("???",)], "query string")
    x = routing.route(df).withColumn("summary", routing.signal_summary())
    mode, more = F.col("retrieval_mode"), F.col("decomposition_recommended")
    got = [tuple(r) for r in x.select(routing.execution(mode, more), routing.execution(mode, more, False), routing.well_routed(F.col("summary"), F.col("normalized_query"), F.col("query_type"), F.col("routing_strategy"))).collect()]
    assert got == [("exact", "direct", True), ("fan_out", "fan_out", True), ("fan_out", "fan_out", True), ("direct", "direct", True)]
    first = x.first().summary
    assert first.startswith("pt_lexicon_hits=1[processo]") and "case_number=True" in first and "mixed_language=False" in first


def test_rules_and_overlap(spark):
    df = spark.createDataFrame([(["1/2020", "2/2020"],), ([],)], "cases array<string>")
    rule = lambda t, k: F.struct(F.lit(t).alias("rule_type"), F.lit(k).alias("rank"), F.lit(k).alias("top_k"), F.lit("2/2020").alias("case_number"), F.array(F.lit("2/2020")).alias("case_numbers"))
    for t, k, want in (("case_number_at_rank", 2, True), ("case_number_at_rank", 1, False), ("case_number_in_top_k", 2, True), ("any_case_number_in_top_k", 1, False), ("other", 2, False)):
        assert [r.p for r in df.select(evaluation.pass_rule(rule(t, k), F.col("cases")).alias("p")).collect()] == [want, False]
    x = spark.createDataFrame([(["a", "b"], ["a"]), ([], []), ([], ["a"])], "e array<string>, p array<string>")
    assert [r.s for r in x.select(evaluation.set_overlap(F.col("e"), F.col("p")).alias("s")).collect()] == [0.5, 1.0, 0.0]
    y = spark.createDataFrame([("abc", "b"), (None, ""), ("a", None)], "e string, p string")
    assert [r.s for r in y.select(evaluation.containment(F.col("e"), F.col("p")).alias("s")).collect()] == [1.0, 1.0, 0.0]


def test_slices_keep_empty_ones(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "slice string, hit boolean")
    s = evaluation.slice_summary(df, ["a", "b", "c"])
    assert {r.slice: (r.queries, r.hit_rate, r.small) for r in s.collect()} == {"a": (2, 0.5, True), "b": (1, 1.0, True), "c": (0, 0.0, True)}
    r = evaluation.strongest_and_weakest(s).first()
    assert (r.strongest, r.weakest) == ("b", "a")


def test_quality(spark):
    df = spark.createDataFrame([("palavra " * 70,), ("curto 1/2020 01/02/2020",), (None,)], "t string")
    assert [r.x for r in df.select(quality.good_detail(F.col("t")).alias("x")).collect()] == [True, False, False]
    assert [r.x for r in df.select(quality.success(F.lit(0), F.lit(0)).alias("x")).limit(1).collect()] == [False]


def test_empty_results_have_an_envelope(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    c = spark.createDataFrame([(1, 1, "model_generated", 7), (1, 2, "", 8)], "query_id int, rank int, metadata_source string, ord int")
    got = {r.query_id: r for r in cards.envelope(c, q, 5).collect()}
    assert got[1].result_count == 2 and [x.ord for x in got[1].results] == [7, 8] and got[1].diagnostics.fallback_used == 1
    assert got[2].result_count == 0 and not got[2].diagnostics.success


def test_contaminated_cards(spark):
    rows = [("01/05/2018 129/2026 Processo sumário",), ("01/05/2018 129/2026 e 130/2026",), ("01/05/2018 02/05/2018 129/2026",), (None,), ("",), ("129/2026 129/2026",), ("CR1-19/2020 19/2020",), ("主題 " * 7,), ("主題 " * 6,), ("129/2026 Processo sumário",)]  # the end of a date reads as a case number too
    df = spark.createDataFrame(rows, "t string")
    assert [r.x for r in df.select(quality.contaminated(F.col("t")).alias("x")).collect()] == [True, True, True, True, True, True, True, True, False, False]


def test_evaluation_of_fields(spark):
    df = spark.createDataFrame([(["A, b", ""], ["a b"]), (["a"], ["a"]), ([], [])], "e array<string>, p array<string>")
    got = [tuple(r) for r in df.select(evaluation.normal_overlap(F.col("e"), F.col("p")), evaluation.exact_list(F.col("e"), F.col("p"))).collect()]
    assert got == [(1.0, 0.0), (1.0, 1.0), (1.0, 1.0)]
    x = spark.createDataFrame([(0.3, 0.2, 0.2)], "a double, b double, c double")
    assert x.select(evaluation.weakest({c: F.col(c) for c in "abc"}).alias("w")).first().w == "b"
    nested = spark.createDataFrame([(("x", ["a"]), 1), (("", []), None)], "s struct<t:string,l:array<string>>, n int")
    assert tuple(evaluation.populated_leaves(nested).first()) == (3, 6)
    one = spark.createDataFrame([("q1", 1), ("q2", None), ("q3", 2)], "q string, r int")
    two = spark.createDataFrame([("q1", None), ("q2", 3), ("q3", 1)], "q string, r int")
    assert {r.q: r.change for r in evaluation.before_after(one, two, "q", "r").collect()} == {"q1": "lost", "q2": "gained", "q3": "kept"}
    rates = evaluation.pass_rate(spark.createDataFrame([(True,), (False,)], "p boolean"), "p").first()
    assert tuple(rates) == (2, 1, 0.5) and evaluation.pass_rate(spark.createDataFrame([], "p boolean"), "p").first().pass_rate == 0.0
    ready = spark.createDataFrame([(["b", "a"], ["a", "b"], 1, 2, 3, 4), (["a"], ["b"], 1, 2, 3, 4), (["a"], ["a"], 0, 2, 3, 4)], "a array<string>, b array<string>, c int, d int, e int, f int")
    c = F.col
    assert [r.x for r in ready.select(evaluation.comparison_ready((c("a"), c("b")), (c("c"), c("d")), (c("e"), c("f"))).alias("x")).collect()] == [True, False, False]
