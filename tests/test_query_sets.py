import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import research, search
from foliant.plans import retrieval


def tokens(c):
    return F.filter(F.split(F.col(c), " "), lambda x: x != "")


@pytest.mark.parametrize("literal", [20_000, 0])
def test_best_of_many_queries_are_those_of_bm25(spark, monkeypatch, literal):
    r = random.Random(1)
    some = lambda n: " ".join(r.choice("abcdefgh") if r.random() < 0.7 else f"t{r.randrange(60)}" for _ in range(n))
    docs = spark.createDataFrame([(i, some(r.randrange(7)), some(r.randrange(3)) if i % 5 else None) for i in range(400)], "id int, t string, u string").repartition(3)
    texts = [some(r.randrange(5)) for _ in range(40)]
    asked = spark.createDataFrame([(i, texts[i % 40]) for i in range(60)] + [(60, "nowhere"), (61, "")], "query_id int, q string")
    fields, weights = {"t": tokens("t"), "u": tokens("u")}, {"t": 1.5, "u": 4.0}
    monkeypatch.setattr(search, "LITERAL_TERMS", literal)
    want = search.top_k(search.bm25(docs, "id", fields, weights, asked, tokens("q")).withColumn("score", F.round("score", 9)), 4, "id")
    want = {(x.query_id, x["rank"]): (x.id, round(x.score, 8)) for x in want.collect()}
    monkeypatch.setattr(search, "FORMS", 7)  # several blocks of forms, slices of rows and passes
    monkeypatch.setattr(search, "CELLS", 7 * 90)
    for block, product in ((0, 50), (16, 1), (0, 10**6)):
        monkeypatch.setattr(search, "PRODUCT", product)
        got = search.bm25_top_k(docs, "id", fields, weights, asked, tokens("q"), 4, block=block).collect()
        assert len(got) == len(want) and {(x.query_id, x["rank"]): (x.id, round(x.score, 8)) for x in got} == want


def test_no_query_of_a_set_that_no_document_answers(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, t string")
    for q in ([(1, "b")], [(1, "")], []):
        asked = spark.createDataFrame(q, "query_id int, q string")
        assert search.bm25_top_k(docs, "id", {"t": tokens("t")}, {"t": 1.0}, asked, tokens("q"), 4).count() == 0


CHUNKS = [(1, "1/2020"), (2, "1/2020"), (3, "01/2020"), (4, "2/2020"), (5, None), (6, "77/2020")]


def test_only_queries_without_enough_exact_rows_are_ranked(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, n, f"texto {n or ''}") for i, n in CHUNKS], "ord bigint, authoritative_case_number string, chunk_text string").write.parquet(f"{tmp_path}/case_chunks.parquet")
    ranked, plain = [], getattr(search, "bm25_top_k", None)

    def rows(*a, **k):
        raise AssertionError("every query meets every document as a row")

    def watched(docs, i, fields, weights, queries, *a, **k):
        ranked.extend(r.query_id for r in queries.collect())
        return plain(docs, i, fields, weights, queries, *a, **k)

    monkeypatch.setattr(search, "bm25", rows)
    monkeypatch.setattr(search, "bm25_top_k", watched, raising=False)
    asked = spark.createDataFrame([(10, "1/2020"), (11, "2/2020"), (12, "texto"), (13, "9/1999")], "query_id bigint, query string")
    got = {}
    for r in retrieval.exact_search(spark, str(tmp_path))(asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.source))
    assert sorted(ranked) == [11, 12, 13]
    assert [x[0] for x in got[10]] == [1, 2, 3] and got[11][0] == (4, "exact") and len(got[11]) == 3 and got[11][1][1] == "fallback"
    assert [x[0] for x in got[12]] == [5, 1, 2] and 13 not in got


def test_only_branches_that_are_taken_are_run(spark):
    routed = spark.createDataFrame([(1, "1/2020", "exact_case_number_heavy_bm25", False)], "query_id bigint, normalized_query string, retrieval_mode string, decomposition_recommended boolean")
    found = lambda asked, k: asked.select("query_id", F.lit(7).alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    def never(asked, k):
        raise AssertionError("the documents are indexed for no query")

    assert [(r.query_id, r.id, r.path) for r in research.by_route(routed, found, never, 3).collect()] == [(1, 7, "exact")]
    assert research.by_route(routed.limit(0), never, found, 3).count() == 0
    both = routed.unionByName(spark.createDataFrame([(2, "a", "conservative_direct_bm25", False)], routed.schema))
    assert {(r.query_id, r.path) for r in research.by_route(both, found, found, 3).collect()} == {(1, "exact"), (2, "direct")}
