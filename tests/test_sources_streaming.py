import json

import pytest
from pyspark.sql import functions as F

from foliant.sources import corpus, jsonl
from foliant.streaming import crawl


@pytest.fixture()
def lines(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "n": 1}\n\n{"id": " 2 "}\nbroken {\n[1]\n{"id": ""}\n')
    return str(p)


def test_json_lines(spark, lines, tmp_path):
    assert {r.id for r in jsonl.lenient(spark, lines, "id string, n int").collect()} == {"1", " 2 ", ""}
    assert jsonl.lenient(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    assert {r.id for r in jsonl.done_ids(spark, lines, "id").collect()} == {"1", "2"}
    assert {r.line_no for r in jsonl.bad_lines(spark, lines).collect()} == {4, 5}
    with pytest.raises(Exception):
        jsonl.strict(spark, lines, "id string, n int").collect()
    with pytest.raises(Exception):
        jsonl.required(spark.createDataFrame([(None,)], "a string"), ["a"]).collect()
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert jsonl.document(spark, str(doc), "a int").count() == 2


def test_corpus_layout_write_and_resume(spark, tmp_path):
    rows = [(1, "pt", "1/2020", "05/03/2020", "a\nb"), (2, "pt", "1/2020", "06/03/2020", "c"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "ord bigint, language string, authoritative_case_number string, authoritative_decision_date string, full_text string")
    assert {(r["ord"], r.case_slug) for r in corpus.layout(df).collect()} == {(1, "1_2020"), (2, "1_2020__dup2"), (3, "unknown_case_0003")}
    out = str(tmp_path / "c")
    corpus.write(df, out, collapse=True)
    back = spark.read.parquet(out)
    assert back.where("year = '2020'").count() == 2 and back.where("ord = 1").first().full_text == "a b"
    new = str(tmp_path / "n")
    corpus.write_new(df.where("ord < 3"), new, "ord")
    corpus.write_new(df, new, "ord")
    assert spark.read.parquet(new).count() == 3
    assert {r.line for r in corpus.report(df.agg(F.count("*").alias("rows"))).collect()} == {"rows: 3"}


def test_point_reads(spark, tmp_path):
    p = tmp_path / "cases" / "pt" / "2020" / "a"
    p.mkdir(parents=True)
    (p / "full_text.txt").write_text("linha 1\nlinha 2")
    m = spark.createDataFrame([("cases/pt/2020/a/full_text.txt", 1), ("cases/pt/2020/b/full_text.txt", 2)], "full_text_path string, ord int")
    ok, skipped = corpus.read_files(spark, str(tmp_path), m)
    assert ok.first().full_text == "linha 1\nlinha 2" and [r["ord"] for r in skipped.collect()] == [2]


def test_seen_set_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 1), ("b", 1), ("a", 2), (None, 2), ("c", 3), ("s", 3)]
    df = spark.createDataFrame(rows, "sid string, r int")
    for i in (1, 2, 3):
        df.where(F.col("r") == i).write.mode("append").json(str(src))
    stream = spark.readStream.schema("sid string, r int").json(str(src))
    seen = spark.createDataFrame([("s",)], "sid string")
    q = crawl.append_batches(crawl.unseen(stream, "sid", seen), str(tmp_path / "out"), str(tmp_path / "cp"), "sid")
    q.awaitTermination()
    assert sorted(r.sid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_rounds_converge_and_pages_repeat(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "b"), (5, None)], "round int, sid string")
    got = {r["round"]: (r.new_keys, r.quiet_rounds, r.decision) for r in crawl.convergence(crawl.new_per_round(df, "round", "sid"), "round").collect()}
    assert got == {1: (1, 0, "go_on"), 2: (1, 0, "go_on"), 3: (0, 1, "go_on"), 4: (0, 2, "converged"), 5: (0, 3, "converged")}
    pages = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (5, "y"), (6, "x")], "p int, s string")
    assert {r.p: r.stop_here for r in crawl.repeated_pages(pages, "p", "s").collect()} == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False}
