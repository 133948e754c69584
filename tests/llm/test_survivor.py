import datetime as dt

from foliant.llm import survivor

T0 = dt.datetime(2025, 1, 1)
META = "ord bigint, sentence_id string, court string, case_type string, case_summary string, holding string, pdf_url string, metadata_source string, generated_at timestamp, trust string"
TRUST = [("model_generated", 40), ("deterministic_v1", 30)]


def best(rows):
    """Brute force: (field, ord) per group."""
    rank = dict(TRUST)
    groups, out = {}, set()
    for r in rows:
        digits = "".join(c for c in (r[1] or "").split("?")[0].replace("１", "1") if c.isdigit()).lstrip("0")
        if digits:
            groups.setdefault(digits, []).append(r)
    for key, rs in groups.items():
        for f, name in enumerate(survivor.METADATA_FIELDS, 2):
            ok = [r for r in rs if r[f] is not None and r[f].strip().lower() not in survivor.NO_VALUE]
            if len(rs) > 1 and ok:
                src = lambda r: rank.get((r[7] or "").strip().lower().replace("-", "_"), -1)
                out.add((key, name, min(ok, key=lambda r: (-src(r), -(r[8] or dt.datetime(1, 1, 2)).timestamp() if r[8] else 1e18, r[0]))[0]))
    return out


def test_metadata_against_brute_force(spark):
    h = dt.timedelta(hours=1)
    rows = [
        (1, "100", "A", "-", "s", None, "u", "Model-Generated ", T0, "x"),
        (2, "ID:100", "B", "t", "N/A", "h", None, "deterministic_v1", T0 + h, None),
        (3, "/sentence/PT/100?q=1", "C", " ", "s3", "h3", "null", None, T0 + 5 * h, ""),
        (3, "/sentence/PT/100?q=1", "C", " ", "s3", "h3", "null", None, T0 + 5 * h, ""),
        (4, "00000200", "D", "t", "s", "h", "u", "legacy", None, ""),
        (5, "１1", "E", None, None, None, None, None, T0, ""),
        (6, "11", None, None, None, None, None, None, T0, ""),
        (7, "200", "D2", None, "s", "h", "u", "legacy", T0, ""),
        (8, "200", "D3", None, "s", "h", "u", "other", T0, ""),
        (9, None, "F", "t", "s", "h", "u", "model_generated", T0, ""),
        (10, "", "F", "t", "s", "h", "u", "model_generated", T0, ""),
        (11, "300", "G", "t", "s", "h", "u", "model_generated", T0, ""),
    ]
    df = spark.createDataFrame(rows, META)
    trust = spark.createDataFrame(TRUST, "metadata_source string, trust int")
    got = {(r.sentence_id, r.field_name, r.ord) for r in survivor.metadata_survivors(df, trust).collect()}
    assert got == best(rows)
    one = survivor.surviving_records(df, survivor.metadata_survivors(df, trust), survivor.METADATA_FIELDS)
    rec = {r.sentence_id: r for r in one.dropDuplicates().collect()}
    assert rec["100"].court == "A" and rec["100"].case_type == "t" and rec["100"].holding == "h"
    assert survivor.metadata_survivors(df.limit(0), trust).count() == 0


def test_identity_forms(spark):
    from pyspark.sql import functions as F

    forms = ["100343", " 100343 ", "100343\n", "１００３４３", "100343.0", "ID:100343", "00100343", "https://x.example/sentence/zh/100343", "/sentence/PT/100343?q=1"]
    df = spark.createDataFrame([(f,) for f in forms], "s string")
    assert {r.k for r in df.select(survivor.sentence_key(F.col("s")).alias("k")).collect()} == {"100343"}


def test_merge_rows_latest_then_smallest(spark):
    rows = [(1, "5", "1/2020", None, "A", None, "x", T0), (2, "5", "2/2020", None, "A", None, None, T0), (3, "5", None, None, "A", None, "z", None)]
    df = spark.createDataFrame(rows, "ord bigint, sentence_id string, authoritative_case_number string, authoritative_decision_date string, court string, case_type string, full_text string, ingested_at timestamp")
    got = {(r.field_name, r.ord) for r in survivor.merge_row_survivors(df).collect()}
    assert got == {("authoritative_case_number", 1), ("court", 1), ("full_text", 1)}


def test_merge_rows_come_out_as_records(spark, tmp_path):
    from foliant.llm.queries import QUERIES

    rows = [(1, "5", "1/2020", None, "A", None, "x", T0), (2, "5", "2/2020", "-", "B", None, None, T0 - dt.timedelta(hours=1)), (3, "005", None, "2020-01-02", "C", None, "z", None), (4, "6", "9/2020", None, "D", None, "y", T0)]
    df = spark.createDataFrame(rows, "ord bigint, sentence_id string, authoritative_case_number string, authoritative_decision_date string, court string, case_type string, full_text string, ingested_at timestamp")
    df.write.parquet(f"{tmp_path}/merge_case_rows.parquet")
    got = [tuple(r) for r in QUERIES["p3_merge_records"](spark, str(tmp_path)).collect()]
    assert got == [("5", "1/2020", "2020-01-02", "A", None, "x")]


def test_layers_are_peeled(spark):
    from pyspark.sql import functions as F

    hour = dt.timedelta(hours=1)
    # (trust, time): 3,5 and 1,6 are undominated, 2,3 is under the first; the last three hold fewer fields
    rows = [(1, "9", "A", "b", T0 + 5 * hour, 3), (2, "9", "A", "b", T0 + 3 * hour, 2), (3, "9", "A", "b", T0 + 6 * hour, 1), (4, "9", "A", None, T0 + 4 * hour, 2), (5, "9", None, "b", T0 + 9 * hour, 0), (6, "9", None, "-", None, 0)]
    df = spark.createDataFrame(rows, "ord bigint, sentence_id string, x string, y string, at timestamp, trust int")
    got = survivor.layers(df, ("x", "y"), "at", F.col("trust")).collect()[0].records

    def dominates(a, b):
        held = lambda r: {i for i in (2, 3) if r[i] not in (None, "-")}
        when = lambda r: (r[4] or dt.datetime(1, 1, 1), -r[0])
        return held(a) >= held(b) and a[5] >= b[5] and when(a) >= when(b) and a is not b

    rest, brute, layer = list(rows), {}, 0
    while rest:
        front = [r for r in rest if not any(dominates(o, r) for o in rest)]
        brute |= {r[0]: layer for r in front}
        rest, layer = [r for r in rest if r not in front], layer + 1
    assert {r.ord: r.layer for r in got} == brute
    assert (brute[1], brute[2], brute[3]) == (0, 1, 0)


def test_a_hot_group_leaves_a_bounded_number_of_records(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.col("id").alias("ord"), F.lit("7").alias("sentence_id"), F.when(F.col("id") % 3 > 0, "x").alias("a"), F.when(F.col("id") % 2 > 0, "y").alias("b"), F.timestamp_seconds("id").alias("at"))
    assert survivor.best_records(df, ("a", "b"), "at", F.lit(1)).count() == 4
    assert {(r.field_name, r.ord) for r in survivor.survivors(df, ("a", "b"), "at", F.lit(1)).collect()} == {("a", 19_999), ("b", 19_999)}
