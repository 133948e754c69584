"""Queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

from . import encoding, leakage, one_form, pieces, sentences, spam, survivor, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every chunk."""
    return sentences.sentence_units(table(spark, d, "case_chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one table that look the same and are spelled differently."""
    parts = [("case_chunks", "chunk_text"), ("research_result_items", "case_summary")]
    found = [
        one_form.look_alike_pairs(table(spark, d, t), text_col=c).select(F.lit(t).alias("table_name"), "ord_a", "ord_b") for t, c in parts
    ]
    return found[0].unionByName(found[1])


def p2_one_form(spark: SparkSession, d: str) -> DataFrame:
    """Every summary in its one form."""
    return one_form.one_form(table(spark, d, "research_result_items"), text_col="case_summary").select("ord", "one_form")


def p2_chunk_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in its one form."""
    return one_form.one_form(table(spark, d, "case_chunks"), text_col="chunk_text").select("ord", "one_form")


def p2_readable_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every summary in the readable form: look-alike letters only put right inside words of mixed script."""
    return one_form.one_form(table(spark, d, "research_result_items"), text_col="case_summary").select("ord", "readable_form")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The row whose value survives, per group and field."""
    merged = survivor.merge_row_survivors(table(spark, d, "merge_case_rows"))
    metadata = survivor.metadata_survivors(table(spark, d, "case_metadata"), table(spark, d, "source_trust"))
    return merged.select(F.lit("merge_case_rows").alias("table_name"), "sentence_id", "field_name", "ord").unionByName(
        metadata.select(F.lit("case_metadata").alias("table_name"), "sentence_id", "field_name", "ord")
    )


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per decision of case_metadata."""
    rows = table(spark, d, "case_metadata")
    return survivor.surviving_records(rows, survivor.metadata_survivors(rows, table(spark, d, "source_trust")), survivor.METADATA_FIELDS)


def p3_merge_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per decision of merge_case_rows."""
    rows = table(spark, d, "merge_case_rows")
    return survivor.surviving_records(rows, survivor.merge_row_survivors(rows), survivor.MERGE_FIELDS)


def _p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    previews = truncation.field_values(table(spark, d, "citation_records"), 0, "retrieval_source", "chunk_text_preview")
    summaries = truncation.field_values(table(spark, d, "research_result_items"), 1, "metadata_source", "case_summary")
    return truncation.cut_values({"citation_records": previews, "research_result_items": summaries})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that were cut off."""
    return _p4_verdicts(spark, d).where("cut").select("table_name", "ord")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut values per source."""
    return truncation.cut_shares(_p4_verdicts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut: those with a second piece."""
    return pieces.oversized_pieces(table(spark, d, "case_chunks")).where("piece_no = 1").select("ord")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return pieces.oversized_pieces(table(spark, d, "case_chunks"))


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized chunk put together again from its pieces: digest, whether all are within the limit, whether all overlaps are exact."""
    x = pieces.oversized_pieces(table(spark, d, "case_chunks"))
    g = x.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_at", "end_at", "piece_text"))).alias("p"))
    again = F.array_join(F.transform("p", lambda r, i: F.when(i == 0, r["piece_text"]).otherwise(F.substr(r["piece_text"], F.lit(pieces.OVERLAP + 1)))), "")
    exact = F.forall(F.sequence(F.lit(2), F.size("p")), lambda i: F.element_at("p", i)["start_at"] == F.element_at("p", i - 1)["end_at"] - pieces.OVERLAP)
    return g.select("ord", F.md5(again).alias("digest"), F.forall("p", lambda r: F.length(r["piece_text"]) <= pieces.LIMIT).alias("within_limit"), exact.alias("overlap_exact"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document back from its ids."""
    return encoding.decode(encoding.encode(table(spark, d, "documents")), encoding.pieces(spark))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return got.where(F.col("slots_equal") >= leakage.SLOTS).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked: documents, longest share, re-parameterised copies."""
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return got.groupBy("item_id").agg(
        F.count("*").alias("documents"),
        F.round(F.max("share"), 3).alias("longest_share"),
        F.count_if(F.col("slots_equal") < leakage.SLOTS).alias("reparameterised"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, link and tag pages."""
    return spam.spam_pages(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_one_form, p2_chunk_forms, p2_readable_forms, p3_found, p3_records, p3_merge_records, p4_found, p4_shares, p6_found, p6_pieces, p6_cover, p7_ids, p7_decoded, p8_found, p8_items, p9_found)
}

_VALUE = "({0} IS NOT NULL AND lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || '　')) NOT IN ({1}))"
_MARKS = ", ".join("'" + m + "'" for m in survivor.NO_VALUE)


def _p3_sql(name: str, fields: tuple[str, ...], time: str, trust: str) -> str:
    key = "regexp_replace(translate(sentence_id, '０１２３４５６７８９', '0123456789'), '\\s', '', 'g')"
    key = f"regexp_replace(regexp_replace({key}, '[?#].*$', ''), '\\.0+$', '')"
    key = f"ltrim(regexp_extract({key}, '([0-9]+)$', 1), '0')"
    src = f"SELECT *, {key} AS k, {trust} AS tr, count(*) OVER (PARTITION BY {key}) AS n FROM {name} t"
    one = [
        f"SELECT '{name}' AS table_name, k AS sentence_id, '{f}' AS field_name, ord FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY k ORDER BY tr DESC, {time} DESC NULLS LAST, ord) AS rn FROM ({src}) WHERE k <> '' AND n > 1 AND {_VALUE.format(f, _MARKS)}) WHERE rn = 1"
        for f in fields
    ]
    return " UNION ALL ".join(one)


_TRUST = (
    "coalesce((SELECT max(trust) FROM source_trust s WHERE s.metadata_source = regexp_replace(lower(trim(t.metadata_source)), '[-_ ]+', '_', 'g')), -1)"
)

ORACLE_SQL: dict[str, str] = {
    "p3_found": _p3_sql("merge_case_rows", survivor.MERGE_FIELDS, "ingested_at", "0")
    + " UNION ALL "
    + _p3_sql("case_metadata", survivor.METADATA_FIELDS, "generated_at", _TRUST),
    "p6_found": "SELECT ord FROM case_chunks WHERE length(chunk_text) > 1600",
    "p6_cover": "SELECT ord, md5(chunk_text) AS digest, true AS within_limit, true AS overlap_exact FROM case_chunks WHERE length(chunk_text) > 1600",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def _by_sign(relation: str, column: str) -> str:
    """(ord, raw, c): the one form of every value, sign by sign through a map, by another way than the operator's."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    table = {k: v for k, v in one_form.ONE_FORM.items()}
    pairs = "MAP([" + ", ".join(map(q, table)) + "], [" + ", ".join(map(q, table.values())) + "])"
    bad = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F" + one_form.INVISIBLE_CLASS + "]"
    joiner = f"regexp_replace(regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), {q(one_form.JOINED)}, {q(one_form.KEPT)}, 'g'), {q(one_form.JOINED)}, {q(one_form.KEPT)}, 'g')"
    clean = f"replace(regexp_replace({joiner}, {q(bad)}, '', 'g'), {q(one_form.STAND_IN)}, chr(8204))"
    return f"SELECT ord, {column} AS raw, nfc_normalize(array_to_string(list_transform(string_split({clean}, ''), lambda x: coalesce(m[x], x)), '')) AS c FROM (SELECT *, {pairs} AS m FROM {relation})"


def _p2_sql() -> str:
    def pairs(name: str, col: str) -> str:
        forms = _by_sign(f"(SELECT * FROM {name} WHERE {col} IS NOT NULL)", col)
        f = f"(SELECT ord, raw, c FROM ({forms}) WHERE trim(c, ' ' || chr(10)) <> '')"
        return f"SELECT '{name}' AS table_name, a.ord AS ord_a, b.ord AS ord_b FROM {f} a JOIN {f} b ON a.c = b.c AND a.ord < b.ord AND a.raw <> b.raw"

    return pairs("case_chunks", "chunk_text") + " UNION ALL " + pairs("research_result_items", "case_summary")


ORACLE_SQL["p2_found"] = _p2_sql()
ORACLE_SQL["p2_one_form"] = f"SELECT ord, c AS one_form FROM ({_by_sign('research_result_items', 'case_summary')})"
ORACLE_SQL["p2_chunk_forms"] = f"SELECT ord, c AS one_form FROM ({_by_sign('case_chunks', 'chunk_text')})"
ORACLE_SQL["p3_records"] = (
    "WITH f AS (" + ORACLE_SQL["p3_found"] + "), g AS (SELECT sentence_id, field_name, ord FROM f WHERE table_name = 'case_metadata'), v AS (SELECT ord, "
    + ", ".join(f"any_value({c}) AS {c}" for c in survivor.METADATA_FIELDS)
    + " FROM case_metadata GROUP BY ord) SELECT sentence_id, "
    + ", ".join(f"max(CASE WHEN field_name = '{c}' THEN {c} END) AS {c}" for c in survivor.METADATA_FIELDS)
    + " FROM g JOIN v USING (ord) GROUP BY sentence_id"
)
ORACLE_SQL["p3_merge_records"] = (
    "WITH f AS (" + ORACLE_SQL["p3_found"] + "), g AS (SELECT sentence_id, field_name, ord FROM f WHERE table_name = 'merge_case_rows'), v AS (SELECT ord, "
    + ", ".join(f"any_value({c}) AS {c}" for c in survivor.MERGE_FIELDS)
    + " FROM merge_case_rows GROUP BY ord) SELECT sentence_id, "
    + ", ".join(f"max(CASE WHEN field_name = '{c}' THEN {c} END) AS {c}" for c in survivor.MERGE_FIELDS)
    + " FROM g JOIN v USING (ord) GROUP BY sentence_id"
)
