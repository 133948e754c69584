"""Best surviving record of each group of duplicates, field by field.

Skyline selection over whole records. A record is dominated when another of its
group is at least as complete, as trusted and as recent, and better in one of the
three; it is at least as complete when it has a value in every field the other has
one in. Peeling gives layers: layer 0 is undominated, layer n undominated once the
layers above are gone. The lexicographic policy (trust, recency, smallest ordinal)
orders each layer; the first record of layer 0 is the survivor, its nulls are
filled from the next of the layer and then from the layers below. Whoever holds
the most trusted and then latest value of a field is undominated, as a record that
dominated it would hold a better value; so the fill gives just that value.

Rows of one group that are equal in trust and in the fields they fill differ by
recency alone: of those only the most recent is kept, by a map-side ``max``. That
leaves at most (trust levels) x 2^(fields) records of a group however many copies
it holds, 5 x 32 for the given tables; these are peeled in one array.

Defined results: rows without an identity are in no group; groups of one row give
nothing; nulls, blanks and marks for "no value" never survive; a field without any
value gives no row; a null time is older than any time; ties go to the smallest
ordinal; unknown or missing sources rank below all listed ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that stand for "no value", lower case.
NO_VALUE = ("", "-", "--", "—", "–", "n/a", "na", "n.a.", "null", "none", "nil", "nan", "unknown", "undefined", "?", "無", "不詳", "s/n")
_FULL, _HALF = "０１２３４５６７８９／：．？＝＆ＩＤ", "0123456789/:.?=&ID"

MERGE_FIELDS = ("authoritative_case_number", "authoritative_decision_date", "court", "case_type", "full_text")
METADATA_FIELDS = ("court", "case_type", "case_summary", "holding", "pdf_url")


def has_value(c: Column) -> Column:
    """True where a text is neither null, blank nor a mark for "no value"."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    return c.isNotNull() & ~bare.isin(*NO_VALUE)


def sentence_key(c: Column) -> Column:
    """Identity as plain digits without leading zeros; null where there is none.

    Read from a bare number (padded, full-width, as a decimal, labelled) or from
    the path of a judgment address, query and fragment left aside.
    """
    s = F.translate(c, _FULL, _HALF)
    s = F.regexp_replace(s, r"(?U)[\s\p{Cf}]+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"\.0+$", "")
    digits = F.regexp_extract(s, r"(\d+)/?(?:\.\w{1,5})?$", 1)
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(bare != "", bare)


def source_key(c: Column) -> Column:
    """Spelling-free name of a source: case, blanks and the kind of separator aside."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\W+|\W+$", ""), r"(?U)[\W_]+", "_")


def best_records(df: DataFrame, fields: tuple[str, ...], time_col: str, trust: Column) -> DataFrame:
    """(sentence_id, trust, held, at, neg, n): the most recent row of each (group, trust, fields held); ``n`` rows stand behind it."""
    held = reduce(lambda a, b: a.bitwiseOR(b), [F.when(has_value(F.col(f)), F.lit(1 << i)).otherwise(0) for i, f in enumerate(fields)])
    at = F.unix_micros(F.col(time_col).cast("timestamp_ntz").cast("timestamp"))
    rows = df.select(
        sentence_key(df["sentence_id"]).alias("sentence_id"),
        trust.cast("int").alias("trust"),
        held.alias("held"),
        F.struct(F.coalesce(at, F.lit(-(2**62))).alias("at"), (-F.col("ord").cast("bigint")).alias("neg")).alias("recency"),
    ).where("sentence_id IS NOT NULL")
    best = rows.groupBy("sentence_id", "trust", "held").agg(F.max("recency").alias("best"), F.count("*").alias("n"))
    return best.select("sentence_id", "trust", "held", "best.at", "best.neg", "n")


def peeled(records: Column) -> Column:
    """The records (trust, held, at, neg) of a group with their dominance layer, in the order of policy.

    Sorted by trust, recency and fields held, a record comes after all that
    dominate it, so its layer is one more than the deepest layer of those.
    """
    later = lambda a, b: (a["at"] > b["at"]) | ((a["at"] == b["at"]) & (a["neg"] >= b["neg"]))
    over = lambda a, b: (a["trust"] >= b["trust"]) & (a["held"].bitwiseAND(b["held"]) == b["held"]) & later(a, b)

    def put(done: Column, x: Column) -> Column:
        above = F.array_max(F.transform(F.filter(done, lambda r: over(r, x)), lambda r: r["layer"]))
        return F.concat(done, F.array(F.struct((F.coalesce(above, F.lit(-1)) + 1).alias("layer"), x["trust"].alias("trust"), x["at"].alias("at"), x["neg"].alias("neg"), x["held"].alias("held"))))

    ordered = F.reverse(F.array_sort(records))
    start = F.array().cast("array<struct<layer:int,trust:int,at:bigint,neg:bigint,held:int>>")
    return F.aggregate(ordered, start, put)


def layers(df: DataFrame, fields: tuple[str, ...], time_col: str, trust: Column) -> DataFrame:
    """(sentence_id, records): the records of every group of two or more rows, layer by layer in the order of policy."""
    record = F.struct("trust", "at", "neg", "held")
    groups = best_records(df, fields, time_col, trust).groupBy("sentence_id").agg(F.collect_list(record).alias("records"), F.sum("n").alias("n"))
    by_layer = F.transform(peeled(F.col("records")), lambda r: F.struct(r["layer"].alias("layer"), (-r["trust"].cast("bigint")).alias("low"), (-r["at"]).alias("old"), (-r["neg"]).alias("ord"), r["held"].alias("held")))
    return groups.where("n > 1").select("sentence_id", F.array_sort(by_layer).alias("records"))


def survivors(df: DataFrame, fields: tuple[str, ...], time_col: str, trust: Column) -> DataFrame:
    """(sentence_id, field_name, ord, layer) for every field of every group of two or more rows."""
    first = lambda bit: F.try_element_at(F.filter("records", lambda r: r["held"].bitwiseAND(F.lit(bit)) != 0), F.lit(1))
    picks = [F.struct(F.lit(f).alias("field_name"), first(1 << i).alias("r")) for i, f in enumerate(fields)]
    found = layers(df, fields, time_col, trust).select("sentence_id", F.explode(F.array(*picks)).alias("x"))
    return found.where("x.r IS NOT NULL").select("sentence_id", "x.field_name", F.col("x.r.ord").alias("ord"), F.col("x.r.layer").alias("layer"))


def merge_row_survivors(df: DataFrame) -> DataFrame:
    """Survivors of merge_case_rows: no trust there, so the latest row with a value."""
    return survivors(df, MERGE_FIELDS, "ingested_at", F.lit(0))


def metadata_survivors(df: DataFrame, source_trust: DataFrame) -> DataFrame:
    """Survivors of case_metadata by trust of the source, then time."""
    # source_trust is a fixed list (4 rows); a larger one is joined by shuffle when it exceeds the session's threshold
    trust = (
        source_trust.groupBy(source_key(F.col("metadata_source")).alias("source_key")).agg(F.max("trust").alias("source_trust"))
    )
    keyed = df.withColumn("source_key", source_key(F.col("metadata_source")))
    keyed = keyed.join(trust, "source_key", "left").withColumn("source_trust", F.coalesce("source_trust", F.lit(-(2**31))))
    return survivors(keyed, METADATA_FIELDS, "generated_at", F.col("source_trust"))


def surviving_records(df: DataFrame, picked: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One record per group, its fields filled from the picked rows."""
    values = df.select(F.col("ord").cast("bigint").alias("ord"), *[F.col(f).cast("string").alias(f) for f in fields])
    value = reduce(lambda w, f: w.when(F.col("field_name") == f, F.col(f)), fields, F.when(F.lit(False), F.lit(None).cast("string")))
    cells = picked.join(values, "ord").select("sentence_id", "field_name", value.alias("value"))
    return cells.groupBy("sentence_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields])
