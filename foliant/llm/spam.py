"""Keyword, link and tag pages, told from prose by their rank-frequency curve.

Two passes, each page handled inside its Arrow partition by DuckDB SQL with
windows. The first counts, per language and length class, how many pages use a
word, and pre-aggregates; only pages whose vocabulary is as rich as usual for
their length speak for the prose of a language, so that keyword pages cannot make
their own words look normal. The second fits the curve ln(frequency) over
ln(rank) of each page (slope, residual) and measures how far its distribution
diverges from same-language prose; pages are then held against the prose pages of
their language and length class. Each distinct text counts once in both, however
many copies it has. Twice the length gives no fewer distinct words and at most
twice as many, so classes of the same language with enough distinct pages bound
what is usual in a class that has few pages or mostly poor ones; where no class
has enough, and for words of no known language, fixed figures stand in.

Defined results: null, empty and blank pages and pages without any letter are not
judged and not listed; copies get the same verdict each; a page in several
languages is compared with the better fitting language word by word.

Bound of what is sent to the workers: a word enters the prose profile when one
page in a hundred of its language uses it, so there are at most a hundred times
as many as an average page has distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.sources.tables import cut_lineage

#: share of the pages of a language that use a word of its prose profile
PROFILE_SHARE = 0.01
#: probability given to words outside the profile
FLOOR = 1e-5
#: how far (natural log) the vocabulary of a page may fall below the median of its class and still speak for prose
POOR = 0.7
#: verdict: divergence beyond prose of the same language and length, plus half of what the words are rarer and the
#: vocabulary is poorer (each counted up to CREDIT), in nats
VERDICT, CREDIT = 2.55, 1.5
#: a vocabulary as rich as prose speaks for a page unless it diverges by OUTRIGHT
RICH, OUTRIGHT = 0.1, 3.0
#: distinct pages from which a class speaks for its neighbours
ENOUGH = 20
#: most that the divergence of prose falls from one length class to the next: ln 2 for the entropy, and what medians stray
FALL = 1.0
#: prose of no known language: ln(words) over ln(tokens), entropy over ln(words), cross entropy
WORDS_AT, WORDS_SLOPE, ENTROPY, CROSS_ENTROPY = 0.8, 0.66, 0.9, 5.5

_COUNT = """
WITH f AS (SELECT row, tok, count(*) AS n FROM words GROUP BY ALL),
     g AS (SELECT f.*, src.lang FROM f JOIN src USING (row)),
     c AS (SELECT *, floor(log2(sum(n) OVER (PARTITION BY row))) AS lb, floor(10 * ln(count(*) OVER (PARTITION BY row))) AS vb FROM g)
SELECT lang, lb::INT AS lb, vb::INT AS vb, tok, sum(n)::BIGINT AS n, count(*)::BIGINT AS df FROM c GROUP BY ALL
UNION ALL
SELECT lang, lb::INT, vb::INT, '' AS tok, sum(n)::BIGINT, count(DISTINCT row)::BIGINT FROM c GROUP BY ALL
"""
_CURVE = f"""
WITH f AS (SELECT row, tok, count(*) AS n FROM words GROUP BY ALL),
     r AS (SELECT f.row, f.tok, f.n, p.p, p.lang, row_number() OVER (PARTITION BY f.row ORDER BY f.n DESC, f.tok) AS r,
                  sum(f.n) OVER (PARTITION BY f.row) AS total
           FROM f LEFT JOIN profile p ON p.tok = f.tok),
     c AS (SELECT row, max(total)::BIGINT AS tokens, count(*)::BIGINT AS words, coalesce(regr_slope(ln(n), ln(r)), 0)::DOUBLE AS slope,
       coalesce(sqrt(greatest(0, regr_syy(ln(n), ln(r)) * (1 - regr_r2(ln(n), ln(r)))) / count(*)), 0)::DOUBLE AS residual,
       -sum(n / total * ln(coalesce(p, {FLOOR})))::DOUBLE AS cross_entropy, sum(n / total * ln(n / total / coalesce(p, {FLOOR})))::DOUBLE AS divergence FROM r GROUP BY row),
     l AS (SELECT row, max_by(lang, w) AS lang FROM (SELECT row, lang, sum(n) AS w FROM r WHERE lang IS NOT NULL GROUP BY row, lang) GROUP BY row)
SELECT s.doc, s.digest, c.tokens, c.words, coalesce(l.lang, '') AS lang, s.lang AS label, c.slope, c.residual, c.cross_entropy, c.divergence FROM c JOIN src s USING (row) LEFT JOIN l USING (row)
"""


def _tables(b: pa.RecordBatch) -> tuple[pa.Table, pa.Table]:
    """(rows without their text, words of the rows); rows are told apart by their place, as several may share an id or have none."""
    from .fold import worded

    row = pa.array(range(b.num_rows), pa.int32())
    lists = pc.split_pattern(pa.array([worded(t) if t else "" for t in b.column("t").to_pylist()], pa.string()), " ")
    words = pa.table({"row": row.take(pc.list_parent_indices(lists)), "tok": lists.flatten()})
    return pa.table({c: b.column(c) for c in b.schema.names if c != "t"} | {"row": row}), words.filter(pc.not_equal(words["tok"], ""))


def _run(sql: str, schema: pa.Schema, profile: pa.Table | None = None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})  # slices fit in memory, nothing is spilled
        if profile is not None:
            con.register("profile", profile)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                rows, words = _tables(b.slice(lo, 2000))
                con.register("src", rows)
                con.register("words", words)
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("src")
                con.unregister("words")

    return work


_COUNT_SCHEMA = pa.schema(
    [("lang", pa.string()), ("lb", pa.int32()), ("vb", pa.int32()), ("tok", pa.string()), ("n", pa.int64()), ("df", pa.int64())]
)
_CURVE_SCHEMA = pa.schema(
    [("doc", pa.int64()), ("digest", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("lang", pa.string()), ("label", pa.string())]
    + [(c, pa.float64()) for c in ("slope", "residual", "cross_entropy", "divergence")]
)


def _source(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    code = F.substring(F.lower(F.trim(F.coalesce(df[lang_col], F.lit("")))), 1, 2)
    src = df.select(df[id_col].cast("bigint").alias("doc"), code.alias("lang"), df[text_col].alias("t")).where(F.length("t") > 0)
    # the letters alone: copies that differ in blanks, figures or marks are copies
    return src.withColumn("digest", F.xxhash64(F.regexp_replace(F.lower("t"), r"[^\p{L}]+", "")))


def _fixed_words(length_class: Column) -> Column:
    return F.lit(WORDS_AT) + (length_class + 0.5) * (WORDS_SLOPE * log(2))


def _at_least(classes: DataFrame) -> DataFrame:
    """(lang, lb, least): what other classes of the language leave as ln(words) of prose in a class; a row a class."""
    donors = classes.where(F.col("pages") >= ENOUGH).select("lang", F.col("lb").alias("j"), F.col("usual").alias("u"))
    gap = F.greatest(F.col("j") - F.col("lb"), F.lit(0))
    floors = classes.join(F.broadcast(donors), "lang", "left").groupBy("lang", "lb").agg(F.max(F.col("u") - gap * log(2)).alias("least"))
    return floors.select("lang", "lb", F.coalesce("least", _fixed_words(F.col("lb"))).alias("least"))


def prose_profile(src: DataFrame) -> DataFrame:
    """(tok, p, lang): probability of each usual word in the prose of the language that uses it most."""
    once = src.where("lang <> ''").dropDuplicates(["lang", "digest"]).select("doc", "lang", "t")
    counts = once.mapInArrow(_run(_COUNT, _COUNT_SCHEMA), "lang string, lb int, vb int, tok string, n bigint, df bigint")
    counts = cut_lineage(
        counts.groupBy("lang", "lb", "vb", "tok").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    )
    pages = counts.where("tok = ''")
    # weighted median of the vocabulary class, per language and length class: a few rows each
    klass = W.partitionBy("lang", "lb")
    below = F.sum("df").over(klass.orderBy("vb"))
    pages = (
        pages.withColumn("below", below)
        .withColumn("all", F.sum("df").over(klass))
        .withColumn("median", F.min(F.when(F.col("below") * 2 >= F.col("all"), F.col("vb"))).over(klass))
    )
    classes = pages.groupBy("lang", "lb").agg((F.max("median") / 10).alias("usual"), F.max("all").alias("pages"))
    rich = (
        pages.join(F.broadcast(_at_least(classes)), ["lang", "lb"])
        .where(F.col("vb") >= F.greatest(F.col("median"), F.floor(F.col("least") * 10)) - int(10 * POOR))
        .select("lang", "lb", "vb")
    )
    kept = counts.join(F.broadcast(rich), ["lang", "lb", "vb"])  # classes: languages x log2 lengths x tenths of log vocabulary
    totals = kept.where("tok = ''").groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("df").alias("pages"))
    # a language speaks for itself from ENOUGH pages on, however many pages there are of others
    totals = totals.where(F.col("pages") >= ENOUGH)
    usual = (
        kept.where("tok <> ''")
        .groupBy("lang", "tok")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        .join(F.broadcast(totals), "lang")  # one row a language
        .where(F.col("df") >= PROFILE_SHARE * F.col("pages"))
        .select("tok", "lang", (F.col("n") / F.col("all_n")).alias("p"))
    )
    return usual.groupBy("tok").agg(F.max("p").alias("p"), F.max_by("lang", "p").alias("lang"))


def page_curves(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per page: curve, divergence, what prose of its language and length has, and the verdict ``is_spam``."""
    src = _source(df, id_col, text_col, lang_col)
    profile = prose_profile(src).toArrow()  # bounded, see the module text
    curves = src.mapInArrow(
        _run(_CURVE, _CURVE_SCHEMA, profile),
        "doc bigint, digest bigint, tokens bigint, words bigint, lang string, label string, slope double, residual double, cross_entropy double, divergence double",
    )
    # no word of any prose: the language the page is said to have, else none
    stray = F.col("lang") == ""
    said = F.when(F.col("label").isin(profile["lang"].unique().to_pylist()), F.col("label")).otherwise("")
    curves = curves.withColumn("stray", stray).withColumn("lang", F.when(stray, said).otherwise(F.col("lang"))).drop("label")
    curves = cut_lineage(curves.withColumn("length_class", F.floor(F.log2("tokens")).cast("int")))
    once = curves.dropDuplicates(["lang", "digest"]).withColumn("lb", F.col("length_class"))
    known = F.col("lang") != ""
    own = once.groupBy("lang", "lb").agg(F.percentile_approx(F.ln("words"), 0.5, 1000).alias("usual"), F.count("*").alias("pages"))
    rich = own.join(F.broadcast(_at_least(own)), ["lang", "lb"]).select(
        "lang", "lb", F.when(known, F.greatest("usual", "least")).otherwise(_fixed_words(F.col("lb"))).alias("usual_words")
    )
    prose = once.join(F.broadcast(rich), ["lang", "lb"]).where(known & ~F.col("stray") & (F.ln("words") >= F.col("usual_words") - POOR))
    rare = prose.groupBy("lang").agg(F.percentile_approx("cross_entropy", 0.5, 1000).alias("usual_cross_entropy"))
    figures = prose.groupBy("lang", "lb").agg(
        F.count("*").alias("pages"), *[F.percentile_approx(c, 0.5, 1000).alias(f"usual_{c}") for c in ("slope", "residual", "divergence")]
    )
    donors = figures.where(F.col("pages") >= ENOUGH).select("lang", F.col("lb").alias("j"), F.col("usual_divergence").alias("u"))
    caps = rich.join(F.broadcast(donors), "lang").groupBy("lang", "lb").agg(
        F.min(F.col("u") + F.greatest(F.col("j") - F.col("lb"), F.lit(0)) * FALL).alias("most")
    )
    classes = rich.join(F.broadcast(figures), ["lang", "lb"], "left").join(F.broadcast(caps), ["lang", "lb"], "left").join(F.broadcast(rare), "lang", "left")
    classes = classes.withColumn("usual_cross_entropy", F.when(known, F.coalesce("usual_cross_entropy", F.lit(CROSS_ENTROPY))).otherwise(-log(FLOOR)))
    # a class without any prose, in a language without a class that speaks for it
    fixed = F.col("usual_cross_entropy") - ENTROPY * F.col("usual_words")
    classes = classes.withColumn("usual_divergence", F.coalesce(F.least("usual_divergence", "most"), fixed))
    held = curves.join(
        F.broadcast(classes.drop("pages", "most").withColumnRenamed("lb", "length_class")), ["lang", "length_class"]
    )  # a row per language and log2 length
    excess = F.col("divergence") - F.col("usual_divergence")
    poorer = F.col("usual_words") - F.ln("words")
    rarer = F.col("cross_entropy") - F.col("usual_cross_entropy")
    score = excess + (F.least(rarer, F.lit(CREDIT)) + F.least(poorer, F.lit(CREDIT))) / 2
    # prose said to be in another language diverges as much, but is not poor
    verdict = (score >= VERDICT) & F.when(F.col("stray"), poorer > POOR).otherwise((poorer > RICH) | (excess > OUTRIGHT))
    return held.withColumn("excess", excess).withColumn("score", score).withColumn("is_spam", F.coalesce(verdict, F.lit(False)))


def spam_pages(df: DataFrame) -> DataFrame:
    """(doc_id) of the pages found."""
    return page_curves(df).where("is_spam").select(F.col("doc").alias("doc_id"))
