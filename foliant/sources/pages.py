"""Landed web pages as tables of elements, links and form fields, and what is told from them: repeated blocks, forms, tokens.

Pages are parsed in Arrow batches; all counting is on the table of elements, so a
page of any kind and a corpus of any size are combined by ordinary aggregates.
Live navigation is not part of the engine: a page comes in as (url, html).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import extract, text
from foliant.operators import quality

BLOCKS = ("tr", "li", "div", "section", "article")
#: a block repeats from so many of its signature on; a card needs so many of its seven signs
REPEATS, CARD_SIGNS, BLOCK_LENGTH = 3, 4, 40
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "noscript"))

# What names a field, a document link and a detail link.
SUBJECT, SUMMARY, DECISION = ("主題", "subject", "標的"), ("摘要", "sumário", "sumario", "summary"), ("裁判結果", "決定", "resultado", "decision result")
PDF_HINTS, TEXT_HINTS = ("pdf", "判決書"), ("全文", "text", "fulltext", "full text", "teor", "conteúdo", "conteudo", "sentença", "sentenca", "sentence", "裁判書")
FORM_HINTS = ("court", "judgment", "search", "法院", "裁判", "查詢", "tribunal", "pesquisa")

_SCHEMA = pa.schema(
    [("page", pa.string()), ("no", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.string()), ("name", pa.string()), ("value", pa.string()),
     ("type", pa.string()), ("href", pa.string()), ("text", pa.string()), ("links", pa.int32()), ("hrefs", pa.list_(pa.string()))]
)


def _parsed(page: str, html: str) -> list[tuple]:
    from html.parser import HTMLParser

    rows: list[list] = []
    open_rows: list[int] = []

    class Reader(HTMLParser):
        silent = 0

        def handle_starttag(self, tag: str, attrs: list) -> None:
            a = {k: v or "" for k, v in attrs}
            rows.append([page, len(rows), open_rows[-1] if open_rows else None, tag, a.get("id"), " ".join(sorted(a.get("class", "").split())), a.get("name"), a.get("value"), a.get("type"), a.get("href"), [], 0, []])
            if tag == "a" and a.get("href"):
                for r in [*open_rows, len(rows) - 1]:
                    rows[r][11] += 1
                    rows[r][12].append(a["href"])
            if tag not in _VOID:
                open_rows.append(len(rows) - 1)
                self.silent += tag in _SILENT

        def handle_startendtag(self, tag: str, attrs: list) -> None:
            self.handle_starttag(tag, attrs)
            if tag not in _VOID:
                self.handle_endtag(tag)

        def handle_endtag(self, tag: str) -> None:
            # an end closes the nearest open element of its tag, and what is open inside
            for i in range(len(open_rows) - 1, -1, -1):
                if rows[open_rows[i]][3] == tag:
                    self.silent -= sum(rows[r][3] in _SILENT for r in open_rows[i:])
                    del open_rows[i:]
                    return

        def handle_data(self, data: str) -> None:
            if not self.silent and data.strip():
                for r in open_rows:
                    rows[r][10].append(data.strip())

    Reader(convert_charrefs=True).feed(html)
    for r in rows:
        r[10] = " ".join(" ".join(r[10]).split())
    return rows


def elements(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per element of every page: place, parent, tag, attributes, its text and links. Null pages give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = _parsed(u, h) if h else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    ddl = "page string, no int, parent int, tag string, id string, classes string, name string, value string, type string, href string, text string, links int, hrefs array<string>"
    return pages.select(F.col(url).cast("string").alias("page"), F.col(html).alias("html")).mapInArrow(run, ddl)


def signature() -> Column:
    """tag#id.classes of an element."""
    part = lambda c, mark: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), F.translate(c, " ", "."))).otherwise("")
    return F.concat("tag", part(F.col("id"), "#"), part(F.col("classes"), "."))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def card_score() -> Column:
    """How many of seven signs of a card a block has: date, case number, three labels, a pdf link and a text link."""
    linked = lambda words: F.exists("hrefs", lambda h: _any(h, words))
    signs = [F.col("text").rlike(extract.ANY_DATE), F.col("text").rlike(quality.CASE), *[_any(F.col("text"), w) for w in (SUBJECT, SUMMARY, DECISION)], linked(PDF_HINTS), linked(TEXT_HINTS)]
    return reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in signs])


def repeated_blocks(found: DataFrame) -> DataFrame:
    """Blocks whose signature repeats on their page and whose text is long enough."""
    x = found.where(F.col("tag").isin(*BLOCKS)).withColumn("signature", signature())
    often = x.groupBy("page", "signature").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS)
    return x.join(often, ["page", "signature"]).where(F.length("text") >= BLOCK_LENGTH)


def repeated_cards(found: DataFrame) -> DataFrame:
    """Repeated blocks with enough signs of a card, without those that wrap another one."""
    x = found.where(F.col("tag").isin(*BLOCKS)).withColumn("signature", signature()).withColumn("score", card_score())
    often = x.groupBy("page", "signature").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS)
    good = x.join(often, ["page", "signature"]).where(F.col("score") >= CARD_SIGNS)
    wraps = good.select("page", F.col("parent").alias("no")).distinct()
    return good.join(wraps, ["page", "no"], "left_anti")


def structure(found: DataFrame) -> DataFrame:
    """Per page how many result-like rows, list items and repeated blocks it has, and whether it is a table, a list, cards, mixed or unknown."""
    x = found.where(F.col("tag").isin(*BLOCKS)).withColumn("signature", signature())
    n = x.groupBy("page", "signature").agg(F.count("*").alias("n"))
    like = x.where(quality.result_like(F.col("text"), F.col("links"))).join(n, ["page", "signature"])
    own = F.col("tag").isin("tr", "li")
    g = like.groupBy("page").agg(F.count_if(F.col("tag") == "tr").alias("table"), F.count_if(F.col("tag") == "li").alias("list"), F.count_if(~own & (F.col("n") >= REPEATS)).alias("card"))
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in ("table", "list", "card")]), lambda s: s["n"] > 0)
    guess = F.when(F.size(kinds) == 1, kinds[0]["k"]).when(F.size(kinds) > 1, "mixed").otherwise("unknown")
    return found.select("page").distinct().join(g, "page", "left").fillna(0, ["table", "list", "card"]).withColumn("structure", guess)


def signature_stats(found: DataFrame, least: int = 2) -> DataFrame:
    """Per page and signature met at least twice: elements, shortest, upper median, mean and longest text, hits of dates, cases and links, and a score."""
    x = found.where("text <> ''").withColumn("signature", signature()).withColumn("len", F.length("text"))
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = x.groupBy("page", "signature").agg(
        F.count("*").alias("n"), F.min("len").alias("shortest"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY len DESC)").alias("median"),
        F.round(F.avg("len"), 2).alias("mean"), F.max("len").alias("longest"), hit(F.col("text").rlike(extract.ANY_DATE)).alias("dates"), hit(F.col("text").rlike(quality.CASE)).alias("cases"),
        hit(F.col("links") > 0).alias("linked"),
    ).where(F.col("n") >= least)
    return g.withColumn("score", F.col("dates") + F.col("cases") + F.col("linked"))


def result_likelihood(items: Column, cases: Column, dates: Column, blocks: Column, empty_marks: Column) -> Column:
    """Whether a page shows results: three items, or enough case numbers, dates or repeated blocks, and no mark of an empty list."""
    return (empty_marks == 0) & ((items >= 3) | (cases >= 3) | ((dates >= 3) & (blocks >= 1)) | (blocks >= 5))


def marker_hits(c: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers a text holds."""
    return text.count_held(F.coalesce(c, F.lit("")), markers)


def candidate_markers(c: Column, markers: tuple[str, ...]) -> Column:
    """struct(appears, marker_hits, case_hits): three markers or two case numbers make a result page."""
    cases = F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({quality.CASE})")))
    return F.struct(((marker_hits(c, markers) >= 3) | (cases >= 2)).alias("appears"), marker_hits(c, markers).alias("marker_hits"), cases.alias("case_hits"))


def search_form(html: Column, markers: tuple[str, ...]) -> Column:
    """struct(is_form, hits): a form element and three markers make a search form."""
    return F.struct((F.contains(F.lower(F.coalesce(html, F.lit(""))), F.lit("<form")) & (marker_hits(html, markers) >= 3)).alias("is_form"), marker_hits(html, markers).alias("hits"))


def best_form(found: DataFrame) -> DataFrame:
    """Per page the form with most inputs and selects, five more for each hint it holds; the first wins a tie.

    Fields belong to the nearest form before them in the page.
    """
    forms = found.where("tag = 'form'").select("page", F.col("no").alias("form"), "text")
    fields = found.where(F.col("tag").isin("input", "select")).select("page", "no")
    inside = fields.join(forms.select("page", "form"), "page").where("form < no").groupBy("page", "no").agg(F.max("form").alias("form")).groupBy("page", "form").agg(F.count("*").alias("fields"))
    scored = forms.join(inside, ["page", "form"], "left").withColumn("score", F.coalesce("fields", F.lit(0)) + 5 * text.count_held(F.lower("text"), FORM_HINTS))
    return scored.groupBy("page").agg(F.max_by(F.struct("form", "score"), F.struct("score", (-F.col("form")).alias("first"))).alias("b")).select("page", "b.*")


def token(found: DataFrame, name: str = "_token") -> DataFrame:
    """Per page the value of the field of that name, else of the first field whose name holds it."""
    x = found.where((F.col("tag") == "input") & F.contains(F.coalesce("name", F.lit("")), F.lit(name)) & (F.coalesce("value", F.lit("")) != ""))
    return x.groupBy("page").agg(F.min_by("value", F.struct((F.col("name") != name).alias("other"), "no")).alias("token"))


def links_of(block_links: Column, documents: tuple[str, ...], details: tuple[str, ...]) -> Column:
    """struct(detail, document) of the links of a block: the first document hint, then the first detail hint, else the first other link."""
    doc = F.try_element_at(F.filter(block_links, lambda h: _any(h, documents)), F.lit(1))
    rest = F.filter(block_links, lambda h: ~_any(h, documents) | ((h != doc) & F.lit(True)))
    return F.struct(F.try_element_at(rest, F.lit(1)).alias("detail"), doc.alias("document"))


def date_window(day: Column, pattern: str = "yyyy-MM-dd", days: int = 30) -> Column:
    """struct(begin, end): the day and that many days before, as texts."""
    return F.struct(F.date_format(F.date_sub(day, days), pattern).alias("begin"), F.date_format(day, pattern).alias("end"))


def variant_score(markers: Column, cases: Column, appears: Column, form_markers: Column, is_form: Column, status: Column) -> Column:
    """Score of one way to ask a page: markers, cases twice, five for a result page, form markers off, three for no form, one for a good status."""
    return markers + cases * 2 + F.when(appears, 5).otherwise(0) - form_markers + F.when(~is_form, 3).otherwise(0) + F.when(status == 200, 1).otherwise(0)


def best_variant(results: DataFrame) -> DataFrame:
    """The best way by (score, no form, result page, length)."""
    rank = F.struct("score", (~F.col("is_form")).cast("int").alias("a"), F.col("appears").cast("int").alias("b"), "length")
    return results.agg(F.max_by(F.struct(*results.columns), rank).alias("r")).where("r IS NOT NULL").select("r.*")


def first_submission(records: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """The first POST with a body, else the first request whose address holds a word."""
    kind = F.when((F.col("method") == "POST") & (F.coalesce("body", F.lit("")) != ""), 0).when(_any(F.col("url"), words), 1)
    x = records.withColumn("__k", kind).where("__k IS NOT NULL")
    return x.agg(F.min_by(F.struct(*records.columns), F.struct("__k", "ord")).alias("r")).where("r IS NOT NULL").select("r.*")
