"""Addresses of judgments and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentence_id(c: Column) -> Column:
    """Number behind /sentence/zh/ or /sentence/pt/; null where there is none."""
    v = F.regexp_extract(c, r"(?i)/sentence/(?:zh|pt)/([0-9]+)", 1)
    return F.when(v != "", v)


def is_sentence(c: Column) -> Column:
    """Whether an address is that of a judgment."""
    return F.coalesce(c.rlike(r"(?i)/sentence/(?:zh|pt)/[0-9]+"), F.lit(False))


def language(c: Column) -> Column:
    """zh or pt by the path, else unknown."""
    return F.when(F.contains(F.lower(c), F.lit("/zh/")), "zh").when(F.contains(F.lower(c), F.lit("/pt/")), "pt").otherwise("unknown")


def canonical(c: Column) -> Column:
    """https unless given, host in small letters, no fragment, no final slash, query parts sorted."""
    t = F.regexp_replace(F.trim(c), "#.*$", "")
    t = F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), t).when(F.startswith(t, F.lit("//")), F.concat(F.lit("https:"), t)).otherwise(F.concat(F.lit("https://"), t))
    scheme, host = F.lower(F.regexp_extract(t, "^([^:]+)://", 1)), F.lower(F.regexp_extract(t, "^[^:]+://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(t, r"^[^:]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(t, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.coalesce(F.trim(c), F.lit("")) != "", out)


def page_param(c: Column, page: Column) -> Column:
    """The address with its page parameter set; the first page carries none."""
    bare = F.regexp_replace(F.regexp_replace(c, r"([?&])page=[^&]*&?", "$1"), "[?&]$", "")
    mark = F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(page <= 1, bare).otherwise(F.concat(bare, mark, F.lit("page="), page.cast("string")))


def kind(c: Column) -> Column:
    """pdf, text_zh, text_pt or other."""
    return (
        F.when(c.rlike(r"(?i)\.pdf(?:$|[?#])"), "pdf")
        .when(is_sentence(c) & (language(c) == "zh"), "text_zh")
        .when(is_sentence(c) & (language(c) == "pt"), "text_pt")
        .otherwise("other")
    )


def links(html: Column) -> Column:
    """Links of a page as array<struct<kind,language,url>>, in order."""
    hrefs = F.regexp_extract_all(html, F.lit("(?i)<a\\b[^>]*?href\\s*=\\s*[\"']([^\"']+)[\"']"))
    return F.transform(hrefs, lambda u: F.struct(kind(u).alias("kind"), language(u).alias("language"), u.alias("url")))


def text_link(found: Column) -> Column:
    """Chinese judgment text before Portuguese before any other that is no pdf; null where there is none."""
    first = lambda test: F.element_at(F.transform(F.filter(found, test), lambda x: x["url"]), 1)
    size = lambda test: F.size(F.filter(found, test)) > 0
    zh, pt, other = (lambda x: x["kind"] == "text_zh"), (lambda x: x["kind"] == "text_pt"), (lambda x: x["kind"] != "pdf")
    return F.when(size(zh), first(zh)).when(size(pt), first(pt)).when(size(other), first(other))


def pdf_link(found: Column) -> Column:
    """First pdf; null where there is none."""
    pdfs = F.filter(found, lambda x: x["kind"] == "pdf")
    return F.when(F.size(pdfs) > 0, F.element_at(F.transform(pdfs, lambda x: x["url"]), 1))
