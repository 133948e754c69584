"""Rule-based fields of judgments as column expressions: headings, summaries, holdings, legal bases, issues, lines of a detail page.

Each rule is a composition of regular expressions and array functions, so a plan
that takes several fields reads a text once and stays in the JVM. A null text is
read as an empty one; text fields are '' and list fields empty where nothing is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Headings and stop headings of the fields, as patterns.
ISSUE_LINES = {"zh": ("主要問題", "重要法律問題", "主題"), "pt": ("Assunto", "Descritores")}
SUMMARY_HEADS = {"zh": ("裁判摘要", "摘要", r"摘\s*要", "案情摘要"), "pt": ("SUM[ÁA]RIO", "RESUMO")}
SUMMARY_STOPS = {
    "zh": ("裁判書製作人", "澳門特別行政區", "一、", "二、", "三、", "事實", "理由說明", "裁判"),
    "pt": (r"O\s+Relator", "ACORDAM", r"I\.?\s+RELAT[ÓO]RIO", r"II\.", "DECIS[ÃA]O", "FUNDAMENTA[CÇ][ÃA]O"),
}
PLAIN_SUMMARY_HEADS = {"zh": ("摘要", "案情摘要"), "pt": ("SUM[ÁA]RIO", "RESUMO")}
PLAIN_SUMMARY_STOPS = {"zh": ("裁判", "決定", "理由說明", "事實", "法律依據"), "pt": ("DECIS[ÃA]O", "FUNDAMENTA[CÇ][ÃA]O", "ACORDAM", "RELAT[ÓO]RIO")}
ISSUE_PATTERNS = {"zh": (r"主要問題\s*[:：]\s*([^。]+)", r"爭議焦點\s*[:：]\s*([^。]+)"), "pt": (r"Assunto\s*[:：]\s*([^\.]+)", r"Quest[õo]es\s*[:：]\s*([^\.]+)")}
V1_SUMMARY = (("案情摘要", "摘要", "事實", "relat[óo]rio", "resumo", "sum[áa]rio"), ("理由", "法律依據", "裁判", "決定", "fundamenta", "decis[ãa]o"))
V1_REASONING = (("理由", "理由說明", "法律分析", "fundamenta[cç][ãa]o", "fundamentos"), ("裁判", "決定", "結論", "decis[ãa]o"))
V1_ISSUES = (r"爭議焦點\s*[:：]\s*([^。\n]+)", r"主要問題\s*[:：]\s*([^。\n]+)", r"quest[õo]es?\s*[:：]\s*([^\.\n]+)", r"objecto\s*[:：]\s*([^\.\n]+)")
V1_POINTS = (r"裁判要旨\s*[:：]\s*([^。\n]+)", r"法律見解\s*[:：]\s*([^。\n]+)", r"法理\s*[:：]\s*([^。\n]+)", r"sum[áa]rio\s*[:：]\s*([^\.\n]+)")
SNIPPET_HEADS = (
    (("爭議焦點", "主要問題", "上訴理由", "quest[õo]es?"), ("理由", "fundamenta")),
    (("理由", "法律分析", "fundamenta[cç][ãa]o"), ("裁判", "決定", "結論", "decis[ãa]o")),
    (("裁判", "決定", "主文", "decis[ãa]o", "acordam"), ("日期", "簽署", "assinado")),
)
# Words that mark a holding, with their weights, per language.
HOLDING = {
    "zh": (("裁定", "判決", "決定", "駁回", "不批准", "不予批准", "確認", "維持原審", "維持原判", "上訴理由不成立"), ("聲請", "上訴", "改判", "判處")),
    "pt": (
        ("negar provimento", "negou provimento", "julga-se improcedente", "julgar improcedente", "julgado improcedente", "julga improcedente",
         "manter a decisão", "acordam", "decisão", "condenar", "absolver"),
        ("recurso", "sentença recorrida", "tribunal", "mantendo-se"),
    ),
}
PLAIN_HOLDING = {
    "zh": ("裁定", "判決", "決定", "駁回", "改判", "判處", "維持原判", "上訴理由不成立"),
    "pt": ("acordam", "decisão", "decidem", "julgar", "negar provimento", "conceder provimento", "improcedente", "procedente", "condenar", "absolver"),
}
V1_HOLDING = ("裁定", "判決", "判處", "駁回", "上訴", "維持原判", "改判", "acordam", "decidem", "decisão", "julgar", "negar provimento", "conceder provimento", "condenar", "absolver")
DRAFT_HOLDING = ("裁定", "判決", "上訴", "駁回", "改判", "判處")
REASONS = ("理由", "認為", "因此", "fundament", "entende")
POINTS = ("本院認為", "本案", "原則", "應", "deve", "princípio")
SNIPPET_WORDS = ("第", "條", "裁定", "判決", "駁回", "維持", "改判", "理由", "本院認為", "princ", "art")
# Keys of a detail page that are no title, and lines that end the search for one.
NO_TITLE_KEYS = ("案件編號", "卷宗編號", "編號", "案號", "日期", "裁判日期", "判決日期", "上訴人", "主上訴人", "主被上訴人", "附帶上訴人", "附帶被上訴人", "聲請人", "被訴實體")
TITLE_STOPS = ("摘要", "摘 要", "裁判摘要", "裁判書製作人", "一、案情敘述", "一、 案件概述", "澳門特別行政區")
NO_TITLE = ("日期", "裁判書製作人", "澳門特別行政區")

ZH_ARTICLE, PT_ARTICLE = r"(第\s*\d+\s*(?:之\s*\d+)?\s*條)", r"(?iu)(art(?:igo|\.)?\s*\d+[.º°o]*)"
SEPARATORS = "[、，,;；]+"
V1_END = r"([。！？!?；;\.])"
PLAIN_END = r"([。.!?；;])"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def _first(candidates: list[Column]) -> Column:
    """First non-empty text of several, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def _has(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of the words."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _by_language(language: Column, zh: Column, other: Column) -> Column:
    return F.when(_some(language) == "zh", zh).otherwise(other)


def sentences(c: Column, end: str = PLAIN_END, blanks: str = r"\s+") -> Column:
    """Parts behind a terminator that blanks follow, squeezed, blank ones dropped."""
    marked = F.regexp_replace(_some(c), f"(?U){end}{blanks}", "$1\u0001")
    return _filled(F.transform(F.split(marked, "\u0001"), text.squeeze))


def clipped(c: Column, n: int) -> Column:
    """Squeezed, at most n characters, three dots in place of the last of a cut one."""
    return text.clip(text.squeeze(c), n)


def issue_terms(c: Column) -> Column:
    """Parts between separators, without outer marks."""
    parts = F.filter(F.transform(F.split(c, SEPARATORS), text.squeeze), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^[\-:：.。 ]+|[\-:：.。 ]+$", ""))


def heading_value(c: Column, heads: tuple[str, ...], limit: int = 220) -> Column:
    """Value behind the first heading with a colon in the first line that has one."""
    def of(line: Column) -> Column:
        values = [F.regexp_replace(F.regexp_extract(line, rf"(?iu)(?:^|\s)(?:{h})\s*[:：]\s*(.+)", 1), "^[-•‧·]+", "") for h in heads]
        return _first([F.trim(v) for v in values])

    lines = _filled(F.transform(F.split(_some(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), text.squeeze))
    found = _filled(F.transform(lines, of))
    return F.coalesce(clipped(F.try_element_at(found, F.lit(1)), limit), F.lit(""))


def heading_block(c: Column, heads: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """From the earliest end of a heading to the earliest stop heading behind it."""
    def of(t: Column) -> Column:
        ends = [F.length(F.regexp_extract(t, rf"(?isu)^.*?(?:{h})\s*[:：]?", 0)) for h in heads]
        start = F.array_min(F.filter(F.array(*ends), lambda n: n > 0))
        return F.when(start.isNotNull(), text.let(F.substr(t, start + 1), rest)).otherwise("")

    def rest(r: Column) -> Column:
        stop = F.array_min(F.filter(F.array(*[F.regexp_instr(r, F.lit(rf"(?isu){s}")) for s in stops]), lambda n: n > 0))
        return text.squeeze(F.when(stop.isNotNull(), F.substr(r, F.lit(1), stop - 1)).otherwise(r))

    return F.coalesce(text.let(_some(c), of), F.lit(""))


def first_block(c: Column, heads: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """Behind the first heading up to the next stop heading or the end, squeezed."""
    return F.coalesce(text.squeeze(F.regexp_extract(_some(c), rf"(?isu)(?:{'|'.join(heads)})\s*[:：]?\s*(.+?)(?:(?:{'|'.join(stops)})|$)", 1)), F.lit(""))


def all_blocks(c: Column, heads: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """Every such block in order, blank ones dropped; a stop may be the next heading."""
    found = F.regexp_extract_all(_some(c), F.lit(rf"(?isu)(?:{'|'.join(heads)})\s*[:：]?\s*(.+?)(?=(?:{'|'.join(stops)})\s*[:：]?|$)"))
    return _filled(F.transform(found, text.squeeze))


def summary_sentence(c: Column, language: Column) -> Column:
    """A sentence without references in brackets, numbering, stars and the word for summary."""
    s = text.squeeze(c)
    for pattern in (r"（[^）]{0,80}參見[^）]*）", r"(?iu)\([^\)]{0,80}cf\.[^\)]*\)", r"^[IVXLCM]+\s*[\-–—.]\s*", r"^\d+\s*[\-–—.)]\s*", r"^\*+\s*"):
        s = F.regexp_replace(s, pattern, "")
    s = text.squeeze(s)
    zh = F.regexp_replace(F.replace(s, F.lit("裁判摘要"), F.lit("")), "^[ ：]+|[ ：]+$", "")
    return _by_language(language, zh, F.regexp_replace(s, r"(?iu)^(sum[áa]rio|resumo)\s*", ""))


def _joined_head(items: Column, n: int) -> Column:
    return F.array_join(F.slice(items, 1, n), " ")


def case_summary(language: Column, c: Column, case_type: Column) -> Column:
    """Issue line, else the first sentences of the summary block, else those of the text, else the type."""

    def of(t: Column) -> Column:
        def branch(lang: str, head: str, glue: str, tail: str, limit: int, budget: int) -> Column:
            terms = issue_terms(heading_value(t, ISSUE_LINES[lang]))
            listed = F.when(F.size(terms) > 0, clipped(F.concat(F.lit(head), F.array_join(terms, glue), F.lit(tail)), limit)).otherwise("")
            block = _filled(F.transform(sentences(heading_block(t, SUMMARY_HEADS[lang], SUMMARY_STOPS[lang])), lambda s: summary_sentence(s, language)))
            return _first([listed, clipped(_joined_head(block, budget), 280)])

        plain = _filled(F.transform(sentences(t), lambda s: summary_sentence(s, language)))
        fallback = clipped(F.when(_some(language) == "pt", _joined_head(plain, 1)).otherwise(_joined_head(plain, 2)), 220)
        ruled = _by_language(language, branch("zh", "本案聚焦", "、", "。", 220, 2), branch("pt", "O caso discute ", "; ", ".", 240, 1))
        return F.when(t == "", "").otherwise(_first([ruled, fallback, clipped(_some(case_type), 120)]))

    return text.let(text.squeeze(_some(c)), of)


def holding_score(sentence: Column, language: Column) -> Column:
    """4 per primary word, 1 per secondary, 2 off beyond 260 or below 8 characters."""
    def of(s: Column) -> Column:
        low = F.lower(s)
        points = lambda lang: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") * n for words, n in zip(HOLDING[lang], (4, 1), strict=True) for w in words])
        return _by_language(language, points("zh"), points("pt")) - F.when((F.length(s) > 260) | (F.length(s) < 8), 2).otherwise(0)

    return text.let(text.squeeze(sentence), of)


def best_holding(language: Column, c: Column) -> Column:
    """struct(score, sentence): best holding sentence of the second half (of all, if four or fewer); by score, shortness, place.

    Without a sentence above 0 the last two sentences stand in, with a null score.
    """
    def of(s: Column) -> Column:
        skip = F.when(F.size(s) > 4, F.floor(F.size(s) / 2).cast("int")).otherwise(0)
        # the words are looked for once a sentence
        rated = F.transform(s, lambda x, i: F.struct(F.when(i >= skip, holding_score(x, language)).otherwise(0).alias("score"), (-F.length(x)).alias("short"), i.alias("i"), x.alias("s")))
        best = F.array_max(F.filter(rated, lambda r: r["score"] > 0))
        tail = F.array_join(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2), " ")
        return F.when(F.size(s) > 0, text.let(best, lambda b: F.struct(b["score"].alias("score"), clipped(summary_sentence(F.coalesce(b["s"], tail), language), 220).alias("sentence"))))

    return text.let(sentences(text.squeeze(c)), of)


def best_holdings(df: DataFrame, keys: list[str], language: str, c: str) -> DataFrame:
    """(keys..., score, sentence) of every text with a sentence: ``best_holding`` over rows of sentences.

    Scores are compiled here, where an expression over an array is interpreted; the
    sentences of a text meet again in a map-side maximum.
    """
    x = df.select(*keys, F.col(language).alias("__lang"), sentences(text.squeeze(F.col(c))).alias("__s"), F.monotonically_increasing_id().alias("__row")).where("size(__s) > 0")
    skip = F.when(F.size("__s") > 4, F.floor(F.size("__s") / 2).cast("int")).otherwise(0)
    tail = F.array_join(F.slice("__s", F.greatest(F.size("__s") - 1, F.lit(1)), 2), " ")
    rows = x.select(*keys, "__lang", "__row", skip.alias("__skip"), tail.alias("__tail"), F.posexplode("__s").alias("__i", "__x"))
    low, lang = F.lower("__x"), F.coalesce("__lang", F.lit(""))
    points = lambda k: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") * n for words, n in zip(HOLDING[k], (4, 1), strict=True) for w in words])
    rows = rows.withColumn("__score", F.when(F.col("__i") < F.col("__skip"), 0).otherwise(F.when(lang == "zh", points("zh")).otherwise(points("pt")) - F.when((F.length("__x") > 260) | (F.length("__x") < 8), 2).otherwise(0)))
    # without a sentence above 0 the last two stand in: they are carried by the first row
    good = F.col("__score") > 0
    last = F.when(F.col("__i") == 0, F.col("__tail"))
    best = F.max(F.when(good, F.struct("__score", (-F.length("__x")).alias("__short"), "__i", "__x"))).alias("b")
    g = rows.groupBy(*keys, "__lang", "__row").agg(best, F.max(last).alias("__t"))
    return g.select(*keys, F.col("b.__score").alias("score"), clipped(summary_sentence(F.coalesce("b.__x", "__t"), F.col("__lang")), 220).alias("sentence"))


def holding(language: Column, c: Column) -> Column:
    """The sentence of ``best_holding``."""
    return _some(best_holding(language, c)["sentence"])


def legal_basis(language: Column, c: Column, limit: int = 8) -> Column:
    """Articles in the form of the language, each once whatever its case, ``limit`` at most (the field's own size)."""
    t = text.squeeze(_some(c))
    zh = F.transform(F.regexp_extract_all(t, F.lit(ZH_ARTICLE)), lambda x: F.regexp_replace(x, r"\s+", ""))
    pt = F.transform(F.regexp_extract_all(t, F.lit(PT_ARTICLE)), lambda x: F.lower(text.squeeze(x)))
    return text.distinct_ignoring_case(_by_language(language, zh, pt), limit)


def disputed_issues(language: Column, c: Column, case_type: Column) -> Column:
    """Terms of the first issue pattern that gives any, eight at most, else the type."""
    other = F.when(_some(case_type) != "", F.array(case_type)).otherwise(_empty())

    def of(t: Column) -> Column:
        def branch(lang: str) -> Column:
            lists = [issue_terms(F.regexp_extract(t, f"(?iu){p}", 1)) for p in ISSUE_PATTERNS[lang]]
            return F.coalesce(*[F.when(F.size(x) > 0, F.slice(x, 1, 8)) for x in lists], other)

        return _by_language(language, branch("zh"), branch("pt"))

    return text.let(text.squeeze(_some(c)), of)


def plain_summary(language: Column, c: Column) -> Column:
    """First rule set: the summary block, else the first two sentences."""
    def of(t: Column) -> Column:
        zh, pt = (first_block(t, PLAIN_SUMMARY_HEADS[k], PLAIN_SUMMARY_STOPS[k]) for k in ("zh", "pt"))
        block = F.when(_some(language) == "zh", zh).when(_some(language) == "pt", pt).otherwise("")
        return _first([clipped(block, 280), clipped(_joined_head(sentences(t), 2), 280)])

    return text.let(text.squeeze(_some(c)), of)


def plain_holding(language: Column, c: Column) -> Column:
    """First rule set: the last sentence with a key word, else the last."""
    def of(s: Column) -> Column:
        hits = F.filter(s, lambda x: _by_language(language, _has(F.lower(x), PLAIN_HOLDING["zh"]), _has(F.lower(x), PLAIN_HOLDING["pt"])))
        return clipped(F.coalesce(F.try_element_at(hits, F.lit(-1)), F.try_element_at(s, F.lit(-1)), F.lit("")), 220)

    return text.let(sentences(text.squeeze(_some(c))), of)


def draft_holding(c: Column) -> Column:
    """Draft rule set: the first sentence with a key word, else the text, 180 characters."""
    t = text.squeeze(_some(c))
    hits = F.filter(sentences(t, PLAIN_END, ""), lambda x: _has(x, DRAFT_HOLDING))
    return clipped(F.coalesce(F.try_element_at(hits, F.lit(1)), t), 180)


def v1_summary(c: Column) -> Column:
    """Block of the facts, else two sentences; 320 characters."""
    return _first([clipped(first_block(c, *V1_SUMMARY), 320), clipped(_joined_head(sentences(c, V1_END), 2), 320)])


def v1_holding(c: Column) -> Column:
    """The last three sentences with a key word, else the last two; 260 characters."""
    def of(s: Column) -> Column:
        last = lambda a, n: F.array_join(F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n), " ")
        hits = F.filter(s, lambda x: _has(F.lower(x), V1_HOLDING))
        return clipped(F.when(F.size(hits) > 0, last(hits, 3)).otherwise(last(s, 2)), 260)

    return text.let(sentences(c, V1_END), of)


def v1_issues(c: Column, case_type: Column) -> Column:
    """Terms of all issue patterns and the type, each once, eight at most."""
    parts = [F.split(F.regexp_extract(_some(c), f"(?iu){p}", 1), SEPARATORS) for p in V1_ISSUES]
    every = F.transform(F.concat(*parts, F.array(_some(case_type))), text.squeeze)
    return text.distinct_ignoring_case(every, 8)


def v1_legal_basis(c: Column) -> Column:
    """Articles of both languages, each once, twelve at most."""
    t = _some(c)
    zh = F.transform(F.regexp_extract_all(t, F.lit("(?U)" + ZH_ARTICLE)), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    pt = F.transform(F.regexp_extract_all(t, F.lit("(?U)" + PT_ARTICLE)), text.squeeze)
    return text.distinct_ignoring_case(F.concat(zh, pt), 12)


def v1_reasoning(c: Column) -> Column:
    """Block of the reasons, else up to three sentences with a key word, else the first three; 360 characters."""
    def of(s: Column) -> Column:
        hits = F.filter(s, lambda x: _has(x, REASONS))
        return clipped(F.when(F.size(hits) > 0, _joined_head(hits, 3)).otherwise(_joined_head(s, 3)), 360)

    return _first([clipped(first_block(c, *V1_REASONING), 360), text.let(sentences(c, V1_END), of)])


def v1_point(c: Column) -> Column:
    """Value of the first point pattern, else the first sentence with a key word; 220 characters."""
    values = [clipped(F.regexp_extract(_some(c), f"(?iu){p}", 1), 220) for p in V1_POINTS]
    hit = F.try_element_at(F.filter(sentences(c, V1_END), lambda x: _has(x, POINTS)), F.lit(1))
    return _first([*values, clipped(_some(hit), 220)])


def medium_text(c: Column, head: int = 2600, reasoning: int = 2400, tail: int = 1800) -> Column:
    """Head, reasoning blocks and tail of a text for a prompt of medium length; '' for an empty text."""
    t = _some(c)
    blocks = clipped(F.array_join(all_blocks(t, *V1_REASONING), " "), reasoning)
    end = F.when(F.length(t) > tail, F.right(t, F.lit(tail))).otherwise("")
    parts = F.concat_ws("\n\n", text.squeeze(F.substring(t, 1, head)), blocks, text.squeeze(end))
    return F.when(t == "", "").otherwise(clipped(parts, head + tail + reasoning))


def long_snippets(c: Column, limit: int = 5200, budget: int = 2200) -> Column:
    """Head, one block of each heading family, telling sentences until ``budget`` characters, and tail, for a long prompt."""
    t = _some(c)
    families = [F.coalesce(F.try_element_at(all_blocks(t, h, s), F.lit(1)), F.lit("")) for h, s in SNIPPET_HEADS]

    def add(held: Column, s: Column) -> Column:
        joined = F.when(held == "", s).otherwise(F.concat(held, F.lit(" "), s))
        return F.when((F.length(held) < budget) & _has(F.lower(s), SNIPPET_WORDS), joined).otherwise(held)

    telling = F.aggregate(sentences(t, V1_END), F.lit(""), add)
    parts = _filled(F.transform(F.array(F.substring(t, 1, 1800), *families, telling, F.right(t, F.lit(1500))), text.squeeze))
    return F.when(t == "", "").otherwise(clipped(F.array_join(parts, "\n\n"), limit))


def head_lines(c: Column, n: int = 20) -> Column:
    """First n non-blank lines, squeezed."""
    return F.slice(_filled(F.transform(F.split(_some(c), "\n"), text.squeeze)), 1, n)


def _first_in_lines(lines: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that the first possible line matches; null where none does."""
    found = F.transform(lines, lambda line: _first([F.trim(F.regexp_extract(line, p, 1)) for p in patterns]))
    return F.try_element_at(_filled(found), F.lit(1))


def detail_case_number(c: Column) -> Column:
    """Case number in the first twenty lines: labelled, as a line, or anywhere."""
    return _first_in_lines(head_lines(c), (
        r"(?:案件編號|卷宗編號|編號|案號)\s*[:：]?\s*(?:第)?\s*([0-9]{1,6}/[0-9]{4})\s*號?", r"^第\s*([0-9]{1,6}/[0-9]{4})\s*號(?:.*案)?$", r"(?U)\b([0-9]{1,6}/[0-9]{4})\b",
    ))


def detail_date(c: Column) -> Column:
    """Decision date in the first twenty lines: labelled, or anywhere."""
    return _first_in_lines(head_lines(c), (
        r"(?:裁判日期|判決日期|日期)\s*[:：]\s*([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", r"(?:裁判日期|判決日期|日期)\s*[:：]\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})",
        r"(?U)\b([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)\b", r"(?U)\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b",
    ))


def looks_like_title(c: Column) -> Column:
    """2 to 120 characters, no bare case number, no date label and no letterhead."""
    v = text.squeeze(_some(c))
    return (F.length(v) >= 2) & (F.length(v) <= 120) & ~v.rlike("^[0-9]{1,6}/[0-9]{4}$") & ~_has(v, NO_TITLE)


def detail_title(c: Column) -> Column:
    """Value of the first title-like labelled line, else the first title-like of the ten first lines before a stop; null where none is."""
    lines = head_lines(c)
    key, value = (lambda x: text.squeeze(F.regexp_extract(x, r"^([^:：]{1,20})\s*[:：]\s*(.+)$", 1))), (lambda x: text.squeeze(F.regexp_extract(x, r"^([^:：]{1,20})\s*[:：]\s*(.+)$", 2)))
    labelled = F.transform(lines, lambda x: F.when((key(x) != "") & ~key(x).isin(*NO_TITLE_KEYS) & looks_like_title(value(x)), value(x)).otherwise(""))
    ten = F.slice(lines, 1, 10)
    stop = F.array_min(F.filter(F.transform(ten, lambda x, i: F.when(_has(x, TITLE_STOPS), i)), lambda i: i.isNotNull()))
    open_lines = F.slice(ten, F.lit(1), F.coalesce(stop, F.size(ten)))
    plain = F.filter(open_lines, lambda x: looks_like_title(x) & ~x.rlike("[0-9]{1,6}/[0-9]{4}"))
    return F.coalesce(F.try_element_at(_filled(labelled), F.lit(1)), F.try_element_at(plain, F.lit(1)))


def labelled_value(c: Column, keys: tuple[str, ...], stops: tuple[str, ...] = ()) -> Column:
    """Value behind the first key in the squeezed text, up to the earliest stop label; null where missing."""
    def of(t: Column) -> Column:
        def cut(v: Column) -> Column:
            at = F.array_min(F.filter(F.array(*[F.regexp_instr(v, F.lit(rf"(?iu)\s{s}\s*[:：]?")) for s in stops]), lambda n: n > 0)) if stops else F.lit(None)
            return F.trim(F.when(at.isNotNull(), F.substr(v, F.lit(1), at - 1)).otherwise(v))

        return F.nullif(_first([cut(F.regexp_extract(t, rf"(?iu){k}\s*[:：]?\s*(.+)", 1)) for k in keys]), F.lit(""))

    return text.let(text.squeeze(_some(c)), of)


def labelled_line(lines: Column, keys: tuple[str, ...]) -> Column:
    """Value behind any of the keys in the first line that has one; null where none has."""
    return _first_in_lines(lines, tuple(rf"(?iu){k}\s*[:：]?\s*(.+)$" for k in keys))


def clean_case_type(c: Column) -> Column:
    """Leading marks off; null for a blank or a bare year behind a slash."""
    v = text.squeeze(_some(c))
    bare = text.squeeze(F.regexp_replace(v, "^[-:：,，.]+", ""))
    return F.when(~v.rlike(r"^/\d{2,4}$") & ~bare.rlike(r"^/\d{2,4}$") & (bare != ""), bare)


def valid_case_type(c: Column) -> Column:
    """Neither blank nor a bare year behind a slash."""
    v = text.squeeze(_some(c))
    return (v != "") & ~v.rlike(r"^/\d{2,4}$")


CASE_IN_LINE, PREFIXED_CASE = r"(?U)\b\d{1,6}/\d{4}\b", r"(?iU)\b[A-Z]{1,8}-?\d{1,6}/\d{2,4}\b"
ANY_DATE = r"(\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}年\d{1,2}月\d{1,2}日)"


def case_number_and_type(lines: Column, whole: Column) -> Column:
    """struct(case_number, case_type): number of the first line that has one, type behind it, else before it, else in the next line."""
    number_of = lambda x: _first([F.regexp_extract(x, p, 0) for p in (CASE_IN_LINE, PREFIXED_CASE)])

    def of(all_lines: Column) -> Column:
        marked = F.transform(all_lines, lambda x, i: F.struct(number_of(x).alias("n"), x.alias("x"), F.coalesce(F.try_element_at(all_lines, i + 2), F.lit("")).alias("next")))
        return text.let(F.try_element_at(F.filter(marked, lambda r: r["n"] != ""), F.lit(1)), found)

    def found(r: Column) -> Column:
        place = F.instr(r["x"], r["n"])
        before = clean_case_type(F.substr(r["x"], F.lit(1), place - 1))
        nxt = clean_case_type(r["next"])
        kind = F.coalesce(
            clean_case_type(F.substr(r["x"], place + F.length(r["n"]))), F.when(~before.rlike(ANY_DATE), before), F.when(~nxt.rlike(CASE_IN_LINE) & ~nxt.rlike(ANY_DATE), nxt)
        )
        return F.struct(F.coalesce(r["n"], F.nullif(number_of(_some(whole)), F.lit(""))).alias("case_number"), F.when(r["n"].isNotNull(), kind).alias("case_type"))

    return text.let(lines, of)


def first_match(c: Column, patterns: tuple[str, ...], group: int = 0) -> Column:
    """The first pattern's match; null where no pattern matches."""
    return F.nullif(_first([text.squeeze(F.regexp_extract(_some(c), p, group)) for p in patterns]), F.lit(""))


def court_of(c: Column) -> Column:
    """Court a page names, by the order of instances looked for; unknown where none is."""
    low = F.lower(_some(c))
    return (
        F.when(F.contains(c, F.lit("中級法院")) | F.contains(low, F.lit("tribunal de segunda")), "中級法院")
        .when(F.contains(c, F.lit("終審法院")) | F.contains(low, F.lit("tribunal de última instância")), "終審法院")
        .when(F.contains(c, F.lit("初級法院")) | F.contains(low, F.lit("tribunal judicial de base")), "初級法院")
        .otherwise("unknown")
    )


def around(c: Column, markers: tuple[str, ...], before: int = 12, behind: int = 16) -> Column:
    """Text around the first of the markers that occurs; null where none does."""
    cuts = [F.when(F.instr(c, F.lit(m)) > 0, F.substr(c, F.greatest(F.instr(c, F.lit(m)) - before, F.lit(1)), F.least(F.instr(c, F.lit(m)) - 1, F.lit(before)) + behind)) for m in markers]
    return text.squeeze(F.coalesce(*cuts))


def to_traditional(c: Column, pairs: dict[str, str]) -> Column:
    """struct(text, changed, script): simplified signs to traditional ones, the longest first; other texts pass."""
    def of(t: Column) -> Column:
        out = t
        for k, v in sorted(pairs.items(), key=lambda kv: -len(kv[0])):
            out = F.replace(out, F.lit(k), F.lit(v))
        han = t.rlike("[㐀-鿿]")
        return F.struct(F.when(han, out).otherwise(t).alias("text"), F.coalesce(han & (out != t), F.lit(False)).alias("changed"), F.when(han, "traditional_chinese").otherwise("not_applicable").alias("script"))

    return text.let(c, of)


def evaluation_text(c: Column) -> Column:
    """Small letters, marks to spaces, squeezed."""
    t = text.squeeze(F.lower(_some(c)))
    return text.squeeze(F.regexp_replace(t, r"[*\-_,.;:!?'\"()\[\]{}]+", " "))


def evaluation_tokens(c: Column) -> Column:
    """Distinct runs of ASCII letters, figures and Han signs of the evaluation form."""
    return F.array_distinct(F.regexp_extract_all(evaluation_text(c), F.lit(f"([a-z0-9{text.HAN}]+)")))


def usage_tokens(c: Column) -> Column:
    """Han runs of two signs or more, then runs of Latin letters, figures and reference marks."""
    t = text.squeeze(F.lower(_some(c)))
    return F.concat(F.regexp_extract_all(t, F.lit(f"([{text.HAN}]{{2,}})")), F.regexp_extract_all(t, F.lit("([a-z0-9_./-]+)")))
