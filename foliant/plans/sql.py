"""Pieces of DuckDB SQL that mirror the column functions, for the checking queries."""

from __future__ import annotations

from foliant.functions import lexicon, text


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def half(c: str) -> str:
    """Half-width form."""
    return f"translate({c}, {q(text.FULL_WIDTH)}, {q(text.HALF_WIDTH)})"


def _compatible() -> dict[str, str]:
    """Compatibility forms of the signs that occur in texts of this kind, by rule."""
    import unicodedata as ud

    ranges = [(0xA0, 0x100), (0x2000, 0x2070), (0x2070, 0x2190), (0x2460, 0x2474), (0x2E80, 0x3001), (0xF900, 0xFB07), (0xFE30, 0xFE70), (0xFF01, 0xFFEF)]
    return {chr(i): f for a, z in ranges for i in range(a, z) if (f := ud.normalize("NFKC", chr(i))) != chr(i)}


def nfkc(c: str) -> str:
    """Unicode compatibility form."""
    table = _compatible()
    one = {k: v for k, v in table.items() if len(v) == 1}
    t = f"translate({c}, {q(''.join(one))}, {q(''.join(one.values()))})"
    for k, v in table.items():
        if len(v) > 1:
            t = f"replace({t}, {q(k)}, {q(v)})"
    return f"nfc_normalize({t})"


def squeeze(c: str) -> str:
    """Blanks squeezed and trimmed."""
    return f"trim(regexp_replace({c}, {q(text.BLANK + '+')}, ' ', 'g'))"


def case_key(c: str) -> str:
    """Case number for equality."""
    return f"regexp_replace(lower({half(c)}), {q(text.BLANK)}, '', 'g')"


def ranking_text(c: str) -> str:
    """Letters and figures only."""
    return f"trim(regexp_replace(regexp_replace(lower({nfkc(c)}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"


def listed(items) -> str:
    """SQL list of strings."""
    return "[" + ", ".join(q(x) for x in items) + "]"


def mixed_tokens(c: str) -> str:
    """Token list of a mixed text."""
    t = f"trim(lower({nfkc(c)}))"
    doubled = f"regexp_replace({t}, '([^\\p{{L}}\\p{{N}}_/.])', '\\1\\1', 'g')"
    cases = (
        f"list_transform(regexp_extract_all({doubled}, {q('(?:^|[^\\p{L}\\p{N}_])(' + text.CASE_REFERENCE + ')(?:$|[^\\p{L}\\p{N}_])')}, 1), "
        "lambda x: replace(regexp_replace(x, '\\s+', '', 'g'), 'proc.', 'proc'))"
    )
    words = f"regexp_extract_all({t}, {q(text.LATIN_WORD)})"
    twins = f"list_filter(list_transform({words}, lambda w: nullif(translate(w, {q(text.ACCENTED)}, {q(text.PLAIN)}), w)), lambda w: w IS NOT NULL)"
    han = (
        f"flatten(list_transform(regexp_extract_all({t}, '[{text.HAN}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE "
        f"[r] || list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) || list_filter({listed(lexicon.HINTS)}, lambda h: contains(r, h)) END))"
    )
    return f"coalesce({cases}, []) || coalesce(regexp_extract_all({t}, {q(text.REFERENCE)}), []) || coalesce({words}, []) || coalesce({twins}, []) || coalesce({han}, [])"


def light_tokens(c: str) -> str:
    """Latin and figure runs, Han pairs."""
    t = f"lower({nfkc(c)})"
    han = (
        f"flatten(list_transform(regexp_extract_all({t}, '[{text.HAN}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE "
        "list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    )
    return f"coalesce(regexp_extract_all({t}, '[a-zà-öø-ÿ0-9]+'), []) || coalesce({han}, [])"


def present(c: str) -> str:
    """Neither null nor blank."""
    return f"coalesce(trim({c}) <> '', false)"


def bm25(docs: str, doc_id: str, fields: dict[str, tuple[str, float]], queries: str, order: str, k: int, bonus: str = "") -> str:
    """Top k per query: ``docs`` and ``queries`` are relations, fields map a name to (token list, weight); queries give (query_id, tokens).

    ``bonus`` names a column of the documents that adds 4 where it holds a case reference of the query.
    """
    extra = ""
    if bonus:
        number = f"regexp_replace(lower({bonus}), {q(text.BLANK)}, '', 'g')"
        extra = (
            f" UNION ALL SELECT query_id, d.{doc_id} AS id, 4.0 AS score FROM (SELECT query_id, list_filter(tokens, lambda t: contains(t, '/') AND regexp_matches(t, '[0-9]')) AS refs FROM ({queries})) z, {docs} d "
            f"WHERE len(list_filter(refs, lambda t: contains({number}, t))) > 0"
        )
    union = " UNION ALL ".join(f"SELECT {doc_id} AS id, '{n}' AS field, {w} AS w, unnest({t}) AS term FROM {docs}" for n, (t, w) in fields.items())
    return f"""
WITH tok AS ({union}),
 post AS (SELECT id, field, w, term, count(*) AS tf FROM tok GROUP BY ALL),
 len AS (SELECT d.{doc_id} AS id, coalesce(l.n, 0) AS len FROM {docs} d LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) l ON l.id = d.{doc_id}),
 whole AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len),
 dfs AS (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM ({queries})) GROUP BY ALL),
 s0 AS (SELECT query_id, post.id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / greatest(avgdl, 1)))) AS score
       FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN len ON len.id = post.id CROSS JOIN whole GROUP BY ALL),
 s AS (SELECT query_id, id, sum(score) AS score FROM (SELECT query_id, id, score FROM s0{extra}) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE score > 0)
SELECT query_id, id AS {order}, rank, round(score, 4) AS score FROM r WHERE rank <= {k}"""
