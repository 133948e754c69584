import pytest

from foliant.operators.multivalue import Segmenter, certain_values, split_values


@pytest.mark.parametrize("field, want", [
    (None, []), ("", []), ("  ", []), (";;", []), ("-", []),
    ("Ana Sá-Melo", ["Ana Sá-Melo"]),
    ("Ana; Rui ;", ["Ana", "Rui"]),
    ("Ana e Dr.ª Rui de Melo", ["Ana", "Dr.ª Rui de Melo"]),
    ("Ana (1.º adjunto, substituto), Rui (adjunta; em exercício)", ["Ana (1.º adjunto, substituto)", "Rui (adjunta; em exercício)"]),
    ('"Melo, Ana";"Rui ""Zito"" Sá"', ["Melo, Ana", 'Rui "Zito" Sá']),
    ('["Ana", "Rui, o velho"]', ["Ana", "Rui, o velho"]),
    ("1) Ana 2) Rui", ["Ana", "Rui"]), ("1.º Ana\n2.º Rui", ["Ana", "Rui"]), ("(1) 甲乙；(2) 丙丁；", ["甲乙", "丙丁"]),
    ("甲乙丙、丁戊己及庚辛壬", ["甲乙丙", "丁戊己", "庚辛壬"]), ("甲乙丙 丁戊己", ["甲乙丙", "丁戊己"]),
    ("甲乙丙法官與丁戊己法官（第一助審，代任）", ["甲乙丙法官", "丁戊己法官（第一助審，代任）"]),
    ('"aberto, sem fim', ['"aberto', "sem fim"]),
])
def test_split(field, want):
    assert Segmenter([]).split(field) == want


def test_known_values_protect_their_delimiters():
    known = certain_values('"Melo e Sá, Ana";"Rui"')
    assert known == ["Melo e Sá, Ana"]
    s = Segmenter(known)
    assert s.split("Melo e Sá, Ana; Rui e Zé") == ["Melo e Sá, Ana", "Rui", "Zé"]


def test_rows(spark):
    rows = [(1, "Ana; Rui", "x"), (1, "Ana; Rui", "x"), (2, None, "x"), (3, '"Melo, Ana"', "x"), (4, "Melo, Ana | Rui", "x")]
    df = spark.createDataFrame(rows, "ord bigint, assistant_judges string, judge string")
    got = sorted((r.ord, r.pos, r.judge) for r in split_values(df).collect())
    assert got == [(1, 1, "Ana"), (1, 1, "Ana"), (1, 2, "Rui"), (1, 2, "Rui"), (3, 1, "Melo, Ana"), (4, 1, "Melo, Ana"), (4, 2, "Rui")]
    assert split_values(df.limit(0)).count() == 0
