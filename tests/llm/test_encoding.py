import os

import pytest

from foliant.llm import encoding

TEXTS = ["", None, "O art. 5.º do C.C.", "<|endoftext|> 內部登記編號為0000003376號，於2009年", "don't  go\n\n  \t x", "ｆｕｌｌ　é 👩‍⚖️", "a" * 5000]
pytestmark = pytest.mark.skipif(not os.path.exists(encoding.TOKENIZERS), reason="no vocabulary files")


def test_ids_equal_the_library_and_decode_back(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = encoding.encode(df)
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in encoding.decode(got, encoding.pieces(spark)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}


def test_small_word_table_gives_the_same_ids(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"palavra{i} igual {i % 7}") for i in range(1500)], "doc_id bigint, text string")
    a = {r.doc_id: r.ids for r in encoding.encode(df).collect()}
    assert len(a) == 1500 and all(a.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encoding.encode(df).count() == 0
