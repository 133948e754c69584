"""Token ids of a public byte-level tokenizer, word by word.

Distinct-word table. Spark splits every text into the words of the tokenizer. A
block of documents (about ``BLOCK_WORDS`` words; a longer document is one by
itself) is written as its distinct words and, per position, the number of the
word. The distinct words of all blocks form the word table, of which each word is
encoded once; a join gives every block the ids of its words, and the numbers put
them back by position. Only the distinct words of a block are ever shuffled, a
frequent word once a block, so that a block and not a position is the unit of the
join; AQE splits the key of a word that nearly all blocks hold.

Decoding joins every position with the id-to-piece table.

Defined results: null and empty texts give an empty list; strings that look like
special tokens are plain text; repeated rows each give their ids; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import spread, written

TOKENIZERS = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: words of the documents in one block
BLOCK_WORDS = 200_000


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# Fixed value: the word pattern of the byte_bpe_50k vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the parts between blanks: boundaries of words too, whatever the signs inside are
_PARTS = r"(?U) ?\S+|\s+(?!\S)|\s+"


def _encoder(folder: str, name: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=WORD_PATTERN, mergeable_ranks=_ranks(os.path.join(folder, f"{name}.tiktoken")), special_tokens={})


def words(c: Column) -> Column:
    """The words of a text in order, nothing left out.

    The classes of the JVM may be older than those of the tokenizer: texts with
    signs unknown to it are cut at blanks only, and the encoder cuts further.
    """
    known = F.regexp_extract_all(c, F.lit("(?U)" + WORD_PATTERN), F.lit(0))
    return F.when(c.rlike(r"\p{Cn}"), F.regexp_extract_all(c, F.lit(_PARTS), F.lit(0))).otherwise(known)


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: their ids, words per document, number of the word at each position, distinct words."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # a block ends where the running number of words passes a multiple of BLOCK_WORDS
        part = (np.cumsum(sizes) - sizes) // BLOCK_WORDS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo == hi:
                continue
            d = b.column(1).slice(lo, hi - lo).flatten().dictionary_encode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    *[pa.array([x], f.type) for x, f in zip((b.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi], pa.int32()), d.indices.cast(pa.int32()), d.dictionary), list(_BLOCK_SCHEMA)[1:], strict=True)],
                ],
                schema=_BLOCK_SCHEMA,
            )
            number += 1


def word_table(entries: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(word, ids) of every distinct word, each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(folder, name)
        for b in batches:
            ids = enc.encode_ordinary_batch(b.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return entries.select("word").distinct().mapInArrow(run, "word string, ids array<int>")


_IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each document of a block, from the ids of its distinct words and the numbers of its positions."""
    for b in batches:
        for k in range(b.num_rows):
            doc_ids, sizes, at, found = (b.column(c)[k].values for c in ("doc_ids", "sizes", "at", "found"))
            doc_ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
            if found is None or not len(at):
                offsets, flat = np.zeros(len(doc_ids) + 1, np.int32), pa.array([], pa.int32())
            else:
                no, ids = found.field(0).to_numpy(zero_copy_only=False), found.field(1)
                row = np.empty(len(no), np.int64)
                row[no] = np.arange(len(no))
                tokens = ids.take(pa.array(row[at.to_numpy(zero_copy_only=False)]))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))])
                offsets, flat = ends[doc_ends].astype(np.int32), tokens.flatten().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], schema=_IDS_SCHEMA)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """One row (doc_id, ids) per row of ``df``."""
    src = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("t"))
    split = spread(src).select("doc_id", words(F.col("t")).alias("words"))
    # written once: the numbers of the blocks stay the same whatever is computed again
    blocks = written(split.mapInArrow(_blocks, "block bigint, doc_ids array<bigint>, sizes array<int>, at array<int>, words array<string>"))
    entries = blocks.select("block", F.posexplode("words").alias("no", "word"))
    ids = entries.join(word_table(entries, name, folder), "word").select("block", F.struct("no", "ids").alias("x"))
    # a group is one block, of bounded size
    found = ids.groupBy("block").agg(F.collect_list("x").alias("found"))
    return blocks.select("block", "doc_ids", "sizes", "at").join(found, "block", "left").mapInArrow(_by_position, "doc_id bigint, ids array<int>")


def pieces(spark: SparkSession, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The vocabulary as a table (id, piece binary); its size is that of the vocabulary (about 50,000 rows)."""
    ranks = _ranks(os.path.join(folder, f"{name}.tiktoken"))
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks, pa.binary())}))


def decode(ids: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) back from ids, by a join of every position with the vocabulary; an empty list gives ''."""
    places = ids.select(F.col(id_col).alias("doc_id"), F.posexplode_outer("ids").alias("pos", "id"))
    got = places.join(F.broadcast(vocabulary), "id", "left")  # bounded: the vocabulary is a fixed file
    hexed = F.struct("pos", F.hex("piece").alias("h"))
    return got.groupBy("doc_id").agg(F.array_sort(F.collect_list(hexed)).alias("ps")).select(
        "doc_id", F.decode(F.unhex(F.array_join(F.transform("ps", lambda p: p["h"]), "")), "UTF-8").alias("text")
    )
