"""Calls of an external text model per row, with retries and a fallback; the backend is a plain function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def generate(df: DataFrame, id_col: str, prompt_col: str, backend: Callable[[str], str], retries: int = 2, fallback: Callable[[str], str] | None = None) -> DataFrame:
    """(id, output, attempts, source): the backend's answer after at most ``retries`` further tries, else the fallback's.

    A null prompt is not sent and gives a null output with source ``skipped``; when
    all fails the source is ``failed``.
    """
    schema = pa.schema([("id", pa.string()), ("output", pa.string()), ("attempts", pa.int32()), ("source", pa.string())])

    def ask(prompt: str | None) -> tuple[str | None, int, str]:
        if prompt is None:
            return None, 0, "skipped"
        for n in range(1, retries + 2):
            try:
                return backend(prompt), n, "model"
            except Exception:  # noqa: BLE001  any failure of a call counts as one try
                continue
        try:
            return (fallback(prompt), retries + 1, "fallback") if fallback else (None, retries + 1, "failed")
        except Exception:  # noqa: BLE001
            return None, retries + 1, "failed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], schema.field(i + 1).type) for i in range(3)]], schema=schema)

    src = df.select(df[id_col].cast("string").alias("id"), df[prompt_col].cast("string").alias("p"))
    return src.mapInArrow(run, "id string, output string, attempts int, source string")
