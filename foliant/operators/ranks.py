"""Numbers 1, 2, ... within a key, however many rows a key has.

A window over the key would gather a hot key in one task. Here rows are parted by
range of (key, order), numbered inside each part, and a part's numbers begin where
those of the same key end in the parts before it: a sum over (key, part) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.sources.tables import cut_lineage


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row within its keys by ``order``, from 1; null keys are a key of their own."""
    parted = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__ranks_part", F.spark_partition_id())
    parted = cut_lineage(parted)  # the parts stay the same for both uses
    # groups of (key, part) are bounded by the size of a part
    inside = parted.withColumn("__ranks_inside", F.row_number().over(W.partitionBy(*keys, "__ranks_part").orderBy(*order)))
    counts = parted.groupBy(*keys, "__ranks_part").agg(F.count("*").alias("__ranks_rows"))
    before = F.coalesce(F.sum("__ranks_rows").over(W.partitionBy(*keys).orderBy("__ranks_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"__ranks_k{i}") for i, k in enumerate(keys)], F.col("__ranks_part").alias("__ranks_p"), before.alias("__ranks_before"))
    same = F.col("__ranks_part") == F.col("__ranks_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__ranks_k{i}"))
    return inside.join(offsets, same).select(*df.columns, (F.col("__ranks_inside") + F.col("__ranks_before")).cast("int").alias(name))
