"""Table access and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Where that setting is absent a
    local master gets a temporary folder; on a cluster it is an error, as a folder of
    one machine is none to the others. Tables written there go with the folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "foliant-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows written as a compressed table to the shared folder, and read from there (lineage cut, columns pruned)."""
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: rows of a side that may be broadcast after they have been counted
BROADCAST_ROWS = 500_000


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, computed once and counted; marked for broadcast only if there are no more than ``most``."""
    from pyspark.sql import functions as F

    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores, where a small file would leave cores idle.

    Large inputs have more partitions than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
