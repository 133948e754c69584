"""Incremental crawl records as streams: seen-set de-duplication, page loops, convergence, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranks import numbered


def unseen(stream: DataFrame, key: str, seen: DataFrame | None = None, time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Rows of a stream whose key is new: not in the table of seen keys, and not earlier in the stream.

    With ``time`` the state is dropped behind the watermark, so it does not grow for
    ever: a key met again later than ``delay`` is then only known from the table of
    seen keys. Without it keys stay in the state store for ever, as a crawl may meet a
    record again at any time.
    """
    if seen is not None:
        stream = stream.join(seen.select(key).distinct(), key, "left_anti")
    stream = stream.where(F.col(key).isNotNull())
    return unseen_within(stream, key, time, delay) if time else stream.dropDuplicates([key])


def unseen_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The same with state dropped behind the watermark; a record met again later than that counts as new."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, delay: str, length: str, by: list[str]) -> DataFrame:
    """Records per tumbling event-time window and key; late ones beyond the delay are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), *by).count()


def sliding_counts(stream: DataFrame, time: str, delay: str, length: str, slide: str, by: list[str]) -> DataFrame:
    """Records per sliding event-time window and key."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length, slide), *by).count()


def session_counts(stream: DataFrame, time: str, delay: str, gap: str, by: list[str]) -> DataFrame:
    """Records per session of a key: a pause longer than ``gap`` ends one."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).count()


def append_batches(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Write a stream to a table, each key of a micro-batch once (audit log, manifest); runs until the input is read.

    Every micro-batch has a folder of its own (``batch_id=N``), which a batch that is
    run again overwrites, so a replay appends nothing twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_per_round(records: DataFrame, rounds: str, key: str) -> DataFrame:
    """(round, records, new_keys): keys first met in each round."""
    first = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(rounds).alias(rounds))
    fresh = first.groupBy(rounds).agg(F.count("*").alias("new_keys"))
    return records.groupBy(rounds).agg(F.count("*").alias("records")).join(fresh, rounds, "left").fillna(0, ["new_keys"])


def convergence(per_round: DataFrame, rounds: str, quiet: int = 2, most: int = 6) -> DataFrame:
    """Whether the crawl stops after each round: ``quiet`` rounds in a row without new keys, or ``most`` rounds.

    One row a round: the window runs over rounds, never over records.
    """
    w = W.orderBy(rounds)
    run = F.sum((F.col("new_keys") > 0).cast("int")).over(w)
    x = per_round.withColumn("__run", run).withColumn("round_no", F.row_number().over(w))
    quiet_rounds = F.sum((F.col("new_keys") == 0).cast("int")).over(W.partitionBy("__run").orderBy(rounds))
    x = x.withColumn("quiet_rounds", quiet_rounds)
    why = F.when(F.col("quiet_rounds") >= quiet, "converged").when(F.col("round_no") >= most, "round_limit").otherwise("go_on")
    return x.withColumn("decision", why).drop("__run")


def repeated_pages(pages: DataFrame, order: str, signature: str, stop: int = 3, by: list[str] | None = None) -> DataFrame:
    """Pages whose signature was met before, and whether ``stop`` of them in a row end the crawl; per crawl (court, round) with ``by``.

    One row a page. The earliest page of a signature comes from an aggregate; runs are
    numbered by parts, so a crawl of any length is no single task.
    """
    keys = by or []
    named = [*keys, signature]
    first = pages.groupBy(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(named)]).agg(F.min(order).alias("__first"))
    same = F.lit(True)
    for i, k in enumerate(named):
        same = same & F.col(k).eqNullSafe(F.col(f"__s{i}"))
    x = pages.join(first, same).select(*pages.columns, (F.col("__first") < F.col(order)).alias("repeated"))
    # the place among all pages less the place among the repeated ones is the same within a run of them
    everything = numbered(x.withColumn("__all", F.lit(0)), [*keys, "__all"], [F.col(order)], "__n")
    runs = numbered(everything, [*keys, "__all", "repeated"], [F.col(order)], "__m").withColumn("__run", F.col("__n") - F.col("__m"))
    placed = numbered(runs, [*keys, "repeated", "__run"], [F.col(order)], "__k")
    out = placed.withColumn("in_a_row", F.when(F.col("repeated"), F.col("__k")).otherwise(0))
    return out.withColumn("stop_here", F.col("in_a_row") >= stop).select(*pages.columns, "repeated", "in_a_row", "stop_here")
