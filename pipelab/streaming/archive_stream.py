"""The archive kept up to date from a stream of results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipelab.functions.numeric import join_on
from pipelab.operators.ordering import ranked
from pipelab.operators.replay import replay_archive
from pipelab.sources.tables import list_names, path_exists


def _at(path: str, batch: int, name: str) -> str:
    return os.path.join(path, f"batch={batch}", name)


def fold_batch(log: DataFrame, batch_id: int, path: str, limit: int, score: str) -> None:
    """Replay one micro-batch from the state its predecessor left.

    Output goes under the batch's own number, so a batch that is run again overwrites
    its own files and reads the same state as before.
    """
    spark = log.sparkSession
    log = log.persist()
    earlier = batch_id > 0
    if earlier and not path_exists(spark, os.path.join(_at(path, batch_id - 1, "archive"), "_SUCCESS")):
        raise ValueError(f"the state of batch {batch_id - 1} is missing under {path}: the archive would start anew")
    state = spark.read.parquet(_at(path, batch_id - 1, "archive")) if earlier else None
    numbered = ranked(log, ["task_id"], ["ts", "run_id"], "seq")
    counts = log.groupBy("task_id").agg(F.count(F.lit(1)).alias("seen"))
    if earlier:
        seen = spark.read.parquet(_at(path, batch_id - 1, "seen"))
        numbered = join_on(numbered, seen, ["task_id"], "left").withColumn(
            "seq", F.col("seq") + F.coalesce("seen", F.lit(0))
        ).drop("seen")
        counts = counts.unionByName(seen).groupBy("task_id").agg(F.sum("seen").alias("seen"))
    archive, decisions = replay_archive(numbered, limit, score, state)
    decisions.write.mode("overwrite").parquet(_at(path, batch_id, "decisions"))
    counts.write.mode("overwrite").parquet(_at(path, batch_id, "seen"))
    archive.write.mode("overwrite").parquet(_at(path, batch_id, "archive"))
    log.unpersist()


def stream_archive(
    results: DataFrame, path: str, checkpoint: str, limit: int = 100, score: str = "accuracy", available_now: bool = True
) -> StreamingQuery:
    """Start the archive on a stream of (task_id, agent_id, run_id, ts, score).

    The order is that of arrival: batch by batch, and by (ts, run_id) inside a batch. A row
    that arrives in a later batch than its time is decided then, so the archive equals the
    batch replay only if no row is late by a batch.
    """
    writer = results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: fold_batch(df, batch_id, path, limit, score)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_batch(spark: SparkSession, path: str) -> int:
    """Number of the newest complete batch; -1 when there is none."""
    numbers = [int(n.split("=")[1]) for n in list_names(spark, path) if n.startswith("batch=")]
    done = (n for n in sorted(numbers, reverse=True) if path_exists(spark, os.path.join(_at(path, n, "archive"), "_SUCCESS")))
    return next(done, -1)


def current_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_at(path, latest_batch(spark, path), "archive"))
