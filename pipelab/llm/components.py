"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelab.session import cut_lineage


#: Edges up to which a round is one task without shuffles; steps make no more edges. More are dealt out to all tasks.
SHORT_EDGES = 200_000
#: Edges in one part of a list. A short list in many parts would make many nearly empty shuffle files in every step.
EDGES_A_PART = 500_000
#: With it, the shuffle files of an action go when that action ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_and_clear(df: DataFrame) -> DataFrame:
    """Checkpoint whose shuffle files go as soon as it is written, and not when the driver next collects garbage.

    Only the plan made here is cleared: ``df`` and other frames made from it keep theirs.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return cut_lineage(df.select("*"))
    finally:
        conf.set(_CLEAN, before)


def _star(edges: DataFrame, larger: bool, short: bool) -> DataFrame:
    """One star step: neighbours on one side of a node are tied to the smallest node around it.

    A ``short`` list is one part, which Spark groups without a shuffle, so that the step stays in its task.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(turned) if larger else turned  # in turned, b < a
    if short:
        tied = around.coalesce(1).withColumn("low", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")))
        least = tied.select("a", "low").distinct()
    else:
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        tied = around.join(least, "a")
    if larger:
        new = tied.filter("b > a").select(F.col("low").alias("a"), "b")
    else:
        new = tied.select(F.col("low").alias("a"), "b").unionByName(least.select(F.col("low").alias("a"), F.col("a").alias("b")))
    new = new.filter("a < b")
    return new.coalesce(1) if short else new


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) for every node of ``edges`` (a, b), by alternating star steps.

    Edges are rewritten until every node hangs on the smallest of its component; no node
    ever gathers its neighbours in one row. Each round ends in a checkpoint, in parts by the number of edges.
    """
    now = cut_and_clear(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    count = now.count()
    mark, short, parts = None, count <= SHORT_EDGES, 1 + count // EDGES_A_PART
    now = now.coalesce(parts)
    while True:
        now = cut_and_clear(_star(_star(now, True, short), False, short).distinct().coalesce(parts))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
