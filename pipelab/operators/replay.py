"""Replay of an experiment log through a bounded archive, in time order.

Admission depends on the archive at that moment, so a task's log is a serial fold. Two
things keep it small. The fold holds at most ``limit`` entries and reads a sorted,
spillable partition in batches. And the lower median of an archive never falls (every
accepted score is at or above it, and eviction takes the lowest), so a row below the
lower median of an earlier moment is certain to be rejected: the log is taken in chunks
of growing length, and all such rows of a chunk are decided in parallel, before the fold.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelab.functions.numeric import join_on, small_side
from pipelab.session import cut_lineage

FIRST_CHUNK = 10_000
GROWTH = 8


class BoundedArchive:
    """Entries of one task: agent -> (place, run, score), at most ``limit``."""

    def __init__(self, limit: int):
        self.limit = limit
        self.entries: dict = {}
        self.scores: list[float] = []

    def put(self, agent, place, run, score) -> None:
        self.entries[agent] = (place, run, score)
        insort(self.scores, score)

    def take(self, agent) -> int:
        place, _, score = self.entries.pop(agent)
        del self.scores[bisect_left(self.scores, score)]
        return place

    def median(self) -> float:
        n = len(self.scores)
        low, high = self.scores[(n - 1) // 2], self.scores[n // 2]
        return low if low == high else (low + high) / 2

    def offer(self, agent, place, run, score) -> bool:
        known = score == score  # a missing score arrives as NaN
        if self.entries and not (known and score >= self.median()):
            return False
        if not known:
            score = float("-inf")
        if agent in self.entries:
            place = self.take(agent)
        elif len(self.entries) >= self.limit:
            worst = min(self.entries, key=lambda a: (self.entries[a][2], self.entries[a][0]))
            self.take(worst)
        self.put(agent, place, run, score)
        return True


def _fold(limit: int):
    columns = ["task_id", "agent_id", "run_id", "score", "place", "accepted"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, archive = None, BoundedArchive(limit)

        def entries():
            rows = [(task, a, r, s, p, None) for a, (p, r, s) in archive.entries.items()]
            return pd.DataFrame(rows, columns=columns).astype({"accepted": object})

        for pdf in batches:
            decided = []
            finished = []
            for t, agent, run_id, score, place, is_state in zip(
                pdf["task_id"], pdf["agent_id"], pdf["run_id"], pdf["score"], pdf["place"], pdf["is_state"]
            ):
                if t != task:
                    if task is not None:
                        finished.append(entries())
                    task, archive = t, BoundedArchive(limit)
                if is_state:
                    archive.put(agent, place, run_id, score)
                else:
                    decided.append((t, agent, run_id, score, place, archive.offer(agent, place, run_id, score)))
            yield pd.concat([pd.DataFrame(decided, columns=columns).astype({"accepted": object}), *finished])
        if task is not None:
            yield entries()

    return run


def _with_types(log: DataFrame) -> str:
    t = dict(log.dtypes)
    return f"task_id {t['task_id']}, agent_id {t['agent_id']}, run_id {t['run_id']}, score double, place bigint"


def replay_archive(
    log: DataFrame,
    limit: int = 100,
    score: str = "accuracy",
    state: DataFrame | None = None,
    first_chunk: int = FIRST_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Admission, replacement and eviction in time order.

    ``log``: (task_id, agent_id, run_id, seq, score), ``seq`` numbering a task's rows.
    ``state``: an earlier archive to go on from. Returns the final archive (task_id,
    agent_id, run_id, score, place) and the decision on every row (task_id, run_id,
    seq, accepted).
    """
    rows = log.select(
        "task_id", "agent_id", "run_id", F.col(score).cast("double").alias("score"), F.col("seq").cast("bigint").alias("place")
    )
    schema = _with_types(log)
    bounds = rows.agg(F.min("place"), F.max("place")).first()
    if bounds[0] is None:
        empty = rows.select("task_id", "run_id", F.col("place").alias("seq"), F.lit(True).alias("accepted")).limit(0)
        return (rows.limit(0) if state is None else state), empty
    if bounds[1] - bounds[0] >= first_chunk:
        rows = cut_lineage(rows)  # read once per chunk
    decisions: DataFrame | None = None
    low, size = bounds[0] - 1, first_chunk
    while low < bounds[1]:
        high = low + size
        chunk = rows.filter((F.col("place") > low) & (F.col("place") <= high))
        sure: DataFrame | None = None
        if state is not None:
            ordered = F.sort_array(F.collect_list("score"))  # at most ``limit`` scores per task
            floors = state.groupBy("task_id").agg(
                F.element_at(ordered, ((F.size(ordered) + 1) / 2).cast("int")).alias("__floor")
            )
            judged = join_on(chunk, small_side(floors), ["task_id"], "left")
            hopeless = F.col("__floor").isNotNull() & (F.col("score").isNull() | (F.col("score") < F.col("__floor")))
            sure = judged.filter(hopeless).select("task_id", "run_id", F.col("place").alias("seq"), F.lit(False).alias("accepted"))
            chunk = judged.filter(~hopeless).drop("__floor")
        feed = chunk.withColumn("is_state", F.lit(False))
        if state is not None:
            feed = feed.unionByName(state.withColumn("is_state", F.lit(True)))
        folded = (
            feed.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
            .repartition("task_id")
            .sortWithinPartitions("task_id", F.desc("is_state"), "place")
            .mapInPandas(_fold(limit), schema + ", accepted boolean")
        )
        folded = cut_lineage(folded)
        state = folded.filter(F.col("accepted").isNull()).drop("accepted")
        made = folded.filter(F.col("accepted").isNotNull()).select("task_id", "run_id", F.col("place").alias("seq"), "accepted")
        made = made if sure is None else made.unionByName(sure)
        decisions = made if decisions is None else decisions.unionByName(made)
        low, size = high, size * GROWTH
    return state, decisions
