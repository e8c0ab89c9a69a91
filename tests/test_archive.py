import random

import pytest
from pyspark.sql import functions as F

from pipelab.operators import archive as ar
from pipelab.operators.replay import replay_archive
from pipelab.session import scratch_path
from pipelab.streaming import archive_stream as st

LOG = "task_id string, agent_id bigint, run_id bigint, seq bigint, accuracy double"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_admission_bar(spark):
    archive = log_of(spark, [("t", i, i, i, s) for i, s in enumerate([0.2, 0.4, 0.9])])
    offers = log_of(spark, [("t", 7, 7, 7, 0.4), ("t", 8, 8, 8, 0.39), ("t", 9, 9, 9, None), ("new", 1, 10, 1, 0.0)])
    assert {r["run_id"] for r in ar.admit(offers, archive, "accuracy").collect()} == {7, 10}


def test_missing_scores_lower_the_bar(spark):
    archive = log_of(spark, [("t", 1, 1, 1, None), ("t", 2, 2, 2, 0.5)])
    offers = log_of(spark, [("t", 7, 7, 7, 0.1)])
    assert ar.admit(offers, archive, "accuracy").count() == 1


def test_upsert_keeps_the_place(spark):
    log = log_of(spark, [("t", 1, 1, 1, 0.9), ("t", 2, 2, 2, 0.5), ("t", 1, 3, 3, 0.1)])
    got = {r["agent_id"]: (r["run_id"], r["first_seq"]) for r in ar.upsert(log).collect()}
    assert got == {1: (3, 1), 2: (2, 2)}


def test_eviction_ties_and_history(spark):
    archive = log_of(spark, [("t", 1, 1, 1, 0.5), ("t", 2, 2, 2, 0.5), ("t", 3, 3, 3, 0.9), ("t", 4, 4, 4, None)]).withColumn("first_seq", F.col("seq"))
    kept = ar.evict_worst(archive, 2)
    assert {r["agent_id"] for r in kept.collect()} == {2, 3}
    assert {r["agent_id"] for r in ar.drop_evicted(archive, kept).collect()} == {2, 3}


def test_history_and_unknown_agent(spark):
    log = log_of(spark, [("t", i % 2, i, i, 0.5) for i in range(20)])
    cut = ar.history(log, hot_rows=3)
    assert sorted((r["agent_id"], r["attempt"]) for r in cut.collect()) == [(a, i) for a in (0, 1) for i in range(1, 11)]
    assert ar.agent_history(cut, 99).count() == 0


def test_top_n_ties_and_missing(spark):
    archive = log_of(spark, [("t", 1, 1, 1, 0.5), ("t", 2, 2, 2, 0.5), ("t", 3, 3, 3, None)]).withColumn("first_seq", F.col("seq"))
    assert [r["agent_id"] for r in ar.top_n(archive, 5).orderBy("place").collect()] == [1, 2, 3]
    assert [r["agent_id"] for r in ar.top_n(archive, 2, task=None).collect()] == [1, 2]


def test_rarity(spark):
    archive = log_of(spark, [("t", 1, 1, 1, 0.5), ("t", 2, 2, 2, 0.5), ("t", 3, 3, 3, 0.5)]).withColumn("first_seq", F.col("seq"))
    usage = spark.createDataFrame([("t", 1, "f1"), ("t", 1, "f2"), ("t", 2, "f1")], "task_id string, agent_id bigint, feature string")
    got = [(r["agent_id"], r["rarity"]) for r in ar.diverse_n(archive, usage, 9).orderBy("place").collect()]
    assert got == [(1, 1.5), (2, 0.5), (3, 0.0)]


def test_feature_usage_rules(spark):
    code = spark.createDataFrame([(1, "a = X['age']\nX.fare\nX.drop(columns=['sex'])\nname = 1"), (2, "pass")], "agent_id bigint, code string")
    known = spark.createDataFrame([(1, f) for f in ("age", "fare", "sex", "name")], "agent_id bigint, feature string")
    got = {r["agent_id"]: (r["features_used"], r["num_features_used"]) for r in ar.feature_usage(code, known).collect()}
    assert got == {1: (["age", "fare"], 2), 2: ([], 0)}


def test_sample_is_capped_and_repeatable(spark):
    archive = log_of(spark, [("t", i, i, i, 0.5) for i in range(10)])
    assert ar.sample_n(archive, 99).count() == 10
    ids = lambda df: sorted(r["agent_id"] for r in df.collect())
    assert ids(ar.sample_n(archive, 4)) == ids(ar.sample_n(archive.repartition(5), 4))
    two = archive.unionByName(archive.withColumn("task_id", F.lit("u")))
    assert ar.sample_n(two, 4).groupBy("task_id").count().collect()[0]["count"] == 4 and ar.sample_n(two, 4, task=None).count() == 4


def test_empty_archive_summary(spark):
    usage = spark.createDataFrame([], "task_id string, agent_id bigint, feature string")
    assert ar.archive_summary(log_of(spark, []), usage, ["accuracy"]).count() == 0


def test_lineage_of_a_chain_and_a_cycle(spark):
    nodes = [(i, i - 1 if i else None) for i in range(33)]
    tree = spark.createDataFrame(nodes, "run_id bigint, parent_run_id bigint")
    got = {r["run_id"]: (r["root_run_id"], r["depth"], r["chain"]) for r in ar.lineage(tree, with_chain=True).collect()}
    assert got[32] == (0, 32, list(range(31, -1, -1))) and got[0] == (0, 0, [])
    loop = spark.createDataFrame([(1, 2), (2, 1)], "run_id bigint, parent_run_id bigint")
    for chains in (False, True):
        with pytest.raises(ValueError):
            ar.lineage(loop, with_chain=chains)


def test_lineage_of_a_long_chain(spark):
    tree = spark.range(10_000).select(F.col("id").alias("run_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_run_id"))
    got = ar.lineage(tree)
    assert got.columns == ["run_id", "root_run_id", "depth"] and got.filter("depth <> run_id or root_run_id <> 0").count() == 0


def test_text_ids_and_results_per_archive(spark):
    rows = [("t", "a", "r10", 1, 0.5), ("t", "b", "r9", 2, 0.5), ("u", "a", "r1", 1, 0.2), ("u", "c", "r2", 2, None)]
    log = spark.createDataFrame(rows, "task_id string, agent_id string, run_id string, seq bigint, accuracy double")
    log = log.withColumn("parent_run_id", F.lit(None).cast("string")).withColumn("generation", F.lit(0))
    got = {r["task_id"]: r["best_run_id"] for r in ar.generation_summary(log).collect()}
    assert got == {"t": "r10", "u": "r1"}
    assert {r["task_id"]: r["run_id"] for r in ar.final_results(log).collect()} == {"t": "r10", "u": "r1"}
    assert ar.final_results(log, task=None).first()["run_id"] == "r10"


def test_context_shows_whole_ids(spark):
    log = spark.createDataFrame([("t", "agent_1000001", 1, 1, 0.5), ("t", "agent_1000002", 2, 1, None)], "task_id string, agent_id string, first_seq int, generation int, accuracy double")
    text = ar.recent_context(log).first()["context"]
    assert text == "- Generation 1, Agent ID agent_1000001, accuracy: 0.5000\n- Generation 1, Agent ID agent_1000002, accuracy: 0.0000"
    assert "ID agent_10," in ar.recent_context(log, id_width=8).first()["context"]


def test_roulette_without_any_score(spark):
    archive = log_of(spark, [("t", i, i, i, 0.0) for i in range(5)]).withColumn("first_seq", F.col("seq"))
    picks = {r["agent_id"] for r in ar.select_parent(archive, "roulette", 100).collect()}
    assert picks == set(range(5))


def test_lost_stream_state_is_an_error(spark):
    log = log_of(spark, [("t", 1, 1, 1, 0.5)])
    with pytest.raises(ValueError):
        st.fold_batch(log, 3, scratch_path(spark, "lost"), 10, "accuracy")


def test_best_so_far_when_cut(spark):
    rng = random.Random(5)
    rows = [("t", i, i, i, rng.random()) for i in range(300)]
    best, want = -1.0, []
    for r in rows:
        if r[4] > best:
            best = r[4]
            want.append(r[2])
    got = ar.best_so_far(log_of(spark, rows).repartition(4), order=("seq",), hot_rows=20)
    assert sorted(r["run_id"] for r in got.collect()) == want


def test_parent_strategies(spark):
    archive = log_of(spark, [("t", i, i, i, 0.1 if i else 0.9) for i in range(5)]).withColumn("first_seq", F.col("seq"))
    picks = {s: [r["agent_id"] for r in ar.select_parent(archive, s, 200).collect()] for s in ("uniform", "elite", "elite_plus_diversity", "roulette")}
    assert all(len(p) == 200 for p in picks.values())
    assert set(picks["elite"]) == {0} and set(picks["uniform"]) == set(range(5))
    assert picks["elite_plus_diversity"].count(0) > 120 > picks["uniform"].count(0)
    assert picks["roulette"].count(0) > 100
    with pytest.raises(ValueError):
        ar.select_parent(archive, "best of luck")


# --- replay -----------------------------------------------------------------------------


def plain_replay(rows, limit):
    """The rules, one row at a time, as plain lists."""
    archives, decisions = {}, {}
    for task, agent, run, seq, score in sorted(rows, key=lambda r: (r[0], r[3])):
        entries = archives.setdefault(task, [])  # [agent, run, score], in insertion order
        if entries:
            scores = sorted(e[2] for e in entries)
            n = len(scores)
            median = (scores[(n - 1) // 2] + scores[n // 2]) / 2
            if score is None or not (score >= median or score >= scores[-1]):
                decisions[task, run] = False
                continue
        value = float("-inf") if score is None else score
        decisions[task, run] = True
        for e in entries:
            if e[0] == agent:
                e[1], e[2] = run, value
                break
        else:
            if len(entries) >= limit:
                entries.remove(min(entries, key=lambda e: e[2]))
            entries.append([agent, run, value])
    return archives, decisions


def random_log(seed, n, agents, tasks=("t", "u")):
    rng = random.Random(seed)
    rows, seqs = [], {t: 0 for t in tasks}
    for i in range(n):
        task = tasks[0] if rng.random() < 0.8 else tasks[-1]
        seqs[task] += 1
        score = None if rng.random() < 0.05 else round(rng.random(), 2)
        rows.append((task, rng.randrange(agents), i, seqs[task], score))
    return rows


@pytest.mark.parametrize("seed,agents,limit,first", [(1, 30, 7, 10_000), (2, 30, 6, 10), (3, 500, 10, 25), (4, 3, 1, 5), (5, 4, 8, 5)])
def test_replay_equals_the_plain_fold(spark, seed, agents, limit, first):
    rows = random_log(seed, 800, agents)
    want, decided = plain_replay(rows, limit)
    archive, decisions = replay_archive(log_of(spark, rows).repartition(6), limit, first_chunk=first)
    got = {}
    for r in archive.orderBy("task_id", "place").collect():
        got.setdefault(r["task_id"], []).append([r["agent_id"], r["run_id"], r["score"]])
    assert got == want
    assert {(r["task_id"], r["run_id"]): r["accepted"] for r in decisions.collect()} == decided
    assert all(len(v) <= limit for v in got.values())


def test_replay_of_nothing(spark):
    archive, decisions = replay_archive(log_of(spark, []))
    assert archive.count() == 0 and decisions.count() == 0


def test_stream_in_batches_equals_batch(spark):
    rows = random_log(9, 300, 25)
    frame = spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds(F.col("run_id"))).drop("seq")
    source, path, checkpoint = (scratch_path(spark, n) for n in ("source", "archive", "checkpoint"))
    for part in range(3):
        frame.filter((F.col("run_id") >= part * 100) & (F.col("run_id") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    st.stream_archive(stream, path, checkpoint, 6).awaitTermination()
    assert st.latest_batch(spark, path) == 2
    want, _ = plain_replay(rows, 6)
    got = {}
    for r in st.current_archive(spark, path).orderBy("task_id", "place").collect():
        got.setdefault(r["task_id"], []).append([r["agent_id"], r["run_id"], r["score"]])
    assert got == want
    # a batch that is run again leaves the same state
    before = {tuple(r) for r in st.current_archive(spark, path).collect()}
    part = frame.filter("run_id >= 200")
    st.fold_batch(part, 2, path, 6, "accuracy")
    assert {tuple(r) for r in st.current_archive(spark, path).collect()} == before
