"""Analytics over an archive of experiments.

Everything is keyed by ``task_id``, so many archives are handled side by side. Columns:
an experiment log has (task_id, agent_id, run_id, ts, metrics...), in time order given by
``seq``; an archive has one row per (task_id, agent_id) with ``seq`` as insertion order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelab.functions.numeric import SMALL_ROWS, hash_int, hash_key, hash_unit, join_on, small_side
from pipelab.operators.ordering import HOT_ROWS, exact_quantiles, preceding, ranked
from pipelab.session import cut_lineage

LOWEST = float("-inf")


def _worth(score: Column) -> Column:
    """A missing score is below every other."""
    return F.coalesce(score.cast("double"), F.lit(LOWEST))


def admit(candidates: DataFrame, archive: DataFrame, score: str, task: str = "task_id") -> DataFrame:
    """Candidates at or above the median of their task's archive, or at its best.

    A task without archive admits all; a candidate without score is rejected.
    """
    scores = archive.select(task, _worth(F.col(score)).alias("__s"))
    medians = exact_quantiles(scores, ["__s"], [0.5], [task]).select(task, F.col("value").alias("__median"))
    best = scores.groupBy(task).agg(F.max("__s").alias("__best"))
    bars = join_on(medians, best, [task])
    judged = join_on(candidates, small_side(bars), [task], "left")
    good = (F.col(score) >= F.col("__median")) | (F.col(score) >= F.col("__best"))
    return judged.filter(F.col("__best").isNull() | good).drop("__median", "__best")


def upsert(log: DataFrame, task: str = "task_id", agent: str = "agent_id", order: str = "seq") -> DataFrame:
    """Latest row per agent, kept at the place of its first one (``first_seq``).

    A reduction, not a sort: partial aggregation keeps a hot agent small.
    """
    rest = [c for c in log.columns if c not in (task, agent)]
    latest = log.groupBy(task, agent).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("__last"), F.min(order).alias("first_seq")
    )
    return latest.select(task, agent, *[F.col(f"__last.{c}").alias(c) for c in rest], "first_seq")


def evict_worst(archive: DataFrame, limit: int = 100, score: str = "accuracy", task: str = "task_id", order: str = "first_seq") -> DataFrame:
    """The ``limit`` best of each task; of equal scores the oldest leaves first."""
    w = Window.partitionBy(task).orderBy(_worth(F.col(score)).desc(), F.col(order).desc())
    return archive.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")


def drop_evicted(history: DataFrame, kept: DataFrame, task: str = "task_id", agent: str = "agent_id") -> DataFrame:
    """History of the agents still in the archive."""
    return join_on(history, kept.select(task, agent), [task, agent], "left_semi")


def history(log: DataFrame, task: str = "task_id", agent: str = "agent_id", order: tuple[str, ...] = ("seq",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the attempts of every agent from 1."""
    return ranked(log, [task, agent], list(order), "attempt", hot_rows=hot_rows)


def agent_history(numbered: DataFrame, agent_id, agent: str = "agent_id") -> DataFrame:
    """Attempts of one agent; an unknown agent gives no rows."""
    return numbered.filter(F.col(agent) == F.lit(agent_id)).orderBy("task_id", "attempt")


def top_n(archive: DataFrame, n: int = 1, metric: str = "accuracy", task: str | None = "task_id", order: str = "first_seq") -> DataFrame:
    """Best n by a metric, per task or over all; ties keep insertion order."""
    by = [_worth(F.col(metric)).desc(), F.col(order).asc()]
    if task is None:
        return archive.orderBy(*by, "agent_id").limit(n)
    w = Window.partitionBy(task).orderBy(*by)
    return archive.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def feature_usage(code: DataFrame, features: DataFrame, agent: str = "agent_id", text: str = "code") -> DataFrame:
    """Known features found in the lines of an agent's code that touch its data.

    ``features``: (agent, feature), as many rows per agent as its model has inputs. Lines
    that drop columns do not count. Lines and features are matched inside one row, so no
    pairs are emitted; agents without known features get an empty list.
    """
    known = features.groupBy(agent).agg(F.collect_set("feature").alias("__known"))
    lines = F.filter(
        F.split(text, "\n"),
        lambda s: (F.contains(s, F.lit("X[")) | F.contains(s, F.lit("X.")))
        & ~(F.contains(s, F.lit("drop")) & F.contains(s, F.lit("columns"))),
    )
    rows = join_on(code.select(agent, lines.alias("__lines")), known, [agent], "left")
    used = F.array_sort(
        F.filter("__known", lambda f: F.exists("__lines", lambda s: F.contains(s, f)))
    )
    listed = F.coalesce(used, F.array().cast("array<string>"))
    return rows.select(agent, listed.alias("features_used"), F.size(listed).alias("num_features_used"))


def rarity_scores(archive: DataFrame, usage: DataFrame, task: str = "task_id", agent: str = "agent_id") -> DataFrame:
    """Sum over an agent's features of 1 / (agents of the task using it); 0 without features."""
    pairs = usage.select(task, agent, "feature").distinct()
    spread = pairs.groupBy(task, "feature").agg(F.count(F.lit(1)).alias("__n"))
    weighed = join_on(pairs, spread, [task, "feature"])
    scores = weighed.groupBy(task, agent).agg(F.round(F.sum(1.0 / F.col("__n")), 9).alias("rarity"))
    return join_on(archive, scores, [task, agent], "left").withColumn("rarity", F.coalesce("rarity", F.lit(0.0)))


def diverse_n(archive: DataFrame, usage: DataFrame, n: int = 1, task: str = "task_id", order: str = "first_seq") -> DataFrame:
    """The n agents of each task with the rarest features; ties keep insertion order."""
    scored = rarity_scores(archive, usage, task)
    w = Window.partitionBy(task).orderBy(F.col("rarity").desc(), F.col(order).asc())
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def sample_n(archive: DataFrame, n: int, seed: int = 42, ids: tuple[str, ...] = ("task_id", "agent_id"), task: str | None = "task_id") -> DataFrame:
    """n rows of each archive without replacement, repeatable; all where there are fewer.

    With ``task`` None the n rows are drawn over all archives.
    """
    keyed = archive.withColumn("__key", hash_key(seed, *ids))
    if task is None:
        return keyed.orderBy("__key", *ids).limit(n).drop("__key")
    w = Window.partitionBy(task).orderBy("__key", *ids)
    return keyed.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__key", "__rn")


def archive_summary(archive: DataFrame, usage: DataFrame, metrics: list[str], task: str = "task_id") -> DataFrame:
    """Per task: agents, best value per metric, distinct features, mean features per agent."""
    best = archive.groupBy(task).agg(F.count(F.lit(1)).alias("num_agents"), *[F.max(m).alias(f"best_{m}") for m in metrics])
    pairs = join_on(usage.select(task, "agent_id", "feature").distinct(), archive.select(task, "agent_id"), [task, "agent_id"], "left_semi")
    per_feature = pairs.groupBy(task, "feature").agg(F.count(F.lit(1)).alias("n"))
    spread = per_feature.groupBy(task).agg(F.count(F.lit(1)).alias("unique_features"), F.sum("n").alias("__uses"))
    joined = join_on(best, spread, [task], "left")
    return joined.select(
        task, "num_agents", *[f"best_{m}" for m in metrics],
        F.coalesce("unique_features", F.lit(0)).alias("unique_features"),
        (F.coalesce("__uses", F.lit(0)) / F.col("num_agents")).alias("avg_features_per_agent"),
    )


def lineage(agents: DataFrame, node: str = "run_id", parent: str = "parent_run_id", with_chain: bool = False, max_rounds: int | None = None) -> DataFrame:
    """Root and depth of every node, by pointer doubling; with ``with_chain`` also its ancestors, nearest first.

    Chains hold an entry per node and ancestor, so they suit shallow trees.

    Each round doubles the reach of the open pointers, so a tree of depth d takes about
    log2(d) joins. Finished nodes leave the join and are written once; only the open
    ones are checkpointed each round. No path is longer than the number of nodes, so
    pointers still open after its log2 rounds form a cycle.
    """
    none = F.array().cast(f"array<{dict(agents.dtypes)[node]}>")
    own = F.when(F.col(parent).isNotNull(), F.array(parent)).otherwise(none)
    state = agents.select(
        F.col(node).alias("node"),
        F.coalesce(parent, node).alias("root"),
        F.when(F.col(parent).isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"),
        (own if with_chain else none).alias("chain"),
        F.col(parent).isNull().alias("done"),
    )
    state = cut_lineage(state)
    if max_rounds is None:
        max_rounds = max(1, state.count().bit_length()) + 1
    done, open_ = state.filter("done"), state.filter(~F.col("done"))
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        reached = done.unionByName(open_)
        hop = reached.select(
            F.col("node").alias("root"), F.col("root").alias("__root"), F.col("depth").alias("__depth"),
            F.col("chain").alias("__chain"), F.col("done").alias("__done"),
        )
        # In late rounds most pointers name a few nodes near the roots; these are few rows, so they are sent along.
        wanted = open_.select("root").distinct()
        if wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
            hop = F.broadcast(join_on(hop, F.broadcast(wanted), ["root"], "left_semi"))
        moved = cut_lineage(join_on(open_, hop, ["root"], "left").select(
            "node",
            F.coalesce("__root", "root").alias("root"),
            (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            F.concat("chain", F.coalesce("__chain", none)).alias("chain"),
            # an unknown parent or a root ends the chain
            (F.coalesce("__done", F.lit(True))).alias("done"),
        ))
        done, open_ = done.unionByName(moved.filter("done")), moved.filter(~F.col("done"))
    else:
        if not open_.isEmpty():
            raise ValueError("the parent pointers form a cycle")
    state = done
    out = state.select(F.col("node").alias(node), F.col("root").alias(f"root_{node}"), "depth", *(["chain"] if with_chain else []))
    return out


def best_so_far(log: DataFrame, score: str = "accuracy", task: str = "task_id", order: tuple[str, ...] = ("ts", "run_id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows that beat every earlier score of their task, with that score and their place
    in the task's log; both come out of one prefix pass."""
    aggs = {"previous_best": ("max", F.col(score)), "place": ("count", None)}
    seen = preceding(log, [task], list(order), aggs, hot_rows=hot_rows).withColumn("place", F.col("place") + 1)
    return seen.filter(F.col(score).isNotNull() & (F.col("previous_best").isNull() | (F.col(score) > F.col("previous_best"))))


def _places(population: DataFrame, task: str, order: str) -> DataFrame:
    """Members numbered from 0 in insertion order, with the size of the population."""
    sizes = population.groupBy(task).agg(F.count(F.lit(1)).alias("__size"))
    placed = ranked(population, [task], [order, "agent_id"], "__place")
    return join_on(placed.withColumn("__place", F.col("__place") - 1), sizes, [task])


def _drawn(tasks: DataFrame, draws: Column, seed: int | str, task: str) -> DataFrame:
    """One seeded draw per task and slot; ``draws`` is an array of slot numbers."""
    slots = tasks.withColumn("slot", F.explode(draws))
    return slots.withColumn("__key", hash_key(seed, F.col(task), F.col("slot")))


def _uniform_pick(population: DataFrame, draws: Column, seed: int | str, task: str, order: str) -> DataFrame:
    members = _places(population, task, order)
    sizes = population.groupBy(task).agg(F.count(F.lit(1)).alias("__n"))
    picks = _drawn(sizes, draws, seed, task).withColumn("__place", hash_int(F.col("__key")) % F.col("__n"))
    return join_on(picks.drop("__key", "__n"), members.select(task, "__place", "agent_id"), [task, "__place"]).drop("__place")


def next_generation(population: DataFrame, size: int, score: str = "accuracy", seed: int = 42, task: str = "task_id", order: str = "first_seq") -> DataFrame:
    """(task, slot, role, agent): slot 1 keeps the best, the others get a parent by lot."""
    elite = top_n(population, 1, score, task, order).select(task, F.lit(1).alias("slot"), F.lit("elite").alias("role"), "agent_id")
    if size < 2:
        return elite
    slots = F.sequence(F.lit(2), F.lit(size))
    children = _uniform_pick(population, slots, seed, task, order)
    return elite.unionByName(children.select(task, "slot", F.lit("child").alias("role"), "agent_id"))


def select_parent(archive: DataFrame, strategy: str = "elite", draws: int = 1, score: str = "accuracy", seed: int = 42, task: str = "task_id", order: str = "first_seq") -> DataFrame:
    """Parents per task: (task, slot, agent_id).

    ``uniform``: any member; ``elite``: the best; ``elite_plus_diversity``: the best with
    probability 0.7, else any; ``roulette``: with probability proportional to the score.
    """
    slots = F.sequence(F.lit(1), F.lit(draws))
    if strategy == "uniform":
        return _uniform_pick(archive, slots, f"{seed}:uniform", task, order).select(task, "slot", "agent_id")
    best = top_n(archive, 1, score, task, order).select(task, "agent_id")
    if strategy == "elite":
        return best.select(task, F.explode(slots).alias("slot"), "agent_id")
    if strategy == "elite_plus_diversity":
        others = _uniform_pick(archive, slots, f"{seed}:uniform", task, order)
        coin = hash_unit(hash_key(f"{seed}:coin", F.col(task), F.col("slot")))
        both = join_on(others, best.withColumnRenamed("agent_id", "__best"), [task])
        return both.select(task, "slot", F.when(coin < 0.7, F.col("__best")).otherwise(F.col("agent_id")).alias("agent_id"))
    if strategy == "roulette":
        own = F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0))
        tops = archive.groupBy(task).agg(F.max(own).alias("__top"))
        archive = join_on(archive, small_side(tops), [task])
        weight = F.when(F.col("__top") > 0, own).otherwise(F.lit(1.0))  # without any score all are alike
        wheel = preceding(
            archive.select(task, order, "agent_id", weight.alias("__w")), [task], [order, "agent_id"],
            {"__from": ("sum", F.col("__w"))},
        )
        sums = wheel.groupBy(task).agg(F.sum("__w").alias("__all"))
        points = _drawn(sums, slots, f"{seed}:roulette", task)
        # members and points on one line: a point belongs to the last member that starts before it
        member = F.struct(F.col("__from").alias("at"), F.col(order).alias("o"), "agent_id")
        starts = wheel.select(task, F.col("__from").alias("at"), F.lit(0).alias("kind"), F.col(order).cast("bigint").alias("slot"), member.alias("m"))
        shots = points.select(
            task, (hash_unit(F.col("__key")) * F.col("__all")).alias("at"), F.lit(1).alias("kind"), F.col("slot").cast("bigint").alias("slot"),
            F.lit(None).cast(starts.schema["m"].dataType).alias("m"),
        )
        line = preceding(starts.unionByName(shots), [task], ["at", "kind", "slot"], {"hit": ("max", F.col("m"))})
        return line.filter("kind = 1").select(task, F.col("slot").cast("int").alias("slot"), "hit.agent_id")
    raise ValueError(f"unknown strategy: {strategy}")


def recent_context(archive: DataFrame, n: int = 5, metric: str = "accuracy", task: str = "task_id", order: str = "first_seq", generation: str = "generation", model: str | None = None, id_width: int | None = None) -> DataFrame:
    """The last n entries of each task as text lines, oldest first.

    Ids are shown whole unless a width is given; ``model`` names a column to show.
    """
    w = Window.partitionBy(task).orderBy(F.col(order).desc())
    last = archive.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    agent = F.col("agent_id").cast("string")
    shown = agent if id_width is None else F.substring(agent, 1, id_width)
    kind = F.lit("") if model is None else F.concat(F.lit(", Model: "), F.coalesce(F.col(model).cast("string"), F.lit("unknown")))
    line = F.format_string(
        f"- Generation %d, Agent ID %s%s, {metric}: %.4f", F.col(generation), shown, kind, F.coalesce(F.col(metric), F.lit(0.0))
    )
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return last.groupBy(task).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"))


def with_generation(log: DataFrame, order: str = "seq") -> DataFrame:
    """Depth in a binary parent tree over the log order: floor(log2(seq))."""
    return log.withColumn("generation", F.length(F.bin(order)) - 1)


def with_parent(log: DataFrame, score: str = "accuracy", task: str = "task_id") -> DataFrame:
    """Each run beside its parent's agent and score; roots have nulls."""
    parents = log.select(
        task, F.col("run_id").alias("parent_run_id"), F.col("agent_id").alias("parent_agent_id"), F.col(score).alias("parent_score")
    )
    return join_on(log, parents, [task, "parent_run_id"], "left")


def generation_stats(log: DataFrame, score: str = "accuracy", task: str = "task_id") -> DataFrame:
    """Per generation: children, mean and best improvement on the parent, share improved."""
    gain = F.col(score) - F.col("parent_score")
    born = with_parent(log, score, task).filter(F.col("parent_score").isNotNull())
    return born.groupBy(task, "generation").agg(
        F.count(F.lit(1)).alias("children"),
        F.avg(gain).alias("mean_gain"),
        F.max(gain).alias("best_gain"),
        F.avg(F.when(gain > 0, 1.0).otherwise(0.0)).alias("improved_share"),
    )


def generation_summary(log: DataFrame, score: str = "accuracy", task: str = "task_id") -> DataFrame:
    """Per generation: runs, best score and the run and parent run that reached it."""
    pairs = with_parent(log, score, task)
    # Falling worth first, then the smallest id, which may be text.
    best = F.min_by(
        F.struct("run_id", "agent_id", F.col(score).alias("s"), "parent_run_id", "parent_score"),
        F.struct(-_worth(F.col(score)), F.col("run_id")),
    )
    grouped = pairs.groupBy(task, "generation").agg(F.count(F.lit(1)).alias("runs"), F.avg(score).alias("mean_score"), best.alias("b"))
    return grouped.select(
        task, "generation", "runs", "mean_score", F.col("b.run_id").alias("best_run_id"), F.col("b.agent_id").alias("best_agent_id"),
        F.col("b.s").alias("best_score"), F.col("b.parent_run_id").alias("parent_run_id"), F.col("b.parent_score").alias("parent_score"),
    )


def final_results(archive: DataFrame, score: str = "accuracy", order: str = "seq", task: str | None = "task_id") -> DataFrame:
    """The best entry of each archive; with ``task`` None the one best over all."""
    if task is None:
        return archive.orderBy(_worth(F.col(score)).desc(), F.col(order), "task_id").limit(1)
    rest = [c for c in archive.columns if c != task]
    best = archive.groupBy(task).agg(F.min_by(F.struct(*rest), F.struct(-_worth(F.col(score)), F.col(order))).alias("__b"))
    return best.select(*[F.col(task) if c == task else F.col(f"__b.{c}").alias(c) for c in archive.columns])


def latest_predictions(predictions: DataFrame, agent: str = "agent_id", batch: str = "batch") -> DataFrame:
    """Per agent: its latest prediction batch and the rows in it."""
    sizes = predictions.groupBy(agent, batch).agg(F.count(F.lit(1)).alias("num_predictions"))
    return sizes.groupBy(agent).agg(F.max(F.struct(batch, "num_predictions")).alias("b")).select(
        agent, F.col(f"b.{batch}").alias("latest_batch"), "b.num_predictions"
    )


def retain_predictions(predictions: DataFrame, k: int = 5, agent: str = "agent_id", batch: str = "batch") -> DataFrame:
    """Rows of the k latest batches of each agent."""
    batches = predictions.select(agent, batch).distinct()
    w = Window.partitionBy(agent).orderBy(F.col(batch).desc())
    kept = batches.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
    return join_on(predictions, kept, [agent, batch], "left_semi")
