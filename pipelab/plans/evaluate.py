"""Evaluate, cross-validate, compare and search pipeline specs."""

from __future__ import annotations

import random
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelab.operators import metrics as me
from pipelab.operators import models as mo
from pipelab.operators.archive import final_results
from pipelab.operators.columns import column_kinds, with_int_target
from pipelab.operators.replay import replay_archive
from pipelab.operators.splits import kfold, stratified_kfold, stratified_split
from pipelab.plans.specs import PipelineSpec, prepare, mutate

@dataclass
class Evaluation:
    """Outcome of one spec; a failure has score 0 and its error text."""

    spec: PipelineSpec
    score: float
    metrics: dict[str, float]
    error: str | None = None
    trained: mo.Trained | None = None
    predictions: DataFrame | None = None
    importance: dict[str, float] = field(default_factory=dict)
    seconds: float = 0.0


def prediction_table(scored: DataFrame, target: str, classes: int, keep: list[str]) -> DataFrame:
    """Scored rows as (keep..., y_true, y_pred, score[, cls]): one row per row for two
    classes, one per (row, class) for more; without a score for a regression (0 classes)."""
    if classes == 0:
        return scored.select(*keep, F.col(target).alias("y_true"), "y_pred")
    base = scored.select(*keep, F.col(target).alias("y_true"), "y_pred", "proba")
    if classes <= 2:
        return base.withColumn("score", F.get("proba", F.lit(1))).drop("proba")
    return me.explode_proba(base, "proba", list(range(classes)), [*keep, "y_true", "y_pred"])


def class_labels(df: DataFrame, target: str) -> list:
    """The classes in order. A classifier holds a column of weights or counts per class, so
    they are few enough for the driver wherever a model can be trained."""
    return [r[0] for r in df.select(target).filter(F.col(target).isNotNull()).distinct().orderBy(target).collect()]


def with_class_numbers(df: DataFrame, target: str) -> DataFrame:
    """Rows with a known class, numbered 0..k-1 in the order of the labels, whatever these are.

    Predictions hold the numbers; ``class_labels`` gives the label of each.
    """
    if dict(df.dtypes)[target] in ("tinyint", "smallint", "int", "bigint"):
        known = with_int_target(df, target)
        low, high, n = known.select(target).distinct().agg(F.min(target), F.max(target), F.count(target)).first()
        if low == 0 and high + 1 <= max(2, 1.1 * n):
            return known
    labels = class_labels(df, target)
    numbers = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], T.StructType([df.schema[target], T.StructField("__class", T.IntegerType())]))
    joined = df.join(F.broadcast(numbers), target)
    return joined.select(*[F.col("__class").alias(target) if c == target else F.col(f"`{c}`") for c in df.columns])


def class_count(df: DataFrame, target: str) -> int:
    """1 + the highest class number."""
    top = df.agg(F.max(target)).first()[0]
    if top is None:
        raise ValueError("no row has a class")
    return int(top) + 1


def _train(train: DataFrame, spec: PipelineSpec, features: list[str], target: str, id_cols: list[str], seed: int) -> mo.Trained:
    params = dict(spec.params)
    if spec.tune_trials:
        # tuning has its own hold-out inside the training rows
        inner = stratified_split(train, target, id_cols, 0.2, seed + 1, "__tune")
        best, _ = mo.tune(inner.filter("NOT __tune"), inner.filter("__tune"), features, target, spec.model, None, spec.tune_trials, seed, id_cols=id_cols)
        params.update(best)
    return mo.fit(train, features, target, spec.model, params, seed, id_cols)


def _parts(marked: DataFrame, held: Column, drop: str) -> tuple[DataFrame, DataFrame]:
    return marked.filter(~held).drop(drop), marked.filter(held).drop(drop)


def split_rows(df: DataFrame, target: str, id_cols: list[str], ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with a known target, marked for validation. Kept in memory or on executor
    disks while models are trained on them; lost parts are computed again."""
    return stratified_split(with_class_numbers(df, target), target, id_cols, ratio, seed).persist()


def _measure(
    marked: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str], seed: int, metric: str, fit_scope: str, classes: int
) -> Evaluation:
    train, valid = _parts(marked, F.col("is_validation"), "is_validation")
    ready = prepare(train if fit_scope == "train" else marked.drop("is_validation"), spec, target, id_cols)
    trained = _train(ready.transform(train), spec, ready.features, target, id_cols, seed)
    table = prediction_table(mo.score(trained, ready.transform(valid), [*id_cols, target]), target, classes, id_cols)
    report = report_of(table, classes)
    values = {r["metric"]: r["value"] for r in report.collect() if r["value"] is not None}
    return Evaluation(spec, values.get(metric, 0.0), values, None, trained, table, mo.importance_values(trained))


def evaluate_spec(
    df: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str], ratio: float = 0.2, seed: int = 42,
    metric: str = "accuracy", fit_scope: str = "train", marked: DataFrame | None = None, classes: int | None = None,
) -> Evaluation:
    """Split, prepare, (tune,) train, score, measure. ``fit_scope='all'`` also fits the
    preparation on the validation rows, for comparison only. ``marked``: a split made
    before, shared by many specs."""
    start = time.time()
    own = None
    try:
        if marked is None:
            own = marked = split_rows(df, target, id_cols, ratio, seed)
        known = class_count(marked, target) if classes is None else classes
        done = _measure(marked, spec, target, id_cols, seed, metric, fit_scope, known)
    except Exception as e:  # a spec that fails must not end the run; a lost cluster must
        if mo.is_job_abort(e):
            raise
        done = Evaluation(spec, 0.0, {metric: 0.0}, f"{type(e).__name__}: {e}")
    finally:
        if own is not None:
            own.unpersist()
    done.seconds = time.time() - start
    return done


def fold_rows(df: DataFrame, target: str, id_cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Rows with a known target and their fold, kept while models are trained on them."""
    return stratified_kfold(with_class_numbers(df, target), target, id_cols, k, seed).persist()


def _folds(df: DataFrame, target: str, id_cols: list[str], k: int, seed: int, task_type: str) -> DataFrame:
    """Stratified folds for classes, contiguous ones in id order for a number.

    Borders of contiguous folds are looked up in several passes, so the rows are kept before that,
    until they are kept with their folds.
    """
    if task_type != "regression":
        return fold_rows(df, target, id_cols, k, seed)
    known = df.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double")).persist()
    try:
        folded = kfold(known, id_cols, k).persist()
        folded.count()
    finally:
        known.unpersist()
    return folded


def _classes(folded: DataFrame, target: str, task_type: str) -> int:
    """Number of classes; 0 for a regression."""
    return 0 if task_type == "regression" else class_count(folded, target)


def fold_predictions(folded: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str], k: int = 5, seed: int = 42, classes: int | None = None) -> DataFrame:
    """Every row predicted once, by the model that did not see its fold."""
    classes = class_count(folded, target) if classes is None else classes
    out = None
    for i in range(k):
        train, valid = _parts(folded, F.col("fold") == i, "fold")
        ready = prepare(train, spec, target, id_cols)
        trained = _train(ready.transform(train), spec, ready.features, target, id_cols, seed)
        scored = mo.score(trained, ready.transform(valid), [*id_cols, target]).withColumn("fold", F.lit(i))
        part = prediction_table(scored, target, classes, [*id_cols, "fold"])
        out = part if out is None else out.unionByName(part)
    return out


def report_of(table: DataFrame, classes: int, groups: list[str] | None = None) -> DataFrame:
    """All metrics of a prediction table; for two classes also the F1 weighted over both."""
    groups = list(groups or [])
    if classes == 0:
        return me.metrics_report(table, "regression", groups)
    if classes > 2:
        return me.metrics_report(table, "multiclass", groups)
    weighted = me.weighted_scores(table, groups).select(*groups, F.lit("f1_weighted").alias("metric"), F.col("f1").alias("value"))
    return me.metrics_report(table, "binary", groups).unionByName(weighted)


def _wanted(report: DataFrame, metrics: list[str] | None) -> DataFrame:
    return report if metrics is None else report.filter(F.col("metric").isin(metrics))


def _cross_validated(
    folded: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str], k: int, seed: int, classes: int, metrics: list[str] | None = None
) -> list:
    table = fold_predictions(folded, spec, target, id_cols, k, seed, classes)
    return me.cv_summary(_wanted(report_of(table, classes, ["fold"]), metrics).withColumnRenamed("value", "score")).collect()


CV_SCHEMA = "metric string, mean double, std double, scores array<double>"


def cross_validate(df: DataFrame, spec: PipelineSpec, target: str, id_cols: list[str], k: int = 5, seed: int = 42, metrics: list[str] | None = None, task_type: str = "classification") -> DataFrame:
    """(metric, mean, std, scores): one fold assignment for all metrics, all folds
    measured in one aggregation. ``metrics``: the ones wanted, default all of the task type."""
    folded = _folds(df, target, id_cols, k, seed, task_type)
    try:
        rows = _cross_validated(folded, spec, target, id_cols, k, seed, _classes(folded, target, task_type), metrics)
    finally:
        folded.unpersist()
    return df.sparkSession.createDataFrame(rows, CV_SCHEMA)


def compare_specs(df: DataFrame, specs: list[PipelineSpec], target: str, id_cols: list[str], k: int = 5, seed: int = 42, metrics: list[str] | None = None, task_type: str = "classification") -> DataFrame:
    """(name, status, metric, mean, std, error) for every spec, failed ones included."""
    folded = _folds(df, target, id_cols, k, seed, task_type)
    rows = []
    try:
        classes = _classes(folded, target, task_type)
        for spec in specs:
            try:
                for r in _cross_validated(folded, spec, target, id_cols, k, seed, classes, metrics):
                    rows.append((spec.name, "completed", r["metric"], r["mean"], r["std"], None))
            except Exception as e:  # as above
                if mo.is_job_abort(e):
                    raise
                rows.append((spec.name, "failed", None, None, None, f"{type(e).__name__}: {e}"))
    finally:
        folded.unpersist()
    schema = "name string, status string, metric string, mean double, std double, error string"
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass
class SearchResult:
    best: Evaluation
    log: DataFrame
    archive: DataFrame
    decisions: DataFrame


def search(
    df: DataFrame, target: str, id_cols: list[str], start: PipelineSpec | None = None, generations: int = 10,
    population: int = 3, seed: int = 42, metric: str = "accuracy", limit: int = 100, task: str = "search",
) -> SearchResult:
    """Evaluate a population, keep its best, fill up with mutated children of drawn
    parents, and archive every evaluated spec. The kept spec is not evaluated again."""
    rng = random.Random(seed)
    numeric = [c for c, k in column_kinds(df.drop(*id_cols), target).items() if k == "numeric"]
    members: list[tuple[int, int | None, PipelineSpec]] = [(1, None, start or PipelineSpec("start"))]
    members += [(i, None, mutate(members[0][2], rng, f"agent_{i}", numeric)) for i in range(2, population + 1)]
    next_id = population + 1
    results: dict[int, Evaluation] = {}
    rows = []
    best_id = None
    marked = split_rows(df, target, id_cols, seed=seed)  # one split for all specs
    classes = class_count(marked, target)
    for generation in range(generations):
        for agent_id, parent_id, spec in members:
            if agent_id in results:
                continue
            done = evaluate_spec(df, spec, target, id_cols, seed=seed, metric=metric, marked=marked, classes=classes)
            results[agent_id] = done
            rows.append((task, agent_id, len(rows) + 1, parent_id, generation, float(done.score),
                         {k: float(v) for k, v in done.metrics.items()}, spec.to_json(), done.error))
            if best_id is None or done.score > results[best_id].score:
                best_id = agent_id
        specs = {a: s for a, _, s in members}
        following = [next(m for m in members if m[0] == best_id)] if best_id in specs else [(best_id, None, results[best_id].spec)]
        while len(following) < population:
            parent_id, _, parent = rng.choice(members)
            following.append((next_id, parent_id, mutate(parent, rng, f"agent_{next_id}", numeric)))
            next_id += 1
        members = following
    marked.unpersist()
    log = df.sparkSession.createDataFrame(
        rows,
        "task_id string, agent_id bigint, seq bigint, parent_id bigint, generation int, score double, "
        "metrics map<string,double>, spec string, error string",
    ).withColumn("run_id", F.col("seq"))
    archive, decisions = replay_archive(log, limit, "score")
    return SearchResult(results[best_id], log, archive, decisions)


def best_of(result: SearchResult) -> DataFrame:
    return final_results(result.log, "score").select("agent_id", "score", "metrics", "generation", "parent_id")
