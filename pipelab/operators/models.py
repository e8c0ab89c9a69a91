"""Training, tuning and scoring with Spark ML."""

from __future__ import annotations

import json
import os
import random
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL, VECTOR = "__label", "__vector"

# The two search spaces of the forest.
FOREST_SPACE = {
    "n_estimators": ("int", 100, 500, 1),
    "max_depth": ("int", 3, 15, 1),
    "min_samples_leaf": ("int", 1, 10, 1),
    "max_features": ("choice", ["sqrt", "log2", None]),
}
FOREST_SPACE_STEPPED = {
    "n_estimators": ("int", 50, 500, 50),
    "max_depth": ("int", 3, 10, 1),
    "min_samples_leaf": ("int", 1, 5, 1),
    "max_features": ("choice", ["sqrt", "log2", None]),
    "bootstrap": ("choice", [True, False]),
}


LOGISTIC_SPACE = {
    "reg_param": ("choice", [0.0, 0.001, 0.01, 0.1]),
    "elastic_net": ("choice", [0.0, 0.5, 1.0]),
    "max_iter": ("int", 20, 100, 20),
}
BOOSTED_SPACE = {
    "n_estimators": ("int", 10, 50, 10),
    "max_depth": ("int", 2, 6, 1),
    "learning_rate": ("choice", [0.03, 0.1, 0.3]),
}
SPACES = {
    "logistic": LOGISTIC_SPACE, "random_forest": FOREST_SPACE, "gbt": BOOSTED_SPACE,
    "linear": LOGISTIC_SPACE, "random_forest_regressor": FOREST_SPACE, "gbt_regressor": BOOSTED_SPACE,
}
REGRESSORS = ("linear", "random_forest_regressor", "gbt_regressor")
#: Models that sample no rows (trees do, at least for their split candidates): what a partition holds does not matter.
UNSAMPLED = ("logistic", "linear")


def is_job_abort(error: Exception) -> bool:
    """Whether Spark gave up a job (executors or data lost), as against a faulty spec."""
    return "Job aborted" in str(error) or "SparkContext was shut down" in str(error)


@dataclass
class Trained:
    """A fitted model and the feature names behind its vector."""

    kind: str
    features: list[str]
    model: PipelineModel
    params: dict[str, Any] = field(default_factory=dict)
    widths: list[int] = field(default_factory=list)


def _assembler(n: int) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"__x{i}" for i in range(n)], outputCol=VECTOR)


def _vectors(df: DataFrame, features: list[str], keep: list) -> DataFrame:
    """Features under plain names, so that any level text may be part of a feature name."""
    vector = {f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT)}
    inputs = [(F.col(f"`{c}`") if c in vector else F.col(f"`{c}`").cast("double")).alias(f"__x{i}") for i, c in enumerate(features)]
    return _assembler(len(features)).transform(df.select(*keep, *inputs)).drop(*[f"__x{i}" for i in range(len(features))])


def _placed_partitions(df: DataFrame) -> int:
    """A number that adaptive execution does not change."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def training_frame(df: DataFrame, features: list[str], target: str, id_cols: list[str] | None = None) -> DataFrame:
    """Label and vector only. With ``id_cols`` rows are placed and sorted by id, so that a
    seeded forest does not depend on how the input was partitioned."""
    label = F.col(target).cast("double").alias(LABEL)
    if not id_cols:
        return _vectors(df, features, [label])
    # One number of partitions for any input: a forest draws its samples partition by partition.
    placed = df.repartition(_placed_partitions(df), *id_cols).sortWithinPartitions(*id_cols)
    return _vectors(placed, features, [label])


def _placing(kind: str, id_cols: list[str] | None) -> list[str] | None:
    """Ids to place training rows by. Models that sample nothing get the rows where they are: placing would
    shuffle and sort them for every pass of the fit and again for its summary."""
    return None if kind in UNSAMPLED else id_cols


def _estimator(kind: str, params: dict[str, Any], seed: int):
    common = {"featuresCol": VECTOR, "labelCol": LABEL}
    p = dict(params)
    known = {*SPACES.get(kind, {}), *(FOREST_SPACE_STEPPED if kind.startswith("random_forest") else ())}
    if kind in SPACES and set(p) - known:
        raise ValueError(f"{kind} has no parameter {sorted(set(p) - known)}")
    if kind == "logistic":
        return LogisticRegression(
            maxIter=p.get("max_iter", 100), regParam=p.get("reg_param", 0.0), elasticNetParam=p.get("elastic_net", 0.0), **common
        )
    if kind == "random_forest":
        return RandomForestClassifier(
            numTrees=p.get("n_estimators", 100),
            maxDepth=p.get("max_depth", 5),
            minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=p.get("max_features", "sqrt") or "all",
            bootstrap=p.get("bootstrap", True),
            seed=seed,
            **common,
        )
    if kind == "gbt":
        return GBTClassifier(
            maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), seed=seed, **common
        )
    if kind == "linear":
        return LinearRegression(
            maxIter=p.get("max_iter", 100), regParam=p.get("reg_param", 0.0), elasticNetParam=p.get("elastic_net", 0.0), **common
        )
    if kind == "random_forest_regressor":
        return RandomForestRegressor(
            numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 5), minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=p.get("max_features", "onethird") or "all", bootstrap=p.get("bootstrap", True), seed=seed, **common,
        )
    if kind == "gbt_regressor":
        return GBTRegressor(
            maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), seed=seed, **common
        )
    raise ValueError(f"unknown model: {kind}")


def _fit_vectors(frame: DataFrame, features: list[str], kind: str, params: dict[str, Any], seed: int) -> Trained:
    model = _estimator(kind, params, seed).fit(frame)
    return Trained(kind, features, PipelineModel([_assembler(len(features)), model]), dict(params), _widths(frame, features))


def _widths(frame: DataFrame, features: list[str]) -> list[int]:
    """Places each feature takes in the vector: 1, or the levels of a sparse one."""
    attributes = frame.schema[VECTOR].metadata.get("ml_attr", {}).get("attrs", {})
    names = [a.get("name", "") for kind in attributes.values() for a in sorted(kind, key=lambda a: a["idx"])]
    if len(names) <= len(features):
        return [1] * len(features)
    counts = dict.fromkeys(range(len(features)), 0)
    for n in names:
        counts[int(re.match(r"__x(\d+)", n)[1])] += 1
    return [counts[i] for i in range(len(features))]


def fit(df: DataFrame, features: list[str], target: str, kind: str = "random_forest", params: dict | None = None, seed: int = 42, id_cols: list[str] | None = None) -> Trained:
    return _fit_vectors(training_frame(df, features, target, _placing(kind, id_cols)), features, kind, params or {}, seed)


def fit_logistic(df: DataFrame, features: list[str], target: str, **params) -> Trained:
    return fit(df, features, target, "logistic", params)


def fit_random_forest(df: DataFrame, features: list[str], target: str, **params) -> Trained:
    return fit(df, features, target, "random_forest", params)


def fit_gbt(df: DataFrame, features: list[str], target: str, **params) -> Trained:
    return fit(df, features, target, "gbt", params)


def score(trained: Trained, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Predicted class and class probabilities per row: adds y_pred, proba; a number only for a regression."""
    keep = df.columns if keep is None else keep
    vectors = _vectors(df, trained.features, [F.col(f"`{c}`") for c in keep])
    out = trained.model.stages[-1].transform(vectors)
    if trained.kind in REGRESSORS:
        return out.select(*[F.col(f"`{c}`") for c in keep], F.col("prediction").alias("y_pred"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability").alias("proba"),
    )


def draw_params(space: dict, rng: random.Random) -> dict[str, Any]:
    drawn = {}
    for name, rule in space.items():
        if rule[0] == "int":
            _, low, high, step = rule
            drawn[name] = rng.randrange(low, high + 1, step)
        else:
            drawn[name] = rng.choice(rule[1])
    return drawn


def tune(
    train: DataFrame, valid: DataFrame, features: list[str], target: str, kind: str = "random_forest",
    space: dict | None = None, n_trials: int = 30, seed: int = 42, parallelism: int = 2, id_cols: list[str] | None = None,
) -> tuple[dict[str, Any], DataFrame]:
    """Seeded search for the best accuracy on ``valid``, in the space of the kind of model.

    The vectors are built once and kept; trials run a few at a time. Returns the best
    parameters and the table of trials.
    """
    rng = random.Random(seed)
    if space is None and kind not in SPACES:
        raise ValueError(f"unknown model: {kind}")
    trials = [draw_params(space or SPACES[kind], rng) for _ in range(n_trials)]
    fit_rows = training_frame(train, features, target, _placing(kind, id_cols)).persist()
    test_rows = training_frame(valid, features, target).persist()

    def run(params: dict[str, Any]) -> float:
        model = _estimator(kind, params, seed).fit(fit_rows)
        hit = F.when(F.col("prediction") == F.col(LABEL), 1.0).otherwise(0.0)
        return model.transform(test_rows).agg(F.avg(hit)).first()[0] or 0.0

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(run, trials))
    finally:
        fit_rows.unpersist()
        test_rows.unpersist()
    best = max(range(n_trials), key=lambda i: scores[i])
    rows = [(i, json.dumps(p), float(s), i == best) for i, (p, s) in enumerate(zip(trials, scores))]
    table = train.sparkSession.createDataFrame(rows, "trial int, params string, accuracy double, best boolean")
    return trials[best], table


def importance_values(trained: Trained) -> dict[str, float]:
    """Tree importances, or mean absolute coefficients over classes, by feature."""
    model = trained.model.stages[-1]
    if trained.kind == "linear":
        values = abs(model.coefficients.toArray())
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        raise ValueError(f"{trained.kind} has no feature importance")
    shares, at = {}, 0
    for f, width in zip(trained.features, trained.widths or [1] * len(trained.features)):
        shares[f] = float(sum(values[at : at + width]))
        at += width
    return shares


def feature_importance(spark: SparkSession, trained: Trained) -> DataFrame:
    """(feature, importance), strongest first."""
    rows = list(importance_values(trained).items())
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(spark: SparkSession, trained: Trained, path: str) -> None:
    trained.model.write().overwrite().save(os.path.join(path, "model"))
    meta = json.dumps({"kind": trained.kind, "features": trained.features, "params": trained.params, "widths": trained.widths})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def load_model(spark: SparkSession, path: str) -> Trained:
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    return Trained(meta["kind"], meta["features"], PipelineModel.load(os.path.join(path, "model")), meta["params"], meta.get("widths", []))
