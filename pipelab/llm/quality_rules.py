"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on statistics of labelled texts. Every path from a root to a node is a
conjunction of comparisons, that is, a rule. A logistic model with an L1 penalty weighs the
rules and sets most weights to 0; the rules left over become one Spark column expression, so
scoring needs no model object on the executors, only the statistics.

Null and empty texts have all statistics 0 and get the score that the rules give for it.
Without labelled rows, or with one class only, the score is a constant: 0.5, or the class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelab.llm.batches import bound_batches
from pipelab.llm.text_statistics import statistics_of
from pipelab.session import cut_lineage

#: Labelled rows used for fitting, those with the lowest hash of the id.
FIT_ROWS = 20_000
#: Of them, rows in one part. Every step of the fit is a task for each part, and the driver keeps note of every task.
FIT_PART_ROWS = 5_000
TREES = 16
DEPTH = 3
PENALTY = 0.0005
THRESHOLD = 0.3


@dataclass(frozen=True)
class Rule:
    """Comparisons that must all hold: (statistic, is upper limit, value)."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, upper, value in self.terms:
            out = out & ((stats[k] <= value) if upper else (stats[k] > value))
        return out.cast("double")


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.lit(weight) * rule.column(stats)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def rules_of(description: str) -> list[Rule]:
    """Rules of all paths in the text form of a tree ensemble."""
    found: list[Rule] = []
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in description.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        m = _BRANCH.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (int(m[2]), m[3] == "<=", float(m[4]))))
        limits: dict[tuple[int, bool], float] = {}
        for _, (k, upper, value) in path:
            old = limits.get((k, upper))
            limits[k, upper] = value if old is None else (min if upper else max)(old, value)
        found.append(Rule(tuple((k, upper, v) for (k, upper), v in sorted(limits.items()))))
    return list(dict.fromkeys(found))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit_rules(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7,
) -> RuleModel:
    """Rules and weights from labelled rows outside the held-out fold.

    At most ``fit_rows`` labelled ids are used, those with the lowest hash, so that the
    labels sent to the executors and the rows trained on have a fixed bound.
    """
    bound_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("__id").isNotNull() & ~is_held_out(F.col("__id")))
        .orderBy(F.xxhash64("__id"), "__id", "label")
        .limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    joined = rows.join(F.broadcast(chosen), "__id")
    train = cut_lineage(
        joined.select("__id", "label", statistics_of("__text").alias("stats")).orderBy(F.xxhash64("__id"), "__id")
    )
    classes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(classes) < 2:
        return RuleModel((), (), 0.0 if not classes else (30.0 if 1.0 in classes else -30.0))
    train = train.coalesce(1 + sum(classes.values()) // FIT_PART_ROWS)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.7
    ).fit(train.select("label", array_to_vector("stats").alias("x")))
    rules = rules_of(forest.toDebugString)
    hits = train.select("label", array_to_vector(F.array(*[r.column(F.col("stats")) for r in rules])).alias("x"))
    fit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(cut_lineage(hits))
    kept = [(r, float(w)) for r, w in zip(rules, fit.coefficients) if w != 0.0]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(fit.intercept))


def with_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``rule_score`` and ``rule_label`` (1 where the score is at least the threshold)."""
    bound_batches(docs.sparkSession)
    scored = docs.withColumn("rule_stats", statistics_of(F.coalesce(F.col(text_col), F.lit(""))))
    scored = scored.withColumn("rule_score", model.score(F.col("rule_stats"))).drop("rule_stats")
    return scored.withColumn("rule_label", (F.col("rule_score") >= threshold).cast("int"))
