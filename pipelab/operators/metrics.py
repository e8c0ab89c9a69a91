"""Metrics over a prediction table.

Every function takes ``groups`` (agent, fold, task, ...), so any number of prediction
sets is scored in one aggregation. Counts are reduced map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelab.functions.numeric import join_on, ratio, ratio_or_zero
from pipelab.operators.ordering import preceding
from pipelab.session import cut_lineage

def confusion(df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Row counts by true and predicted class: (groups..., y_true, y_pred, n)."""
    return df.groupBy(*(groups or []), F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _hits(weight: Column) -> Column:
    return F.sum(F.when(F.col("y_true") == F.col("y_pred"), weight).otherwise(F.lit(0)))


def accuracy(df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    hit = F.when(F.col(y_true) == F.col(y_pred), 1.0).otherwise(0.0)
    return df.groupBy(*(groups or [])).agg(F.avg(hit).alias("accuracy"))


def _binary_from_counts(counts: DataFrame, groups: list[str], positive) -> DataFrame:
    is_true, is_pred = F.col("y_true") == F.lit(positive), F.col("y_pred") == F.lit(positive)
    n = F.col("n")
    sums = counts.groupBy(*groups).agg(
        ratio(_hits(n), F.sum(n)).alias("accuracy"),
        F.sum(F.when(is_true & is_pred, n).otherwise(0)).alias("tp"),
        F.sum(F.when(is_pred, n).otherwise(0)).alias("predicted"),
        F.sum(F.when(is_true, n).otherwise(0)).alias("actual"),
    )
    tp, predicted, actual = F.col("tp"), F.col("predicted"), F.col("actual")
    return sums.select(
        *groups,
        "accuracy",
        ratio_or_zero(tp, predicted).alias("precision"),
        ratio_or_zero(tp, actual).alias("recall"),
        ratio_or_zero(2 * tp, predicted + actual).alias("f1"),
    )


def _weighted_from_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Per class scores weighted by the true count of the class."""
    sides = F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    per_class = (
        counts.select(*groups, F.explode(sides).alias("s"))
        .groupBy(*groups, "s.cls")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"))
    )
    tp, predicted, actual = F.col("tp"), F.col("predicted"), F.col("actual")
    weighted = lambda score: ratio_or_zero(F.sum(score * actual), F.sum(actual))
    return per_class.groupBy(*groups).agg(
        ratio(F.sum("tp"), F.sum("actual")).alias("accuracy"),
        weighted(ratio_or_zero(tp, predicted)).alias("precision"),
        weighted(ratio_or_zero(tp, actual)).alias("recall"),
        weighted(ratio_or_zero(2 * tp, predicted + actual)).alias("f1"),
    )


def binary_scores(df: DataFrame, groups: list[str] | None = None, positive=1, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 on a zero denominator."""
    return _binary_from_counts(confusion(df, groups, y_true, y_pred), list(groups or []), positive)


def weighted_scores(df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 averaged over classes by true count."""
    return _weighted_from_counts(confusion(df, groups, y_true, y_pred), list(groups or []))


def _auc_parts(counts: DataFrame, keys: list[str], pos: Column) -> DataFrame:
    """Adds, per score, twice the positives above it plus those tied with it."""
    per_score = cut_lineage(counts.groupBy(*keys, "score").agg(F.sum(pos).alias("pos")))
    placed = preceding(per_score, keys, ["score"], {"pos_below": ("sum", F.col("pos"))})
    totals = per_score.groupBy(*keys).agg(F.sum("pos").alias("pos_all"))
    above = 2 * (F.col("pos_all") - F.col("pos_below")) - F.col("pos")
    return join_on(placed, totals, keys, null_safe=True).select(*keys, "score", "pos_all", above.alias("twice_above"))


def _binary_auc(counts: DataFrame, groups: list[str], positive) -> DataFrame:
    """AUC from (groups..., y_true, score, n): ties count half; rows without class or score are left out."""
    counts = counts.filter(F.col("y_true").isNotNull() & F.col("score").isNotNull())
    is_pos = F.col("y_true") == F.lit(positive)
    per_score = cut_lineage(counts.groupBy(*groups, "score").agg(
        F.sum(F.when(is_pos, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(F.col("n"))).alias("neg"),
    ))  # read for the sizes and again for the prefix
    placed = preceding(per_score, groups, ["score"], {"neg_below": ("sum", F.col("neg"))})
    won = F.col("pos").cast("double") * (2 * F.col("neg_below") + F.col("neg")).cast("double")
    pairs = 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return placed.groupBy(*groups).agg(ratio(F.sum(won), pairs).alias("roc_auc"))


def roc_auc(
    df: DataFrame, groups: list[str] | None = None, positive=1, y_true: str = "y_true", score: str = "score",
) -> DataFrame:
    """Exact area under the ROC curve; null when a group has one class only."""
    groups = list(groups or [])
    counts = df.groupBy(*groups, F.col(y_true).alias("y_true"), F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return _binary_auc(counts, groups, positive)


def explode_proba(df: DataFrame, proba: str, classes: list, keep: list[str]) -> DataFrame:
    """One row per (row, class) from an array of class probabilities: adds cls, score."""
    labels = F.array(*[F.lit(c) for c in classes])
    return df.select(*keep, F.posexplode(proba).alias("__i", "score")).withColumn(
        "cls", F.element_at(labels, F.col("__i") + 1)
    ).drop("__i")


def _class_pair_auc(df: DataFrame, groups: list[str], y_true: str, cls: str, score: str) -> DataFrame:
    """Directed AUC for every (class, other true class), with their row counts.

    Positives of a class are ranked once; each negative then finds how many are above
    it, so no row is copied per pair.
    """
    known = df.filter(F.col(y_true).isNotNull() & F.col(score).isNotNull())  # the others are left out
    counts = known.groupBy(*groups, F.col(cls).alias("cls"), F.col(y_true).alias("y_true"), F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = [*groups, "cls"]
    own = F.when(F.col("y_true") == F.col("cls"), F.col("n")).otherwise(0)
    above = _auc_parts(counts, keys, own)
    negatives = join_on(counts, above, [*keys, "score"], null_safe=True).filter("y_true <> cls")
    return negatives.groupBy(*keys, F.col("y_true").alias("other")).agg(
        F.max("pos_all").alias("pos"),
        F.sum("n").alias("neg"),
        F.sum(F.col("twice_above").cast("double") * F.col("n")).alias("won"),
    )


def roc_auc_ovr(
    df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", cls: str = "cls", score: str = "score",
) -> DataFrame:
    """One-vs-rest AUC weighted by class share; input has one row per (row, class)."""
    groups = list(groups or [])
    pairs = _class_pair_auc(df, groups, y_true, cls, score)
    per_class = pairs.groupBy(*groups, "cls").agg(
        F.max("pos").alias("pos"), ratio(F.sum("won"), 2.0 * F.max("pos") * F.sum("neg")).alias("auc")
    )
    return per_class.groupBy(*groups).agg(ratio(F.sum(F.col("auc") * F.col("pos")), F.sum("pos")).alias("roc_auc_ovr"))


def roc_auc_ovo(
    df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", cls: str = "cls", score: str = "score",
) -> DataFrame:
    """One-vs-one AUC: mean of both directions per class pair, weighted by the pair's rows."""
    groups = list(groups or [])
    pairs = _class_pair_auc(df, groups, y_true, cls, score)
    per_pair = (
        pairs.withColumn("a", F.least("cls", "other"))
        .withColumn("b", F.greatest("cls", "other"))
        .groupBy(*groups, "a", "b")
        .agg(
            F.avg(ratio(F.col("won"), 2.0 * F.col("pos") * F.col("neg"))).alias("auc"),
            F.max(F.col("pos") + F.col("neg")).alias("rows"),
        )
    )
    return per_pair.groupBy(*groups).agg(ratio(F.sum(F.col("auc") * F.col("rows")), F.sum("rows")).alias("roc_auc_ovo"))


def regression_scores(df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """mse, rmse, mae and r2 in one aggregation."""
    err = F.col(y_true) - F.col(y_pred)
    sums = df.groupBy(*(groups or [])).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(y_true).alias("__var")
    )
    return sums.select(
        *(groups or []), "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - ratio(F.col("mse"), F.col("__var"))).alias("r2")
    )


def cv_summary(scores: DataFrame, groups: list[str] | None = None, metric: str = "metric", fold: str = "fold", value: str = "score") -> DataFrame:
    """Mean, population std and the scores in fold order, per metric."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(fold, value))), lambda s: s[value])
    return scores.groupBy(*(groups or []), metric).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), ordered.alias("scores")
    )


def primary_score(metrics: Column, name: str) -> Column:
    """A named metric out of a metric map; a missing one counts as 0."""
    return F.coalesce(metrics[name], F.lit(0.0))


def to_long(wide: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric: (groups..., metric, value)."""
    return wide.unpivot(groups, metrics, "metric", "value") if groups else wide.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")
    ).select("m.metric", "m.value")


def metrics_report(
    df: DataFrame, task_type: str = "binary", groups: list[str] | None = None, positive=1,
    y_true: str = "y_true", y_pred: str = "y_pred", score: str | None = "score", cls: str = "cls",
) -> DataFrame:
    """All metrics of a task type in long form: (groups..., metric, value).

    Binary: one count table over (true, predicted, score) serves every metric.
    Multiclass: input has one row per (row, class); regression: y_pred is a number.
    """
    groups = list(groups or [])
    if task_type == "regression":
        return to_long(regression_scores(df, groups, y_true, y_pred), groups, ["mse", "rmse", "mae", "r2"])
    if task_type == "binary":
        cells = [F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")]
        if score is None:
            base = df.groupBy(*groups, *cells).agg(F.count(F.lit(1)).alias("n"))
        else:
            base = cut_lineage(df.groupBy(*groups, *cells, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n")))
        report = to_long(_binary_from_counts(base, groups, positive), groups, ["accuracy", "precision", "recall", "f1"])
        if score is None:
            return report
        return report.unionByName(to_long(_binary_auc(base, groups, positive), groups, ["roc_auc"]))
    if task_type != "multiclass":
        raise ValueError(f"unknown task type: {task_type}")
    own_row = df.filter(F.col(cls) == F.col(y_true))
    report = to_long(weighted_scores(own_row, groups, y_true, y_pred), groups, ["accuracy", "precision", "recall", "f1"])
    for fn, name in ((roc_auc_ovr, "roc_auc_ovr"), (roc_auc_ovo, "roc_auc_ovo")):
        report = report.unionByName(to_long(fn(df, groups, y_true, cls, score), groups, [name]))
    return report
