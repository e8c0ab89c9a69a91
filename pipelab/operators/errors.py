"""Where a model goes wrong: error rates by class, feature and level, residual shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelab.functions.numeric import ratio
from pipelab.operators.ordering import exact_quantiles


def error_flag(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """1.0 where the prediction is wrong."""
    return F.when(F.col(y_true) == F.col(y_pred), 0.0).otherwise(1.0)


def error_summary(df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    err = error_flag(y_true, y_pred)
    return df.groupBy(*(groups or [])).agg(
        F.avg(err).alias("error_rate"),
        F.count_if(err == 0).alias("correct_count"),
        F.count_if(err == 1).alias("incorrect_count"),
    )


def class_errors(df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Error rate per true class."""
    return df.groupBy(*(groups or []), F.col(y_true).alias("y_true")).agg(
        F.avg(error_flag(y_true, y_pred)).alias("error_rate"), F.count(F.lit(1)).alias("n")
    )


def feature_error_correlation(
    df: DataFrame, features: list[str], error: Column | None = None, groups: list[str] | None = None
) -> DataFrame:
    """Pearson correlation of numeric features with an error column, strongest first.

    One aggregation for all features. Rows with a null feature are left out of that
    feature only; a constant feature gives null. Pass a residual for regression.
    """
    groups = list(groups or [])
    base = df.select(*groups, *features, (error_flag() if error is None else error).cast("double").alias("__e"))
    aggs = []
    for f in features:
        x = F.col(f"`{f}`").cast("double")
        e = F.when(x.isNotNull(), F.col("__e"))
        spread = F.stddev_pop(x) * F.stddev_pop(e)
        aggs.append(ratio(F.covar_pop(x, e), F.nullif(spread, F.lit(0.0))).alias(f))
    wide = base.groupBy(*groups).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("correlation")) for f in features])
    return (
        wide.select(*groups, F.explode(cells).alias("c"))
        .select(*groups, "c.feature", "c.correlation")
        .orderBy(*groups, F.abs("correlation").desc_nulls_last(), "feature")
    )


def categorical_error_rates(
    df: DataFrame, features: list[str], error: Column | None = None, groups: list[str] | None = None
) -> DataFrame:
    """Mean error per level of each categorical feature; null levels are left out."""
    groups = list(groups or [])
    base = df.select(
        *groups,
        (error_flag() if error is None else error).alias("__e"),
        *[F.col(f"`{f}`").cast("string").alias(f) for f in features],
    )
    return (
        base.unpivot([*groups, "__e"], features, "feature", "level")
        .filter(F.col("level").isNotNull())
        .groupBy(*groups, "feature", "level")
        .agg(F.avg("__e").alias("error_rate"), F.count(F.lit(1)).alias("n"))
    )


def regression_error_stats(
    df: DataFrame, groups: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Absolute and signed error statistics in long form: (groups..., statistic, value)."""
    groups = list(groups or [])
    signed = df.select(*groups, (F.col(y_true) - F.col(y_pred)).alias("signed")).withColumn("absolute", F.abs("signed"))
    moments = {
        "mean_absolute_error": F.avg("absolute"),
        "max_error": F.max("absolute"),
        "mean_error": F.avg("signed"),
        "mean": F.avg("signed"),
        "std": F.stddev_pop("signed"),
        "min": F.min("signed"),
        "max": F.max("signed"),
    }
    wide = signed.groupBy(*groups).agg(*[c.alias(n) for n, c in moments.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in moments])
    stats = wide.select(*groups, F.explode(cells).alias("s")).select(*groups, "s.statistic", "s.value")
    quantiles = exact_quantiles(signed, ["signed", "absolute"], [0.25, 0.5, 0.75], groups)
    name = F.when(F.col("column") == "signed", F.format_string("%d%%", (F.col("prob") * 100).cast("int"))).when(
        F.col("prob") == 0.5, F.lit("median_absolute_error")
    )
    return stats.unionByName(
        quantiles.withColumn("statistic", name).filter("statistic IS NOT NULL").select(*groups, "statistic", "value")
    )
