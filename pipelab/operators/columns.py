"""Column-level preparation: profile, target split, selection, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_kinds(df: DataFrame, target: str | None = None) -> dict[str, str]:
    """'numeric' or 'categorical' per non-target column; other types are left out."""
    kinds = {}
    for field in df.schema.fields:
        if field.name == target:
            continue
        if isinstance(field.dataType, T.NumericType):
            kinds[field.name] = "numeric"
        elif isinstance(field.dataType, T.StringType):
            kinds[field.name] = "categorical"
    return kinds


def column_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, kind, nulls, distinct) for every feature column.

    Nulls come from one aggregation; distinct counts from (column, value) pairs that are
    reduced map-side, so no buffer ever holds the values of a column.
    """
    kinds = column_kinds(df, target)
    names = list(kinds)
    as_text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    pairs = as_text.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct"),
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for c in names for x in (c, kinds[c])]), F.col("column"))
    return counts.select("column", kind.alias("kind"), "nulls", "distinct")


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features, and the target as int."""
    return df.drop(target), df.select(F.col(target).cast("int").alias(target))


def with_int_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a known target, as int, in one frame with their features."""
    return df.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def align_columns(df: DataFrame, like: list[str]) -> DataFrame:
    """Exactly the columns of ``like``: missing ones are 0, extra ones are dropped."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in like])
