"""Feature engineering: fit on one frame, transform any frame.

A fit reduces to a handful of parameters (one aggregation job for a whole spec). A
transform is a pure projection over literals: no shuffle, and it works on a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import Bucketizer, OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelab.functions.numeric import join_on
from pipelab.operators.ordering import exact_quantiles, ranked
from pipelab.session import cut_lineage

MAX_LEVELS = 1_000


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Step:
    """One fitted transform: its kind and the parameters per column."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)


# --- fits -------------------------------------------------------------------------------


def fit_median(df: DataFrame, columns: list[str]) -> Step:
    """Exact medians (mean of the middle two for an even count)."""
    rows = exact_quantiles(df, columns, [0.5]).collect() if columns else []
    return Step("fill", {r["column"]: r["value"] for r in rows})


def fit_mean(df: DataFrame, columns: list[str]) -> Step:
    row = df.agg(*[F.avg(_c(c)).alias(c) for c in columns]).first() if columns else {}
    return Step("fill", {c: row[c] for c in columns})


def fit_mode(df: DataFrame, columns: list[str]) -> Step:
    """Most frequent value; ties go to the smallest.

    Values are counted in a distributed group-by, then one winner per column is kept,
    so no buffer holds the values of a column.
    """
    params = {}
    by_type: dict[str, list[str]] = {}
    for name, dtype in df.select(*[_c(c) for c in columns]).dtypes:
        by_type.setdefault(dtype, []).append(name)
    for names in by_type.values():
        counts = (
            df.select(*[_c(c) for c in names])
            .unpivot([], names, "column", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.groupBy("column").agg(F.max("n").alias("top"))
        winners = join_on(counts, best, ["column"]).filter("n = top").groupBy("column").agg(F.min("value").alias("value"))
        params.update({r["column"]: r["value"] for r in winners.collect()})
    return Step("fill", params)


def constant_fill(columns: list[str], value: Any = "missing") -> Step:
    """Nulls become a level of their own."""
    return Step("fill", {c: value for c in columns})


def fit_standard(df: DataFrame, columns: list[str]) -> Step:
    """Mean and population std; a zero std divides by 1."""
    if not columns:
        return Step("scale", {})
    row = df.agg(
        *[F.avg(_c(c)).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(_c(c)).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    return Step("scale", {c: (row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)})


class TooManyLevels(ValueError):
    """A column has more levels than may be collected."""


def wide_columns(df: DataFrame, columns: list[str], max_levels: int = MAX_LEVELS) -> list[str]:
    """Columns with more than ``max_levels`` levels, by a count that keeps no values."""
    if not columns:
        return []
    pairs = df.select(*[_c(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "level")
    sizes = pairs.filter(F.col("level").isNotNull()).distinct().groupBy("column").count()
    wide = {r["column"] for r in sizes.filter(F.col("count") > max_levels).collect()}
    return [c for c in columns if c in wide]


def levels_and_wide(df: DataFrame, columns: list[str], max_levels: int) -> tuple[dict[str, list[str]], list[str]]:
    """Levels of the columns that have at most ``max_levels``, and the other columns.

    One bounded read where no column is wide, which is the usual case.
    """
    try:
        return fit_levels(df, columns, max_levels), []
    except TooManyLevels:
        wide = wide_columns(df, columns, max_levels)
        return fit_levels(df, [c for c in columns if c not in wide], max_levels), wide


def level_table(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(level, code) of all levels of a column, codes from 0 in level order, and their number.

    The table stays distributed, in the checkpoint folder.
    """
    levels = df.select(_c(column).cast("string").alias("level")).filter(F.col("level").isNotNull()).distinct()
    coded = cut_lineage(ranked(levels, [], ["level"], "code").withColumn("code", F.col("code") - 1))
    return coded, coded.count()


def fit_levels(df: DataFrame, columns: list[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per column; columns with more than ``max_levels`` are for ``level_table``.

    The distinct count is checked with one row more than the bound, so a runaway
    column is never collected.
    """
    if not columns:
        return {}
    pairs = df.select(*[_c(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "level")
    rows = pairs.filter(F.col("level").isNotNull()).distinct().limit(max_levels * len(columns) + 1).collect()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        levels[r["column"]].append(r["level"])
    wide = [c for c in columns if len(levels[c]) > max_levels]
    if wide or len(rows) > max_levels * len(columns):
        raise TooManyLevels(f"more than {max_levels} levels in {wide or columns}")
    return {c: sorted(v, key=lambda s: s.encode()) for c, v in levels.items()}


def fit_one_hot(df: DataFrame, columns: list[str], drop_first: bool = True, max_levels: int = MAX_LEVELS) -> Step:
    """Indicator columns ``<column>_<level>``; levels ascending, the first dropped.

    A column with more than ``max_levels`` levels becomes one sparse vector ``<column>_levels``
    with a place for each level instead of a column for each.
    """
    levels, wide = levels_and_wide(df, columns, max_levels)
    params: dict[str, Any] = {c: v[1:] if drop_first else v for c, v in levels.items()}
    for c in wide:
        params[c] = (*level_table(df, c), drop_first)
    return Step("one_hot", {c: params[c] for c in columns})


def fit_labels(df: DataFrame, columns: list[str], max_levels: int = MAX_LEVELS) -> Step:
    """Level to its place among the sorted levels, from 0; wide columns look it up by a join."""
    levels, wide = levels_and_wide(df, columns, max_levels)
    params: dict[str, Any] = {c: {v: i for i, v in enumerate(vs)} for c, vs in levels.items()}
    for c in wide:
        params[c] = level_table(df, c)
    return Step("map", {c: params[c] for c in columns})


def value_map(column: str, mapping: dict[Any, Any]) -> Step:
    """Explicit recode; values not listed become null."""
    return Step("map", {column: mapping})


def fit_quantile_bins(df: DataFrame, columns: list[str], bins: int) -> Step:
    """Inner bin edges at the exact quantiles."""
    probs = [i / bins for i in range(1, bins)]
    edges: dict[str, list[float]] = {c: [] for c in columns}
    for r in exact_quantiles(df, columns, probs).collect():
        if r["value"] is not None:
            edges[r["column"]].append(r["value"])
    return Step("bin", {c: sorted(set(v)) for c, v in edges.items()})


def equal_bins(column: str, edges: list[float]) -> Step:
    """Bins at given inner edges."""
    return Step("bin", {column: sorted(edges)})


# --- transforms -------------------------------------------------------------------------


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else _c(c) for c in df.columns])


def _fill(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    types = dict(df.dtypes)
    changed = {}
    for c, v in params.items():
        if c in types and v is not None:
            # a fractional fill value turns a whole-number column into double
            whole = types[c] in ("tinyint", "smallint", "int", "bigint")
            base = _c(c).cast("double") if whole and isinstance(v, float) else _c(c)
            changed[c] = F.coalesce(base, F.lit(v))
    return _replace(df, changed)


def _scale(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    return _replace(df, {
        c: (_c(c).cast("double") - F.lit(m)) / F.lit(float(s)) for c, (m, s) in params.items() if m is not None
    })


def _coded(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Adds ``__code``, null for unknown levels."""
    table = levels.select(F.col("level").alias("__level"), F.col("code").alias("__code"))
    return df.join(table, _c(column).cast("string") == F.col("__level"), "left").drop("__level")


def _sparse(df: DataFrame, column: str, levels: DataFrame, size: int, drop_first: bool) -> DataFrame:
    """``<column>_levels``: a sparse vector with a 1 at the level's place; all 0 for the first level and unknown ones."""
    places = size - drop_first
    encoder = OneHotEncoder(inputCols=["__code"], outputCols=[f"{column}_levels"], handleInvalid="keep")
    model = encoder.fit(df.sparkSession.createDataFrame([(float(max(places, 1) - 1),)], "__code double"))
    place = F.col("__code") - int(drop_first)
    outside = F.lit(float(places))  # one past the last place: encoded as all 0
    coded = _coded(df, column, levels).withColumn("__code", F.when(place >= 0, place.cast("double")).otherwise(outside))
    return model.transform(coded).drop("__code", column)


def _one_hot(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    for c in [c for c in params if isinstance(params[c], tuple)]:
        df = _sparse(df, c, *params[c])
    params = {c: v for c, v in params.items() if not isinstance(v, tuple)}
    out = []
    for c in df.columns:
        if c not in params:
            out.append(_c(c))
            continue
        out += [F.coalesce((_c(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in params[c]]
    return df.select(*out)


def _map(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    columns = df.columns
    for c in [c for c in params if isinstance(params[c], tuple)]:
        df = _coded(df, c, params[c][0]).withColumn(c, F.col("__code").cast("int")).drop("__code").select(*[_c(x) for x in columns])
    params = {c: v for c, v in params.items() if not isinstance(v, tuple)}
    changed = {}
    for c, mapping in params.items():
        if mapping:
            table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
            changed[c] = F.try_element_at(table, _c(c))
        else:
            changed[c] = F.lit(None)
    return _replace(df, changed)


def _bin(df: DataFrame, params: dict[str, list[float]]) -> DataFrame:
    for c, edges in params.items():
        if not edges:
            df = df.withColumn(f"{c}_bin", F.when(_c(c).isNotNull(), F.lit(0)))
            continue
        b = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="__v", outputCol="__b", handleInvalid="keep")
        df = b.transform(df.withColumn("__v", _c(c).cast("double")))
        df = df.withColumn(f"{c}_bin", F.when(F.col("__v").isNotNull(), F.col("__b").cast("int"))).drop("__v", "__b")
    return df


_APPLY: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "fill": _fill, "scale": _scale, "one_hot": _one_hot, "map": _map, "bin": _bin,
}


def transform(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = _APPLY[step.kind](df, step.params)
    return df


def params_table(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """Fitted parameters as rows: (place, kind, column, params)."""
    rows = [(i, s.kind, c, repr(p)) for i, s in enumerate(steps) for c, p in s.params.items()]
    return spark.createDataFrame(rows, "place int, kind string, column string, params string")


# --- stateless features -----------------------------------------------------------------


def polynomial(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """All products of up to ``degree`` columns, as ``a``, ``a*b``, ``a*a``..."""
    terms: list[tuple[str, ...]] = [(c,) for c in columns]
    layer = list(terms)
    for _ in range(degree - 1):
        layer = [t + (c,) for t in layer for c in columns[columns.index(t[-1]):]]
        terms += layer
    out = df
    for t in terms[len(columns):]:
        product = _c(t[0])
        for c in t[1:]:
            product = product * _c(c)
        out = out.withColumn("*".join(t), product)
    return out


def interaction(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{a}_x_{b}", _c(a) * _c(b))


def extract_title(df: DataFrame, column: str, pattern: str = r",\s*([^.]+)\.", out: str = "title") -> DataFrame:
    """First group of ``pattern``; no match gives null."""
    hit = F.regexp_extract(_c(column), pattern, 1)
    return df.withColumn(out, F.nullif(hit, F.lit("")))


def sum_columns(df: DataFrame, columns: list[str], plus: float = 1, out: str = "family_size") -> DataFrame:
    """Sum of columns plus a constant, such as family size from relatives aboard."""
    total = F.lit(plus)
    for c in columns:
        total = total + _c(c)
    return df.withColumn(out, total)


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """log(1 + x), as ``<column>_log``."""
    return df.select("*", *[F.log1p(_c(c)).alias(f"{c}_log") for c in columns])


def label_encode_large(df: DataFrame, column: str, out: str) -> DataFrame:
    """Label encoding without a level bound: levels are ranked and joined, never collected."""
    levels = ranked(df.select(column).filter(_c(column).isNotNull()).distinct(), [], [column], out)
    return join_on(df, levels.withColumn(out, (F.col(out) - 1).cast("int")), [column], "left")


# --- whole preparation ------------------------------------------------------------------


def fit_preprocess(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    numeric_fill: str = "median",
    categorical_fill: str = "constant",
    encode: str = "one_hot",
    scale: bool = True,
    max_levels: int = MAX_LEVELS,
) -> list[Step]:
    """Fill, scale and encode parameters, fitted on ``df`` only.

    One aggregation per kind of parameter (fill values, moments, levels), each over all
    columns at once; nothing but these parameters reaches the driver.
    """
    steps: list[Step] = []
    if numeric:
        fill = fit_median(df, numeric) if numeric_fill == "median" else fit_mean(df, numeric)
        steps.append(fill)
        if scale:
            steps.append(fit_standard(_fill(df.select(*[_c(c) for c in numeric]), fill.params), numeric))
    if categorical:
        fill = fit_mode(df, categorical) if categorical_fill == "mode" else constant_fill(categorical)
        steps.append(fill)
        filled = _fill(df.select(*[_c(c) for c in categorical]), fill.params)
        steps.append(
            fit_one_hot(filled, categorical, True, max_levels) if encode == "one_hot" else fit_labels(filled, categorical, max_levels)
        )
    return steps
