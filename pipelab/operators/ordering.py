"""Exact ranks, prefix aggregates and quantiles that stay distributed.

A window over one hot group runs in one task. Where a group is large the rows are
range-partitioned by group and order instead, so that every range holds a bounded number of
rows whatever the keys look like; the few range totals are prefixed, and the row-level window
runs inside one range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelab.functions.numeric import SMALL_ROWS, join_on, numeric_sort_key
from pipelab.session import cut_lineage

HOT_ROWS = 1_000_000
MAX_BUCKETS = 4096

_PART = "__part"


def with_bucket(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    """Range number of ``column`` among fixed split points; order preserving."""
    edges = [float("-inf"), *splits, float("inf")]
    if len(edges) < 3:
        return df.withColumn(out, F.lit(0.0))
    keyed = df.withColumn("__sort_key", numeric_sort_key(df, column))
    return (
        Bucketizer(splits=edges, inputCol="__sort_key", outputCol=out, handleInvalid="keep")
        .transform(keyed)
        .drop("__sort_key")
    )


def range_splits(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Split points that cut the rows of ``column`` into ranges of similar size."""
    buckets = min(buckets, MAX_BUCKETS)
    if buckets < 2:
        return []
    keys = df.select(numeric_sort_key(df, column).alias("k")).filter(~F.col("k").isin(float("-inf"), float("inf")))
    probs = [i / buckets for i in range(1, buckets)]
    points = keys.approxQuantile("k", probs, 1.0 / (4 * buckets))
    return sorted(set(points))


def _aggregate(kind: str, column: Column) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    return {"sum": F.sum, "max": F.max}[kind](column)


def into_ranges(df: DataFrame, groups: list[str], order: list[str], total: int, most: int) -> DataFrame:
    """Rows in ranges of (groups, order), numbered in ``__part``, none above ``most`` rows.

    All order columns count, at their full width. Cut points come from a sample; while a range
    is still too large the rows are cut finer. The result is checkpointed, so that the number
    of a row's range is fixed.
    """
    keys = [F.col(f"`{c}`") for c in (*groups, *order)]
    parts = -(-2 * total // most)
    while True:
        placed = cut_lineage(df.repartitionByRange(parts, *keys).withColumn(_PART, F.spark_partition_id()))
        largest = placed.groupBy(_PART).count().agg(F.max("count")).first()[0]
        if largest <= most or parts >= total:
            return placed
        parts = min(total, 2 * parts)


def preceding(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column | None]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Aggregates over the rows of the same group that come earlier in ``order``.

    ``aggs`` maps an output name to ``(kind, column)``, kind one of count, sum, max.
    Sums and counts start at 0, a maximum starts at null. ``order`` must be total.
    """
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total or largest <= hot_rows:
        w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = df
        for name, (kind, column) in aggs.items():
            value = _aggregate(kind, column).over(w)
            out = out.withColumn(name, value if kind == "max" else F.coalesce(value, F.lit(0)))
        return out

    placed = into_ranges(df, groups, order, total, hot_rows)
    totals = placed.groupBy(*groups, _PART).agg(
        *[_aggregate(kind, column).alias(f"__t_{name}") for name, (kind, column) in aggs.items()]
    )
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # Only groups that lie in several ranges need a start; these are two rows a range at most.
    starts = totals.withColumn("__parts", F.count(F.lit(1)).over(whole)).select(
        *groups, _PART, "__parts",
        *[
            (F.max if kind == "max" else F.sum)(f"__t_{name}").over(earlier).alias(f"__s_{name}")
            for name, (kind, _) in aggs.items()
        ],
    ).filter("__parts > 1").drop("__parts")
    if starts.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        starts = F.broadcast(starts)
    joined = join_on(placed, starts, [*groups, _PART], "left", null_safe=True)
    inside = Window.partitionBy(*groups, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for name, (kind, column) in aggs.items():
        local, start = _aggregate(kind, column).over(inside), F.col(f"__s_{name}")
        if kind == "max":
            out = out.withColumn(name, F.greatest(local, start))
        else:
            out = out.withColumn(name, F.coalesce(local, F.lit(0)) + F.coalesce(start, F.lit(0)))
    return out.drop(_PART, *[f"__s_{name}" for name in aggs])


def ranked(df: DataFrame, groups: list[str], order: list[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based position of every row in its group."""
    counted = preceding(df, groups, order, {out: ("count", None)}, hot_rows=hot_rows)
    return counted.withColumn(out, F.col(out) + 1)


#: Rank error of the sketch that brackets an order statistic is 1 / SKETCH of the rows.
SKETCH = 10_000
#: Distinct values inside brackets that are fetched at most.
FETCHED = 200_000


def _inside(v: Column, low: float, high: float) -> Column:
    """An open end holds whatever lies there, NaN (above all numbers) included."""
    held = v.isNotNull() if low == float("-inf") else v >= low
    return held if high == float("inf") else held & (v <= high)


def _bracket(low: float | None, high: float | None) -> tuple[float, float]:
    return float("inf") if low is None or low != low else low, float("inf") if high is None or high != high else high


def _shares(shares: list[float]) -> Column:
    """A constant array that is one small expression, however many shares there are."""
    return F.split(F.lit(",".join(map(repr, shares))), ",").cast("array<double>")


def _segmented(values: DataFrame, brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(column, segment, value) of every value: between brackets segments are even, inside brackets odd."""
    rows = values.select(*[f"`{c}`" for c in brackets]).unpivot([], list(brackets), "column", "value").filter(F.col("value").isNotNull())
    place, v = F.lit(0), F.col("value")
    for c, pairs in brackets.items():
        own = F.lit(2 * len(pairs))
        for k, (low, high) in reversed(list(enumerate(pairs))):
            own = F.when(v < low, 2 * k).when(_inside(v, low, high), 2 * k + 1).otherwise(own)
        place = F.when(F.col("column") == c, own).otherwise(place)
    return rows.withColumn("segment", place)


def _counted(values: DataFrame, brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(column, segment, value, n): rows between brackets (no value), and every value inside one."""
    inside = F.when(F.col("segment") % 2 == 1, F.col("value")).alias("value")
    return _segmented(values, brackets).groupBy("column", "segment", inside).agg(F.count(F.lit(1)).alias("n"))


def _sketched(
    values: DataFrame, brackets: dict[str, list[tuple[float, float]]], wanted: dict[str, list[int]], accuracy: int, steps: int
) -> dict[str, list[tuple[float, float]]]:
    """Tighter brackets, by one pass: rows between brackets are counted and those inside are sketched.

    ``wanted`` holds ranks from 0. A rank that does not lie in its bracket keeps a bracket on the side it lies on.
    """
    inside = F.when(F.col("segment") % 2 == 1, F.col("value"))
    sketch = F.percentile_approx(inside, _shares([i / steps for i in range(steps + 1)]), accuracy)
    found = _segmented(values, brackets).groupBy("column", "segment").agg(F.count(F.lit(1)).alias("n"), sketch.alias("at")).collect()
    out: dict[str, list[tuple[float, float]]] = {}
    for c, ranks in wanted.items():
        pairs, tighter, upto = brackets[c], [], 0
        todo = list(ranks)
        for segment, n, at in sorted((r["segment"], r["n"], r["at"]) for r in found if r["column"] == c):
            k = segment // 2
            while todo and todo[0] < upto + n:
                rank = todo.pop(0)
                if segment % 2:
                    place, slack = (rank - upto) / n, 2 / accuracy + 1 / steps
                    first, last = int((place - slack) * steps), int((place + slack) * steps) + 1
                    tighter.append(_bracket(at[first] if first > 0 else pairs[k][0], at[last] if last <= steps else pairs[k][1]))
                else:
                    tighter.append((pairs[k - 1][1] if k else float("-inf"), pairs[k][0] if k < len(pairs) else float("inf")))
            upto += n
        out[c] = _merged(tighter)
    return out


def _merged(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint brackets in order."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(set(pairs)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def order_statistics(
    df: DataFrame, columns: dict[str, list[float]], accuracy: int = SKETCH, fetched: int = FETCHED
) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Exact values at ranks (from 0, nulls left out) of double columns, without shuffling the values.

    ``columns`` gives the wanted shares of the rows per column; the result holds, per column, the number of rows, and the values at
    the two ranks around each share. A sketch brackets every rank; one narrow pass counts what lies between the brackets
    and counts each value inside, map-side. Brackets that hold more distinct values than ``fetched`` are
    sketched again from inside; a rank that was missed is looked for in the gap it lies in.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    first = values.agg(*[
        F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.percentile_approx(F.col(f"`{c}`"), _shares([
            min(1.0, max(0.0, p + d)) for p in probs for d in (-2 / accuracy, 2 / accuracy)
        ]), accuracy).alias("at")).alias(c) for c, probs in columns.items()
    ]).first() if columns else {}
    wanted, brackets = {}, {}
    for c, probs in columns.items():
        n, at = first[c]["n"], first[c]["at"]
        if not n:
            continue
        ranks = [p * (n - 1) for p in probs]
        wanted[c] = sorted({int(r) for r in ranks} | {min(n - 1, -int(-r // 1)) for r in ranks})
        # the ends of the order have no value beyond them
        ends = [_bracket(float("-inf") if p <= 2 / accuracy else at[2 * k], float("inf") if p >= 1 - 2 / accuracy else at[2 * k + 1]) for k, p in enumerate(probs)]
        brackets[c] = _merged(ends)
    out: dict[str, dict[int, float]] = {c: {} for c in wanted}
    steps = 200
    while wanted:
        most = fetched + 4 * sum(map(len, wanted.values()))
        rows = _counted(values, brackets).limit(most + 1).collect()
        if len(rows) > most:
            before = brackets
            brackets = _sketched(values, brackets, wanted, accuracy, steps)
            if brackets == before:  # the ranks lie close together: a finer sketch tells them apart
                accuracy, steps = 4 * accuracy, 4 * steps
            continue
        missed: dict[str, list[tuple[float, float]]] = {}
        left: dict[str, list[int]] = {}
        for c, ranks in wanted.items():
            own = [(r["segment"], r["value"], r["n"]) for r in rows if r["column"] == c]
            own.sort(key=lambda r: (r[0], r[1] != r[1], r[1] if r[1] is not None else 0.0))
            upto = 0
            todo = list(ranks)
            for segment, value, n in own:
                while todo and todo[0] < upto + n:
                    rank = todo.pop(0)
                    if segment % 2:
                        out[c][rank] = value
                    else:
                        k, pairs = segment // 2, brackets[c]
                        missed.setdefault(c, []).append((pairs[k - 1][1] if k else float("-inf"), pairs[k][0] if k < len(pairs) else float("inf")))
                        left.setdefault(c, []).append(rank)
                upto += n
        wanted, brackets = left, {c: _merged(p) for c, p in missed.items()}
    return {c: first[c]["n"] for c in columns}, out


def _between(low: float, high: float, share: float) -> float:
    return low if low == high else low * (1 - share) + high * share


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    groups: list[str] | None = None,
    distinct_limit: int = 1_000_000,
    fetched: int = FETCHED,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (groups..., column, prob, value).

    Without groups the order statistics are bracketed and counted (``order_statistics``), so no value is
    shuffled but those near one. With groups equal values are counted first, map-side.
    ``percentile`` holds the distinct values of a group in one buffer; it is used when a
    distinct count shows that this is small. Beyond that the two order statistics are
    found by a prefix count over value ranges.
    """
    groups = list(groups or [])
    if not groups:
        counts, found = order_statistics(df, {c: list(probs) for c in columns}, fetched=fetched)
        rows = []
        for c in columns:
            for p in probs if counts[c] else ():
                place = p * (counts[c] - 1)
                low = int(place)
                rows.append((c, float(p), _between(found[c][low], found[c][min(counts[c] - 1, -int(-place // 1))], place - low)))
        return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
    return _grouped_quantiles(df, columns, probs, groups, distinct_limit)


def _grouped_quantiles(df: DataFrame, columns: list[str], probs: list[float], groups: list[str], distinct_limit: int) -> DataFrame:
    values = df.select(*groups, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    widest = (
        values.groupBy(*groups)
        .agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns])
        .agg(F.max(F.greatest(*[F.col(f"`{c}`") for c in columns], F.lit(0))))
        .first()[0]
    )
    long = values.unpivot(groups, columns, "column", "value").filter(F.col("value").isNotNull())
    keys = [*groups, "column"]
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    if (widest or 0) <= distinct_limit:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        found = counts.groupBy(*keys).agg(F.percentile("value", wanted, F.col("n")).alias("v"))
        return found.select(*keys, F.posexplode("v").alias("i", "value")).select(
            *keys, F.element_at(wanted, F.col("i") + 1).alias("prob"), "value"
        )

    placed = preceding(counts, keys, ["value"], {"below": ("sum", F.col("n"))})
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    sized = join_on(placed, sizes, keys, null_safe=True)
    finds = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            finds.append(F.max(F.when(hit, F.col("value"))).alias(f"__{tag}{i}"))
    ends = sized.groupBy(*keys).agg(F.max("total").alias("total"), *finds)
    cells = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        value = F.when(lo == hi, lo).otherwise(lo * (1 - frac) + hi * frac)
        cells.append(F.struct(F.lit(float(p)).alias("prob"), value.alias("value")))
    return ends.select(*keys, F.explode(F.array(*cells)).alias("q")).select(*keys, "q.prob", "q.value")
