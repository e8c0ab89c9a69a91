import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pipelab.operators.ordering import _counted, exact_quantiles, order_statistics, into_ranges, preceding, range_splits, ranked


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [
        ("hot" if rng.random() < 0.7 else rng.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**9)),
         i, rng.choice([None, rng.random()]), f"w{rng.randrange(500):03d}")
        for i in range(2000)
    ]
    return spark.createDataFrame(data, "g string, ts timestamp, id bigint, x double, word string").repartition(7).cache()


@pytest.mark.parametrize("lead", ["ts", "id", "word"])
def test_ranked_equals_plain_window_when_groups_are_cut(rows, lead):
    w = Window.partitionBy("g").orderBy(lead, "id")
    got = ranked(rows, ["g"], [lead, "id"], "rank", hot_rows=50).withColumn("plain", F.row_number().over(w))
    assert got.filter("rank <> plain").count() == 0
    assert got.count() == 2000


def test_ranked_without_groups(rows):
    got = [r["rank"] for r in ranked(rows, [], ["id"], "rank", hot_rows=50).orderBy("id").collect()]
    assert got == list(range(1, 2001))


def test_prefix_max_and_sum(rows):
    aggs = {"m": ("max", F.col("x")), "s": ("sum", F.col("x"))}
    cut = preceding(rows, ["g"], ["ts", "id"], aggs, hot_rows=40)
    plain = preceding(rows, ["g"], ["ts", "id"], aggs)
    both = cut.join(plain.select("id", F.col("m").alias("pm"), F.col("s").alias("ps")), "id")
    assert both.filter(~F.col("m").eqNullSafe(F.col("pm")) | (F.abs(F.col("s") - F.col("ps")) > 1e-9)).count() == 0


def test_null_group(spark):
    df = spark.createDataFrame([(None, 0.1), (None, 0.9), ("a", 0.5), ("a", None)], "g string, x double")
    for bound in (1, 100):
        got = preceding(df, ["g"], ["x"], {"n": ("count", None)}, hot_rows=bound)
        assert {(r["g"], r["x"]): r["n"] for r in got.collect()} == {(None, 0.1): 0, (None, 0.9): 1, ("a", None): 0, ("a", 0.5): 1}


def hard_cases(spark):
    ids = spark.range(20_000).withColumn("g", F.lit("one"))
    yield "tied first column", ids.withColumn("lead", F.lit(7)), ["lead", "id"], 500
    yield "common text prefix", ids.withColumn("lead", F.concat(F.lit("https://example.org/"), F.lpad("id", 9, "0"))), ["lead"], 500
    yield "scores close together", ids.withColumn("lead", F.lit(0.5) + F.col("id") / 2e6), ["lead"], 500
    yield "many hot groups", ids.withColumn("g", (F.col("id") % 2_000).cast("string")).withColumn("lead", F.col("id")), ["lead"], 8


def test_ranges_stay_below_the_bound(spark):
    for name, df, order, most in hard_cases(spark):
        placed = into_ranges(df, ["g"], order, 20_000, most)
        assert placed.groupBy("__part").count().agg(F.max("count")).first()[0] <= most, name
        w = Window.partitionBy("g").orderBy(*order)
        got = ranked(df, ["g"], order, "rank", hot_rows=most).withColumn("plain", F.row_number().over(w))
        assert got.filter("rank <> plain").count() == 0 and got.count() == 20_000, name


def test_range_splits_are_ordered(rows):
    splits = range_splits(rows, "id", 8)
    assert splits == sorted(set(splits)) and 3 <= len(splits) <= 7


@pytest.mark.parametrize("limit", [0, 10**6])
def test_exact_quantiles(spark, limit):
    rng = random.Random(2)
    xs = [rng.choice([rng.gauss(0, 100), 5.0]) for _ in range(999)]
    df = spark.createDataFrame([("k" if i % 3 else "l", x, x * x) for i, x in enumerate(xs)], "g string, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x", "y"], probs, distinct_limit=limit).collect()}
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(xs, p))
        assert got["y", p] == pytest.approx(np.quantile([x * x for x in xs], p))
    grouped = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x"], [0.5], ["g"], distinct_limit=limit).collect()}
    assert grouped["l", 0.5] == pytest.approx(np.median(xs[::3]))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_even_median_with_null(spark, limit):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5], distinct_limit=limit).first()["value"] == 2.5


@pytest.mark.parametrize("accuracy,fetched", [(10_000, 200_000), (40, 300)])
def test_order_statistics_of_odd_columns(spark, accuracy, fetched):
    """Ties, infinities, NaN (above all numbers), nulls, extremes; loose sketches make brackets that are cut again, or missed."""
    rng = random.Random(accuracy)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "tied": [rng.choice([7.0, rng.random() * 10]) for _ in range(3000)],
        "skewed": [rng.random() ** 40 for _ in range(3000)],
        "odd": [rng.choice([float("inf"), float("-inf"), float("nan"), rng.random()]) for _ in range(3000)],
        "holes": [rng.choice([None, rng.random()]) for _ in range(3000)],
        "one": [3.0] * 3000,
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    counts, found = order_statistics(df, {c: probs for c in columns}, accuracy, fetched)
    for c, xs in columns.items():
        known = sorted((x for x in xs if x is not None), key=lambda x: (x != x, x))
        assert counts[c] == len(known)
        for p in probs if known else ():
            place = p * (len(known) - 1)
            for rank in {int(place), -int(-place // 1)}:
                assert repr(found[c][rank]) == repr(known[rank]), (c, p)


def test_values_away_from_the_ranks_are_not_shuffled(spark):
    df = spark.range(0, 200_000, 1, 8).selectExpr("cast(pmod(id * 7919, 200003) as double) AS x")
    rows = _counted(df, {"x": [(99_900.0, 100_100.0)]}).collect()
    assert len(rows) <= 203 and sum(r["n"] for r in rows) == 200_000
    assert order_statistics(df, {"x": [0.5]})[1]["x"]
