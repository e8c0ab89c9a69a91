import math

import pytest
from pyspark.sql import functions as F

from pipelab.operators import splits as sp


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 10 == 0, 2).when(F.col("id") % 3 == 0, 1).otherwise(0))
    return df.cache()


def test_split_holds_out_a_share_of_every_class(rows):
    got = sp.stratified_split(rows, "y", ["id"], 0.2)
    assert got.count() == rows.count()
    assert got.filter("is_validation").count() == math.ceil(0.2 * 1003)
    for r in got.groupBy("y").agg(F.avg(F.col("is_validation").cast("int")).alias("share"), F.count("*").alias("n")).collect():
        assert abs(r["share"] - 0.2) <= 1 / r["n"] + 1e-9


def test_split_does_not_depend_on_partitions_but_on_seed(rows):
    one = sp.stratified_split(rows.repartition(1), "y", ["id"])
    many = sp.stratified_split(rows.repartition(13), "y", ["id"])
    assert one.exceptAll(many).count() == 0
    assert one.exceptAll(sp.stratified_split(rows, "y", ["id"], seed=7)).count() > 0


def test_random_split(rows):
    assert sp.random_split(rows, ["id"], 0.25).filter("is_validation").count() == math.ceil(0.25 * 1003)


def test_null_class_is_a_class(spark):
    df = spark.range(10).withColumn("y", F.when(F.col("id") < 5, 1))
    assert sp.stratified_split(df, "y", ["id"], 0.4).filter("is_validation").groupBy("y").count().count() == 2


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_are_even_in_every_class(rows, k):
    got = sp.stratified_kfold(rows, "y", ["id"], k)
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == k and sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    for r in got.groupBy("y", "fold").count().groupBy("y").agg(F.max("count").alias("hi"), F.min("count").alias("lo"), F.count("*").alias("k")).collect():
        assert r["hi"] - r["lo"] <= 1 and r["k"] == k


def test_class_smaller_than_the_folds(spark):
    df = spark.createDataFrame([(i, "rare" if i < 2 else "usual") for i in range(20)], "id int, y string")
    got = sp.stratified_kfold(df, "y", ["id"], 5)
    assert got.count() == 20
    assert got.filter("y = 'rare'").select("fold").distinct().count() == 2
    assert {r["count"] for r in got.groupBy("fold").count().collect()} == {4}


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_kfold_is_contiguous(rows, hot_rows):
    got = sp.kfold(rows.repartition(5), ["id"], 4, hot_rows=hot_rows)
    spans = got.groupBy("fold").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("fold").collect()
    assert [(r["fold"], r["a"], r["b"], r["n"]) for r in spans] == [(0, 0, 250, 251), (1, 251, 501, 251), (2, 502, 752, 251), (3, 753, 1002, 250)]


def test_kfold_with_fewer_rows_than_folds(spark):
    got = sp.kfold(spark.range(2), ["id"], 4).orderBy("id").collect()
    assert [r["fold"] for r in got] == [0, 1]


def test_quota_of_very_large_classes(spark):
    sizes = spark.createDataFrame([("a", 6 * 10**11 + 1), ("b", 4 * 10**11)], "y string, n bigint")
    got = {r["y"]: r["cut_rank"] for r in sp.holdout_quota(sizes, "y", 0.2).collect()}
    assert got == {"a": 120_000_000_000 + 1, "b": 80_000_000_000}


@pytest.mark.parametrize("most", [1, 20])
def test_ranges_are_counted_finer_until_few_rows_are_ranked(spark, monkeypatch, most):
    """With ranges of one hex digit, those that hold a cut are far above the bound at first."""
    df = spark.range(4000).withColumn("y", F.when(F.col("id") % 4 == 0, "b").when(F.col("id") % 7 == 0, None).otherwise("a"))
    want = [sp.stratified_split(df, "y", ["id"]), sp.random_split(df, ["id"]), sp.stratified_kfold(df, "y", ["id"], 5)]
    want = [sorted(map(str, d.collect())) for d in want]
    monkeypatch.setattr(sp, "_HASH_DIGITS", 1)
    ranked = []
    rows_of = sp._cut_rows

    def seen(df, strata, bucket, order, borders):
        ranked.append(borders.filter("__within > 0").agg(F.max("__n")).first()[0])
        return rows_of(df, strata, bucket, order, borders)

    monkeypatch.setattr(sp, "_cut_rows", seen)
    got = [sp.stratified_split(df, "y", ["id"], most=most), sp.random_split(df, ["id"], most=most), sp.stratified_kfold(df, "y", ["id"], 5, most=most)]
    assert [sorted(map(str, d.collect())) for d in got] == want and max(ranked) <= most


def test_folds_by_whole_keys(spark, monkeypatch):
    """A first column of one value, and a text whose first 40 bytes are the same everywhere."""
    rows = [(7, "x" * 40 + f"{(k * 7919) % 3001:05d}", None if k % 11 == 0 else k % 5) for k in range(3001)]
    df = spark.createDataFrame(rows, "tied int, name string, n int").repartition(6)
    place = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1])))}
    for sampled in (400, 60):
        monkeypatch.setattr(sp.key_rows, "__defaults__", (sampled,))
        got = sp.kfold(df, ["tied", "name", "n"], 7, hot_rows=300).collect()
        assert all(r["fold"] == next(f for f in range(7) if place[tuple(r)[:3]] < (f + 1) * 428 + min(f + 1, 5)) for r in got)


def test_rows_of_one_key_end_a_fold_together(spark):
    """Equal order keys cannot be cut: the search ends though none of its ranges gets small."""
    df = spark.createDataFrame([(1,)] * 500 + [(2,)] * 500, "n int")
    got = sp.kfold(df, ["n"], 4, hot_rows=50)
    assert got.groupBy("n").agg(F.countDistinct("fold").alias("folds")).filter("folds > 1").count() == 0


def test_only_few_rows_are_ranked(spark):
    df = spark.range(20_000)
    rows = sp.key_rows(df, ["id"], [0, 5_000, 5_000, 12_345], 20_000, most=1_500, sampled=2_000)
    assert [(r["at"]["id"], r["times"]) for r in rows] == [(4_999, 2), (12_344, 1)]
