import random

import pytest
from pyspark.sql import functions as F

from pipelab.operators import errors as er
from pipelab.operators import metrics as me


def values(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(f"g{i % 3}", i, rng.randint(0, 1), rng.choice([rng.random(), 0.5, 1 - 1e-12, 1e-9])) for i in range(600)]
    return spark.createDataFrame(rows, "g string, id int, y_true int, score double").cache()


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.4])), "y_true int, score double")
    assert values(me.roc_auc(df))["roc_auc"] == 0.75


def test_auc_by_group_and_mirrored(scored):
    rows = scored.collect()
    got = {r["g"]: r["roc_auc"] for r in me.roc_auc(scored, ["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        assert got[g] == pytest.approx(brute_auc([(r["y_true"], r["score"]) for r in rows if r["g"] == g]))
    mirrored = me.roc_auc(scored.withColumn("score", 1 - F.col("score")), ["g"])
    # 1 - s merges none of these scores except the two ends, which stay apart
    for r in mirrored.collect():
        assert r["roc_auc"] == pytest.approx(1 - got[r["g"]], abs=1e-3)
    whole = values(me.roc_auc(scored.repartition(3)))["roc_auc"]
    assert whole == pytest.approx(values(me.roc_auc(scored))["roc_auc"])


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y_true int, score double")
    assert values(me.roc_auc(df))["roc_auc"] is None


def test_multiclass_auc_against_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [round(rng.random(), 1) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, y_true int, proba array<double>")
    long = me.explode_proba(df, "proba", [0, 1, 2], ["id", "y_true"])
    n = len(rows)
    share = {c: sum(y == c for _, y, _ in rows) for c in range(3)}
    ovr = sum(share[c] / n * brute_auc([(int(y == c), p[c]) for _, y, p in rows]) for c in range(3))
    assert values(me.roc_auc_ovr(long))["roc_auc_ovr"] == pytest.approx(ovr)
    total = weight = 0
    for a in range(3):
        for b in range(a + 1, 3):
            sub = [(y, p) for _, y, p in rows if y in (a, b)]
            both = (brute_auc([(int(y == a), p[a]) for y, p in sub]) + brute_auc([(int(y == b), p[b]) for y, p in sub])) / 2
            total, weight = total + both * len(sub), weight + len(sub)
    assert values(me.roc_auc_ovo(long))["roc_auc_ovo"] == pytest.approx(total / weight)


def test_zero_denominator_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y_true int, y_pred int")
    got = values(me.binary_scores(df))
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_weighted_scores_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0), (2, 2)], "y_true int, y_pred int")
    got = values(me.weighted_scores(df))
    assert got["precision"] == pytest.approx((2 * 0.5 + 1 * 0.5 + 3 * 1.0) / 6)
    assert got["recall"] == pytest.approx(4 / 6)
    assert got["f1"] == pytest.approx((2 * 0.5 + 1 * (2 / 3) + 3 * 0.8) / 6)


def test_regression_and_cv_summary(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "y_true double, y_pred double")
    got = values(me.regression_scores(df))
    assert got["mse"] == pytest.approx(10 / 3) and got["r2"] == pytest.approx(1 - 10 / 8)
    folds = spark.createDataFrame([(1, "a", 2.0), (0, "a", 4.0)], "fold int, metric string, score double")
    got = values(me.cv_summary(folds))
    assert (got["mean"], got["std"], got["scores"]) == (3.0, 1.0, [4.0, 2.0])


def test_report_rejects_unknown_type(scored):
    with pytest.raises(ValueError):
        me.metrics_report(scored, "ranking")


def test_primary_score_of_missing_metric(spark):
    df = spark.createDataFrame([({"a": 0.5},)], "m map<string,double>")
    assert values(df.select(me.primary_score(F.col("m"), "a").alias("a"), me.primary_score(F.col("m"), "b").alias("b"))) == {"a": 0.5, "b": 0.0}


def test_error_correlation_of_constant_and_null(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0, 5.0), (1, 0, 3.0, 5.0), (0, 0, None, 5.0), (0, 1, 4.0, 5.0)], "y_true int, y_pred int, x double, c double"
    )
    got = {r["feature"]: r["correlation"] for r in er.feature_error_correlation(df, ["x", "c"]).collect()}
    assert got["c"] is None
    assert got["x"] == pytest.approx(0.944911, abs=1e-6)


def test_level_rates_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 0, "a"), (0, 1, None)], "y_true int, y_pred int, k string")
    assert [tuple(r) for r in er.categorical_error_rates(df, ["k"]).collect()] == [("k", "a", 0.5, 2)]
