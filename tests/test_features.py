import pytest
from pyspark.sql import functions as F

from pipelab.operators import columns as co
from pipelab.operators import features as fe


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 1.0, "b", "Braund, Mr. Owen", 5.0), (2, 2.0, "a", "Smith", 5.0), (3, 2.0, None, "Heikkinen, Miss. Laina", 5.0),
            (4, 7.0, "b", None, 5.0), (5, 7.0, "a", "Lee, the Countess. Ann", 5.0), (6, None, "c.d", "x", 5.0)]
    return spark.createDataFrame(rows, "id int, x double, k string, name string, const double")


def col(df, name):
    return [r[0] for r in df.orderBy("id").select(f"`{name}`").collect()]


def test_fills(df):
    assert fe.fit_median(df, ["x"]).params == {"x": 2.0}
    assert fe.fit_mean(df, ["x"]).params["x"] == pytest.approx(3.8)
    assert fe.fit_mode(df, ["k", "x"]).params == {"k": "a", "x": 2.0}
    assert col(fe.transform(df, [fe.constant_fill(["k"])]), "k") == ["b", "a", "missing", "b", "a", "c.d"]


def test_whole_numbers_take_a_fractional_median(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, n int")
    assert col(fe.transform(df, [fe.fit_median(df, ["n"])]), "n") == [1.0, 2.0, 1.5]


def test_population_std_and_constant_column(df):
    step = fe.fit_standard(df, ["x", "const"])
    assert step.params["x"][1] == pytest.approx(2.638181, abs=1e-6)
    assert set(col(fe.transform(df, [step]), "const")) == {0.0}


def test_one_hot_and_dummies(df):
    filled = fe.transform(df, [fe.constant_fill(["k"])])
    out = fe.transform(filled, [fe.fit_one_hot(filled, ["k"])])
    assert [c for c in out.columns if c.startswith("k_")] == ["k_b", "k_c.d", "k_missing"]
    dummies = fe.transform(df, [fe.fit_one_hot(df, ["k"])])
    assert col(dummies, "k_b") == [1, 0, 0, 1, 0, 0]


def test_unseen_level_is_all_zero(spark, df):
    step = fe.fit_one_hot(df, ["k"])
    new = spark.createDataFrame([(9, "zz")], "id int, k string")
    assert tuple(fe.transform(new, [step]).first())[1:] == (0, 0)


def test_wide_columns_become_sparse(spark, df):
    plain = fe.transform(df, [fe.fit_one_hot(df, ["k"])])
    wide = fe.transform(df, [fe.fit_one_hot(df, ["k"], max_levels=1)])
    names = [c for c in plain.columns if c.startswith("k_")]
    want = {r["id"]: [float(r[c]) for c in names] for r in plain.collect()}
    got = {r["id"]: r["k_levels"].toArray().tolist() for r in wide.collect()}
    assert got == want
    new = spark.createDataFrame([(9, "zz"), (10, None)], "id int, k string")
    unseen = fe.transform(new, [fe.fit_one_hot(df, ["k"], drop_first=False, max_levels=1)])
    assert all(sum(r["k_levels"].toArray()) == 0 for r in unseen.collect())
    labels = fe.transform(df, [fe.fit_labels(df, ["k"], max_levels=1)])
    assert col(labels, "k") == col(fe.transform(df, [fe.fit_labels(df, ["k"])]), "k")


def test_level_bound(df):
    with pytest.raises(ValueError):
        fe.fit_levels(df, ["k", "name"], max_levels=4)


def test_labels_small_and_large_agree(df):
    small = fe.transform(df, [fe.fit_labels(df, ["k"])])
    assert col(small, "k") == [1, 0, None, 1, 0, 2]
    assert col(fe.label_encode_large(df, "k", "code"), "code") == [1, 0, None, 1, 0, 2]


def test_recode_and_bins(df):
    assert col(fe.transform(df, [fe.value_map("k", {"a": 10})]), "k") == [None, 10, None, None, 10, None]
    assert col(fe.transform(df, [fe.equal_bins("x", [2.0, 5.0])]), "x_bin") == [0, 1, 1, 2, 2, None]
    assert fe.fit_quantile_bins(df, ["x"], 2).params == {"x": [2.0]}


def test_stateless(df):
    poly = fe.polynomial(df, ["x", "const"], 3)
    assert {"x*x", "x*const", "const*const", "x*x*const", "x*x*x"} <= set(poly.columns)
    assert col(poly, "x*x*const")[3] == 245.0
    assert col(fe.extract_title(df, "name"), "title") == ["Mr", None, "Miss", None, "the Countess", None]
    assert col(fe.sum_columns(df, ["x", "const"]), "family_size")[0] == 7.0
    assert col(fe.log_transform(df, ["x"]), "x_log")[0] == pytest.approx(0.693147, abs=1e-6)


def test_preprocess_fits_once_and_applies_anywhere(spark, df):
    steps = fe.fit_preprocess(df.select("id", "x", "k"), ["x"], ["k"])
    one = fe.transform(df.limit(1).select("id", "x", "k"), steps)
    assert one.columns == ["id", "x", "k_b", "k_c.d", "k_missing"]
    assert fe.params_table(spark, steps).count() == 4
    plan = fe.transform(df, steps)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_preprocess_on_a_stream(spark, df):
    import tempfile
    path = tempfile.mkdtemp(prefix="pipelab-test-")
    df.select("id", "x", "k").write.mode("overwrite").parquet(path)
    steps = fe.fit_preprocess(df, ["x"], ["k"])
    stream = fe.transform(spark.readStream.schema("id int, x double, k string").parquet(path), steps)
    q = stream.writeStream.format("memory").queryName("prepared").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("prepared").count() == 6


def test_columns(df):
    assert co.column_kinds(df, "x") == {"id": "numeric", "k": "categorical", "name": "categorical", "const": "numeric"}
    profile = {r["column"]: (r["nulls"], r["distinct"]) for r in co.column_profile(df).collect()}
    assert profile["x"] == (1, 3) and profile["k"] == (1, 3)
    aligned = co.align_columns(df, ["k", "new", "id"])
    assert aligned.columns == ["k", "new", "id"] and col(aligned, "new") == [0] * 6
    x, y = co.split_xy(df.withColumn("t", F.lit(1.0)), "t")
    assert "t" not in x.columns and y.dtypes == [("t", "int")]
