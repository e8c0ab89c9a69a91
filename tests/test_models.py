import random

import pytest

from pipelab.operators import models as mo
from pipelab.plans import evaluate as ev
from pipelab.plans import queries
from pipelab.plans.specs import PipelineSpec, mutate, prepare


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(240):
        x, k = rng.gauss(0, 1), rng.choice(["a", "b", None])
        data.append((i, None if i % 40 == 0 else int(x + (k == "a") > 0.2), x if i % 9 else None, rng.random(), k))
    return spark.createDataFrame(data, "id int, y int, x double, noise double, k string").cache()


def test_evaluate_learns_and_reports(rows):
    got = ev.evaluate_spec(rows, PipelineSpec("s", "logistic"), "y", ["id"])
    assert got.error is None and got.score > 0.75
    assert set(got.metrics) == {"accuracy", "precision", "recall", "f1", "f1_weighted", "roc_auc"}
    assert max(got.importance, key=got.importance.get) in ("x", "k_b", "k_missing")
    assert got.predictions.columns == ["id", "y_true", "y_pred", "score"]


def test_failure_scores_zero(rows):
    got = ev.evaluate_spec(rows, PipelineSpec("s", "no_such_model"), "y", ["id"])
    assert got.score == 0.0 and "no_such_model" in got.error


def test_forest_does_not_depend_on_partitions(rows):
    spec = PipelineSpec("f", "random_forest", {"n_estimators": 8, "max_depth": 4})
    got = [ev.evaluate_spec(rows.repartition(n), spec, "y", ["id"]).metrics for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_many_levels_train_and_report(rows):
    narrow = ev.evaluate_spec(rows, PipelineSpec("n", "logistic"), "y", ["id"])
    wide = ev.evaluate_spec(rows, PipelineSpec("w", "logistic", max_levels=1), "y", ["id"])
    assert wide.error is None and wide.metrics["accuracy"] == pytest.approx(narrow.metrics["accuracy"], abs=0.05)
    assert set(wide.importance) == {"x", "noise", "k_levels"}


def test_any_labels(rows):
    plain = ev.evaluate_spec(rows, PipelineSpec("s", "logistic"), "y", ["id"])
    named = rows.selectExpr("id", "CASE y WHEN 0 THEN 'bad' WHEN 1 THEN 'good' END AS y", "x", "noise", "k")
    high = rows.selectExpr("id", "y * 7 + 5000 AS y", "x", "noise", "k")
    for df, labels in ((named, ["bad", "good"]), (high, [5000, 5007])):
        got = ev.evaluate_spec(df, PipelineSpec("s", "logistic"), "y", ["id"])
        assert got.error is None and got.metrics == pytest.approx(plain.metrics)
        assert ev.class_labels(df, "y") == labels


def test_unknown_parameters_and_spaces(rows):
    got = ev.evaluate_spec(rows, PipelineSpec("s", "logistic", {"n_estimators": 5}), "y", ["id"])
    assert "n_estimators" in got.error
    tuned = ev.evaluate_spec(rows, PipelineSpec("t", "logistic", tune_trials=2), "y", ["id"])
    assert tuned.error is None and set(tuned.trained.params) == {"reg_param", "elastic_net", "max_iter"}


def test_long_errors_stay_whole(rows):
    got = ev.evaluate_spec(rows, PipelineSpec("s", "x" * 5000), "y", ["id"])
    assert len(got.error) > 5000


@pytest.mark.parametrize("model", ["linear", "random_forest_regressor", "gbt_regressor"])
def test_regression(rows, model):
    df = rows.na.drop(subset=["x"]).selectExpr("id", "x * 3 + noise AS target", "x", "k")
    params = {} if model == "linear" else {"n_estimators": 5}
    got = {r["metric"]: r["mean"] for r in ev.cross_validate(df, PipelineSpec("r", model, params), "target", ["id"], 3, task_type="regression", metrics=["r2", "mae"]).collect()}
    assert set(got) == {"r2", "mae"} and got["r2"] > (0.8 if model == "linear" else 0.4)


def test_tuned_spec_and_trials(rows):
    ready = prepare(rows.na.drop(subset=["y"]), PipelineSpec("p"), "y", ["id"])
    data = ready.transform(rows.na.drop(subset=["y"]))
    space = {"n_estimators": ("int", 2, 6, 2), "max_depth": ("int", 2, 3, 1), "max_features": ("choice", ["sqrt", None])}
    best, trials = mo.tune(data, data, ready.features, "y", space=space, n_trials=3)
    table = trials.collect()
    assert len(table) == 3 and sum(r["best"] for r in table) == 1
    assert max(r["accuracy"] for r in table) == next(r["accuracy"] for r in table if r["best"])
    assert mo.draw_params(space, random.Random(1)) == mo.draw_params(space, random.Random(1))
    assert best["n_estimators"] in (2, 4, 6)


def test_every_row_is_predicted_once_per_cv(rows):
    folded = ev.fold_rows(rows, "y", ["id"], 3)
    table = ev.fold_predictions(folded, PipelineSpec("s", "logistic"), "y", ["id"], 3)
    assert table.count() == table.select("id").distinct().count() == rows.na.drop(subset=["y"]).count()


def test_three_classes(spark):
    rng = random.Random(7)
    data = [(i, i % 3, (i % 3) * 2 + rng.gauss(0, 0.5)) for i in range(150)]
    df = spark.createDataFrame(data, "id int, y int, x double")
    got = ev.evaluate_spec(df, PipelineSpec("s", "random_forest", {"n_estimators": 5}), "y", ["id"])
    assert got.error is None and got.metrics["roc_auc_ovo"] > 0.9


def test_mutation_changes_one_thing():
    rng = random.Random(8)
    spec = PipelineSpec("s")
    for i in range(30):
        child = mutate(spec, rng, f"c{i}", ["x", "z"])
        changed = [f for f in ("model", "numeric_fill", "categorical_fill", "encode", "scale", "interactions") if getattr(child, f) != getattr(spec, f)]
        assert len(changed) == 1


def test_search_keeps_its_best(rows):
    result = ev.search(rows, "y", ["id"], PipelineSpec("start", "logistic", {"max_iter": 10}), generations=2, population=2, limit=2)
    log = result.log.collect()
    assert len(log) == 3 and result.best.score == max(r["score"] for r in log)
    assert result.archive.count() <= 2
    assert ev.best_of(result).first()["score"] == result.best.score


def test_only_models_that_sample_get_placed_rows(rows, monkeypatch):
    plans = {}
    fitted = mo._fit_vectors
    monkeypatch.setattr(mo, "_fit_vectors", lambda frame, features, kind, params, seed: (
        plans.update({kind: frame._jdf.queryExecution().executedPlan().toString()}), fitted(frame, features, kind, params, seed))[1])
    for kind, params in (("logistic", {"max_iter": 2}), ("linear", {}), ("gbt", {"n_estimators": 1}), ("random_forest", {"n_estimators": 1})):
        mo.fit(rows.filter("x IS NOT NULL AND y IS NOT NULL"), ["x"], "y", kind, params, id_cols=["id"])
    assert {k: ("Exchange" in p, "Sort" in p) for k, p in plans.items()} == {
        "logistic": (False, False), "linear": (False, False), "gbt": (True, True), "random_forest": (True, True)}


def counted_ids(spark, n, parts=4):
    """Rows whose id is made by Python, and an accumulator of how many were made."""
    made = spark.sparkContext.accumulator(0)

    def number(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.range(0, n, 1, parts).mapInArrow(number, "id long"), made


def test_contiguous_folds_make_their_rows_once(spark):
    df, made = counted_ids(spark, 400)
    rows = df.selectExpr("id", "cast(3 * id + 1 AS double) AS y", "cast(id AS double) AS x")
    got = ev.cross_validate(rows, PipelineSpec("line", "linear", scale=False), "y", ["id"], 3, metrics=["mae", "r2"], task_type="regression")
    means = {r["metric"]: r["mean"] for r in got.collect()}
    assert means == pytest.approx({"mae": 0.0, "r2": 1.0}, abs=1e-6) and made.value == 400


def test_large_query_keeps_its_split_until_it_is_measured(spark, monkeypatch):
    """The rows are made for the classes, for two looks at the cut points and to be kept; and for nothing after."""
    df, made = counted_ids(spark, 500)
    raw = df.selectExpr(
        "cast(id AS string) AS row_id", "cast(id % 7 < 3 AS int) AS y_true", "0.5D AS score", "1 AS y_pred", "5.0D AS constant_feature",
        "cast(id % 7 AS double) AS quantity", "if(id % 5 = 0, NULL, cast(id % 3 AS string)) AS line_level")
    monkeypatch.setattr(queries.views, "clf_big", lambda spark, sf_dir: raw)
    got = queries.QUERIES["m6_evaluate_large"](spark, "").collect()
    assert {r["metric"] for r in got} == {"accuracy", "precision", "recall", "f1", "f1_weighted", "roc_auc"}
    assert all(r["agrees"] and r["n_valid"] == 100 for r in got) and made.value == 4 * 500
    assert {r["metric"] for r in queries.large_report(spark, "").collect()} == {"accuracy", "precision", "recall", "f1", "roc_auc"}


def test_gaps_in_class_numbers_are_told_exactly(spark):
    """4,501 classes below 4,951 leave at most a tenth of the numbers unused; one fewer does not."""
    rows = spark.range(4951).selectExpr("id", "cast(id AS int) AS y")
    kept = rows.filter("id < 4500 OR id = 4950")
    assert ev.class_count(ev.with_class_numbers(kept, "y"), "y") == 4951
    assert ev.class_count(ev.with_class_numbers(kept.filter("id <> 7"), "y"), "y") == 4500
