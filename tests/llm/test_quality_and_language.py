import random

import numpy as np
from pyspark.sql import functions as F

from pipelab.llm import language_spans as ls
from pipelab.llm import quality_rules as qr


def corpus(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        good = k % 4 != 0
        if good:
            text = " ".join(rng.choices(words, k=80)).capitalize() + "."
        else:
            text = " ".join(w.upper() + "!!" for w in rng.choices(words, k=80)) if k % 8 else " ".join([rng.choice(words)] * 80)
        rows.append((k, text))
        labels.append((k, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = qr.fit_rules(docs, labels)
    got = qr.with_quality(docs, model).filter(qr.is_held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert len(got) > 80 and np.mean([r["rule_label"] == r["quality"] for r in got if r["quality"] is not None]) > 0.97
    assert len(model.rules) == len(model.weights) > 0
    same = qr.fit_rules(docs.repartition(3), labels.repartition(2))
    assert same.rules == model.rules


def test_scores_of_edge_cases(spark, docs, empty, texts):
    model = qr.RuleModel((qr.Rule(((0, True, 3.0), (4, False, 0.5))), qr.Rule(((1, False, 1.0),))), (2.0, -1.0), 0.25)
    got = qr.with_quality(docs, model)
    assert got.columns == [*docs.columns, "rule_score", "rule_label"] and got.count() == len(texts)
    assert got.filter("rule_score is null or rule_score < 0 or rule_score > 1").count() == 0
    row = got.filter("doc_id = 6").first()
    assert abs(row["rule_score"] - 1 / (1 + np.exp(-0.25))) < 1e-12
    assert qr.with_quality(empty, model).count() == 0


def test_no_or_one_class(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qr.with_quality(docs, qr.fit_rules(docs, none)).filter("rule_score <> 0.5").count() == 0
    ones = spark.createDataFrame([(k, 1) for k in range(1, 15)], "doc_id long, quality int")
    assert qr.with_quality(docs, qr.fit_rules(docs, ones)).filter("rule_label = 0").count() == 0
    assert qr.fit_rules(empty, ones).rules == ()


def test_rules_hold_where_their_terms_hold(spark):
    text = "If (feature 3 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 3 > 0.5)\n   Predict: 1.0\n"
    found = qr.rules_of("Tree 0 (weight 1.0):\n  " + text)
    assert [r.terms for r in found] == [((3, True, 0.5),), ((1, False, 2.0), (3, True, 0.5)), ((1, True, 2.0), (3, True, 0.5)), ((3, False, 0.5),)]


LANGUAGES = {"aa": "the thing with others that then", "bb": "über größe straße häuser schön", "cc": "привет мир это слово речь"}


def language_docs(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        lang = list(LANGUAGES)[k % 3]
        rows.append((k, " ".join(rng.choices(LANGUAGES[lang].split(), k=30)), lang if k % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_and_spans(spark):
    docs = language_docs(spark)
    model = ls.fit_languages(docs, keep=~qr.is_held_out(F.col("id")))
    assert model.languages == ("aa", "bb", "cc")
    got = {r["doc_id"]: r for r in ls.label_languages(docs, model).collect()}
    truth = {k: list(LANGUAGES)[k % 3] for k in range(300)}
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in truth]) > 0.99
    mixed = spark.createDataFrame([(1, (LANGUAGES["aa"] + " ") * 3 + (LANGUAGES["bb"] + " ") * 4)], "doc_id long, text string")
    row = ls.label_languages(mixed, model).first()
    assert [(s["first"], s["end"], s["lang"]) for s in row["spans"]] == [(0, 18, "aa"), (18, 38, "bb")] and row["lang_pred"] == "bb"


def test_language_edge_cases(spark, docs, empty, texts):
    model = ls.fit_languages(language_docs(spark))
    got = {r["doc_id"]: r for r in ls.label_languages(docs, model).collect()}
    for k in (5, 6, 7):
        assert (got[k]["lang_pred"], got[k]["score"]) == (ls.UNKNOWN, 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(ls.label_languages(docs, model).collect()) == len(texts)
    digits = spark.createDataFrame([(1, "12 34 !! ..")], "doc_id long, text string")
    assert ls.label_languages(digits, model).first()["lang_pred"] == ls.UNKNOWN
    nothing = ls.fit_languages(empty)
    assert nothing.languages == () and ls.label_languages(docs, nothing).filter("lang_pred <> 'und'").count() == 0
    assert ls.label_languages(empty, model).count() == 0


def test_fast_path_equals_full_viterbi():
    rng = np.random.default_rng(3)

    def plain(scores, penalty):
        n, k = scores.shape
        value, back = scores[0].copy(), []
        for row in scores[1:]:
            step = value[None, :] - penalty * (1 - np.eye(k))
            back.append(step.argmax(axis=1))
            value = step.max(axis=1) + row
        best = value.max()
        return best

    def worth(scores, path, penalty):
        return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()

    for _ in range(200):
        scores = rng.normal(0, rng.choice([0.5, 2, 6]), (rng.integers(1, 40), 3)) + rng.normal(0, 1, 3)
        path = ls.viterbi(scores, 4.0)
        assert abs(worth(scores, path, 4.0) - plain(scores, 4.0)) < 1e-9


def test_shortcut_against_all_paths_at_the_real_penalty():
    """Two neighbouring stretches of other languages share a switch; every path is tried."""
    from itertools import product

    def best(scores):
        n, k = scores.shape
        return max(sum(scores[i, p] for i, p in enumerate(path)) - ls.PENALTY * sum(a != b for a, b in zip(path, path[1:])) for path in product(range(k), repeat=n))

    rng = np.random.default_rng(11)
    cases = [np.array([[0.0, 14, -20], [0, -20, 14]])]
    for k, n in ((2, 9), (3, 7), (4, 5)):
        cases += [rng.normal(0, rng.choice([3, 7, 12]), (n, k)) for _ in range(120)]
    for scores in cases:
        path = ls.viterbi(scores, ls.PENALTY)
        worth = scores[np.arange(len(path)), path].sum() - ls.PENALTY * (np.diff(path) != 0).sum()
        assert abs(worth - best(scores)) < 1e-9
