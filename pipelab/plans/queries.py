"""Registered queries: each operator on whole tables, with the SQL that checks it.

``@query(name, sql)`` registers a function of (spark, sf_dir). Doubles are rounded to six
places on both sides (fewer where values run into the billions). Results of trained models are checked by facts that
SQL can compute: rows, ids, names, and whether what they report agrees with plain counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelab.functions import text as tx
from pipelab.operators import archive as ar
from pipelab.operators import columns as co
from pipelab.operators import errors as er
from pipelab.operators import features as fe
from pipelab.operators import metrics as me
from pipelab.operators import models as mo
from pipelab.operators import replay as rp
from pipelab.operators import splits as sp
from pipelab.plans import evaluate as ev
from pipelab.plans import views
from pipelab.plans.specs import PipelineSpec, prepare
from pipelab.plans.views import with_views
from pipelab.session import scratch_path
from pipelab.sources import tables as tb
from pipelab.streaming import archive_stream as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        (F.round(f"`{c}`", places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def r(expr: str, name: str, places: int = 6) -> str:
    """SQL of a rounded double, without negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {places}) + CAST(0 AS DOUBLE) AS {name}"


# --- sources and sinks ------------------------------------------------------------------

CLF_SCHEMA = "row_id bigint, y_true int, n_chars bigint, n_words bigint, lang string, source string"


@query("s1_load_table", f"""{with_views('clf')}
SELECT row_id, y_true, n_chars, n_words, CASE WHEN row_id % 17 <> 0 THEN lang END AS lang, source,
  concat('say "', source, '", then', chr(10), 'a new line, and ""more""') AS note FROM clf WHERE y_true IS NOT NULL""")
def s1_load_table(spark, sf_dir):
    """Quotes, commas and line breaks inside fields, and words for missing values."""
    path = scratch_path(spark, "load") + ".csv"
    rows = views.clf(spark, sf_dir).withColumn("lang", F.when(F.col("row_id") % 17 == 0, "NA").otherwise(F.col("lang")))
    rows = rows.withColumn("note", F.concat(F.lit('say "'), F.col("source"), F.lit('", then\na new line, and ""more""')))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tb.load_table(spark, path, CLF_SCHEMA + ", note string", "y_true")


@query("s2_write_predictions", f"""{with_views('clf_big')}
SELECT row_id, y_pred, CAST(line_level AS INT) AS agent_id, concat('day', CAST(y_true AS VARCHAR)) AS batch FROM clf_big""")
def s2_write_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    out = views.clf_big(spark, sf_dir).select(
        "row_id", "y_pred", F.col("line_level").cast("int").alias("agent_id"),
        F.concat(F.lit("day"), F.col("y_true").cast("string")).alias("batch"),
    )
    tb.write_predictions(out, path)
    return tb.read_predictions(spark, path, "row_id string, y_pred int, agent_id int, batch string")


def _log(spark, sf_dir):
    return views.run_log(views.table(spark, sf_dir, "events"))


def _batches(spark, sf_dir):
    return _log(spark, sf_dir).withColumn("batch", F.date_format("ts", "yyyy-MM-dd"))


_BATCHES = "b AS (SELECT *, strftime(ts, '%Y-%m-%d') AS batch FROM runs)"


@query("s3_latest_predictions", f"""{with_views('runs')}, {_BATCHES},
last AS (SELECT agent_id, max(batch) AS latest_batch FROM b GROUP BY agent_id)
SELECT b.agent_id, latest_batch, count(*) AS num_predictions
FROM b JOIN last ON b.agent_id = last.agent_id AND b.batch = last.latest_batch GROUP BY b.agent_id, latest_batch""")
def s3_latest_predictions(spark, sf_dir):
    return ar.latest_predictions(_batches(spark, sf_dir))


@query("s4_retain_predictions", f"""{with_views('runs')}, {_BATCHES},
k AS (SELECT agent_id, batch, row_number() OVER (PARTITION BY agent_id ORDER BY batch DESC) AS rn
      FROM (SELECT DISTINCT agent_id, batch FROM b))
SELECT b.task_id, b.run_id, b.agent_id, b.batch FROM b JOIN k ON b.agent_id = k.agent_id AND b.batch = k.batch WHERE k.rn <= 5""")
def s4_retain_predictions(spark, sf_dir):
    return ar.retain_predictions(_batches(spark, sf_dir), 5).select("task_id", "run_id", "agent_id", "batch")


def _arch(log):
    return ar.upsert(ar.with_generation(log))


ARCH = """arch AS (SELECT task_id, agent_id, run_id, seq, ts, parent_run_id, accuracy, f1_score, feature, first_seq,
    CAST(length(bin(seq)) - 1 AS INT) AS generation
  FROM (SELECT r.*, row_number() OVER (PARTITION BY task_id, agent_id ORDER BY seq DESC) AS rn,
               min(seq) OVER (PARTITION BY task_id, agent_id) AS first_seq FROM runs r) WHERE rn = 1)"""


def archive_tables(log: DataFrame) -> dict[str, DataFrame]:
    """The four archive tables of a log."""
    archive = _arch(log)
    return {
        "agents": archive.select("task_id", "agent_id", "run_id", "parent_run_id", "generation", "first_seq"),
        "agent_metrics": archive.unpivot(["task_id", "agent_id"], ["accuracy", "f1_score"], "metric", "value"),
        "performance_history": ar.history(log).select(
            "task_id", "agent_id", "attempt",
            F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("f1_score"), F.col("f1_score")).alias("metrics"), "ts",
        ),
        "agent_features": views.usage(log),
        "agent_code": archive.select("task_id", "agent_id", F.concat(F.lit('X["'), F.col("feature"), F.lit('"] = 1')).alias("code")),
    }


@query("s5_archive_round_trip", f"""{with_views('runs')}, {ARCH},
h AS (SELECT task_id, agent_id, count(*) AS attempts, {r('sum(accuracy)', 'total_accuracy')} FROM runs GROUP BY task_id, agent_id),
u AS (SELECT task_id, agent_id, count(DISTINCT feature) AS features FROM runs GROUP BY task_id, agent_id)
SELECT a.task_id, CAST(a.agent_id AS VARCHAR) AS agent_id, CAST(a.run_id AS VARCHAR) AS run_id, CAST(a.parent_run_id AS VARCHAR) AS parent_run_id,
  a.generation, a.first_seq, concat('X["', a.feature, '"] = 1') AS code, {r('a.accuracy', 'accuracy')}, h.attempts, h.total_accuracy, u.features
FROM arch a JOIN h ON a.task_id = h.task_id AND a.agent_id = h.agent_id JOIN u ON a.task_id = u.task_id AND a.agent_id = u.agent_id""")
def s5_archive_round_trip(spark, sf_dir):
    path = scratch_path(spark, "archive")
    tables = archive_tables(views.runs(spark, sf_dir))
    tb.save_archive(tables, path, 1)
    # A newer snapshot that was never finished must not be read.
    tables["agents"].limit(1).write.parquet(f"{path}/snapshot=2/agents")
    got = tb.load_archive(spark, path)
    key = ["task_id", "agent_id"]
    scores = got["agent_metrics"].filter("metric = 'accuracy'").select(*key, F.col("value").alias("accuracy"))
    tries = got["performance_history"].groupBy(*key).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.col("metrics")["accuracy"]).alias("total_accuracy")
    )
    features = got["agent_features"].groupBy(*key).agg(F.count(F.lit(1)).alias("features"))
    return rounded(got["agents"].join(scores, key).join(tries, key).join(features, key).join(got["agent_code"], key))


@query("s6_final_results", f"""{with_views('runs')}, {ARCH}
SELECT task_id, agent_id, run_id, {r('accuracy', 'accuracy')}, {r('f1_score', 'f1_score')}, generation, parent_run_id
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY accuracy DESC, seq) AS rn FROM arch) WHERE rn = 1""")
def s6_final_results(spark, sf_dir):
    best = ar.final_results(_arch(views.runs(spark, sf_dir)))
    return rounded(best.select("task_id", "agent_id", "run_id", "accuracy", "f1_score", "generation", "parent_run_id"))


GEN = "g AS (SELECT *, CAST(length(bin(seq)) - 1 AS INT) AS generation FROM runs)"


@query("s7_generation_summary", f"""{with_views('runs')}, {GEN},
p AS (SELECT c.*, q.accuracy AS parent_score FROM g c LEFT JOIN g q ON c.task_id = q.task_id AND c.parent_run_id = q.run_id),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id, generation ORDER BY accuracy DESC, run_id) AS rn,
        count(*) OVER (PARTITION BY task_id, generation) AS runs, avg(accuracy) OVER (PARTITION BY task_id, generation) AS mean_score FROM p)
SELECT task_id, generation, runs, {r('mean_score', 'mean_score')}, run_id AS best_run_id, agent_id AS best_agent_id,
  {r('accuracy', 'best_score')}, parent_run_id, {r('parent_score', 'parent_score')} FROM k WHERE rn = 1""")
def s7_generation_summary(spark, sf_dir):
    return rounded(ar.generation_summary(ar.with_generation(views.runs(spark, sf_dir))))


@query("s8_submission", f"""{with_views('clf')} SELECT row_id, true AS is_class FROM clf""")
def s8_submission(spark, sf_dir):
    """Every row once, with one of the classes."""
    df = views.clf(spark, sf_dir)
    train = co.with_int_target(df, "y_true")
    ready = prepare(train, PipelineSpec("submission", "logistic"), "y_true", ["row_id"])
    trained = mo.fit_logistic(ready.transform(train), ready.features, "y_true")
    scored = mo.score(trained, ready.transform(df), ["row_id"])
    return tb.submission(scored, "row_id", "y_pred").select("row_id", F.col("prediction").isin(0, 1).alias("is_class"))


# --- columns ----------------------------------------------------------------------------


@query("p1_column_profile", f"""{with_views('clf')}
SELECT 'row_id' AS "column", 'numeric' AS kind, count(*) - count(row_id) AS nulls, count(DISTINCT row_id) AS "distinct" FROM clf
UNION ALL SELECT 'n_chars', 'numeric', count(*) - count(n_chars), count(DISTINCT n_chars) FROM clf
UNION ALL SELECT 'n_words', 'numeric', count(*) - count(n_words), count(DISTINCT n_words) FROM clf
UNION ALL SELECT 'lang', 'categorical', count(*) - count(lang), count(DISTINCT lang) FROM clf
UNION ALL SELECT 'source', 'categorical', count(*) - count(source), count(DISTINCT source) FROM clf""")
def p1_column_profile(spark, sf_dir):
    return co.column_profile(views.clf(spark, sf_dir), "y_true")


@query("p2_split_xy", f"""{with_views('clf')}
SELECT 'x' AS part, count(*) AS n_rows, CAST(sum(n_words) AS BIGINT) AS total FROM clf
UNION ALL SELECT 'y', count(*), CAST(sum(y_true) AS BIGINT) FROM clf""")
def p2_split_xy(spark, sf_dir):
    x, y = co.split_xy(views.clf(spark, sf_dir), "y_true")
    totals = [
        df.select(F.lit(part).alias("part"), F.col(c).cast("bigint").alias("v")).groupBy("part").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("total"))
        for part, df, c in (("x", x, "n_words"), ("y", y, "y_true"))
    ]
    return totals[0].unionByName(totals[1])


@query("p3_select_features", f"{with_views('clf')} SELECT row_id, n_chars, lang FROM clf")
def p3_select_features(spark, sf_dir):
    return co.select_features(views.clf(spark, sf_dir), ["row_id", "n_chars", "age", "lang"])


@query("p4_align_columns", f"""{with_views('clf')}
SELECT row_id, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS lang_de, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS lang_en,
  0 AS lang_es, 0 AS lang_fr FROM clf""")
def p4_align_columns(spark, sf_dir):
    df = views.clf(spark, sf_dir).select("row_id", "lang")
    train = fe.transform(df, [fe.fit_one_hot(df, ["lang"], drop_first=False)])
    # the other frame knows two of the languages, under a code of its own for all others
    recode = fe.value_map("lang", {"de": "de", "en": "en", "es": "other", "fr": "other"})
    other = fe.transform(df, [recode])
    test = fe.transform(other, [fe.fit_one_hot(other, ["lang"], drop_first=False)])
    return co.align_columns(test, train.columns)


# --- features ---------------------------------------------------------------------------


@query("f1_impute_median", f"""{with_views('clf')}, m AS (SELECT median(n_chars) AS v FROM clf)
SELECT row_id, {r('coalesce(CAST(n_chars AS DOUBLE), m.v)', 'n_chars')} FROM clf, m""")
def f1_impute_median(spark, sf_dir):
    df = views.clf(spark, sf_dir).select("row_id", "n_chars")
    return rounded(fe.transform(df, [fe.fit_median(df, ["n_chars"])]))


@query("f2_impute_mean", f"""{with_views('clf')}, m AS (SELECT avg(n_chars) AS v FROM clf)
SELECT row_id, {r('coalesce(CAST(n_chars AS DOUBLE), m.v)', 'n_chars')} FROM clf, m""")
def f2_impute_mean(spark, sf_dir):
    df = views.clf(spark, sf_dir).select("row_id", "n_chars")
    return rounded(fe.transform(df, [fe.fit_mean(df, ["n_chars"])]))


@query("f3_impute_mode", f"""{with_views('clf')},
m AS (SELECT lang AS v FROM clf WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT row_id, coalesce(lang, m.v) AS lang FROM clf, m""")
def f3_impute_mode(spark, sf_dir):
    df = views.clf(spark, sf_dir).select("row_id", "lang")
    return fe.transform(df, [fe.fit_mode(df, ["lang"])])


@query("f4_impute_constant", f"{with_views('clf')} SELECT row_id, coalesce(lang, 'missing') AS lang FROM clf")
def f4_impute_constant(spark, sf_dir):
    return fe.transform(views.clf(spark, sf_dir).select("row_id", "lang"), [fe.constant_fill(["lang"])])


def _scaled(c: str, src: str = "clf_big") -> str:
    return f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END"


@query("f5_scale_standard", f"""{with_views('clf_big')}
SELECT row_id, {', '.join(r(_scaled(c), c) for c in ('quantity', 'price', 'discount', 'constant_feature'))} FROM clf_big""")
def f5_scale_standard(spark, sf_dir):
    names = ["quantity", "price", "discount", "constant_feature"]
    df = views.clf_big(spark, sf_dir).select("row_id", *names)
    return rounded(fe.transform(df, [fe.fit_standard(df, names)]))


LANGS = ["de", "en", "es", "fr"]
SOURCES = sorted(f"src{i}" for i in range(20))


def _dummies(c: str, levels: list[str], source: str | None = None) -> str:
    return ", ".join(f"CASE WHEN {source or c} = '{v}' THEN 1 ELSE 0 END AS {c}_{v}" for v in levels)


@query("f6_one_hot_drop_first", f"""{with_views('clf')}
SELECT row_id, {_dummies('lang', [*LANGS, 'missing'][1:], "coalesce(lang, 'missing')")}, {_dummies('source', SOURCES[1:])} FROM clf""")
def f6_one_hot_drop_first(spark, sf_dir):
    df = fe.transform(views.clf(spark, sf_dir).select("row_id", "lang", "source"), [fe.constant_fill(["lang", "source"])])
    return fe.transform(df, [fe.fit_one_hot(df, ["lang", "source"])])


@query("f7_get_dummies", f"{with_views('clf')} SELECT row_id, {_dummies('lang', LANGS[1:])} FROM clf")
def f7_get_dummies(spark, sf_dir):
    df = views.clf(spark, sf_dir).select("row_id", "lang")
    return fe.transform(df, [fe.fit_one_hot(df, ["lang"])])


@query("f8_label_encode", f"""{with_views('clf')},
l AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS code FROM (SELECT DISTINCT lang FROM clf WHERE lang IS NOT NULL)),
s AS (SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS code FROM (SELECT DISTINCT source FROM clf))
SELECT row_id, l.code AS lang, s.code AS source FROM clf LEFT JOIN l ON clf.lang = l.lang LEFT JOIN s ON clf.source = s.source""")
def f8_label_encode(spark, sf_dir):
    df = views.clf(spark, sf_dir).select("row_id", "lang", "source")
    return fe.transform(df, [fe.fit_labels(df, ["lang", "source"])])


@query("f8_label_encode_large", """WITH l AS (SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INT) AS code FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, l.code AS name_code FROM part JOIN l ON part.p_name = l.p_name""")
def f8_label_encode_large(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return fe.label_encode_large(parts, "p_name", "name_code").drop("p_name")


@query("f9_map_values", f"""{with_views('clf')}
SELECT row_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 END AS lang FROM clf""")
def f9_map_values(spark, sf_dir):
    return fe.transform(views.clf(spark, sf_dir).select("row_id", "lang"), [fe.value_map("lang", {"en": 0, "de": 1})])


@query("f10_polynomial", f"""{with_views('clf_big')}
SELECT row_id, {r('quantity', 'quantity')}, {r('discount', 'discount')}, {r('quantity * quantity', '"quantity*quantity"')},
  {r('quantity * discount', '"quantity*discount"')}, {r('discount * discount', '"discount*discount"')} FROM clf_big""")
def f10_polynomial(spark, sf_dir):
    return rounded(fe.polynomial(views.clf_big(spark, sf_dir).select("row_id", "quantity", "discount"), ["quantity", "discount"], 2))


@query("f11_interaction", f"{with_views('clf_big')} SELECT row_id, {r('price * discount', 'price_x_discount')} FROM clf_big")
def f11_interaction(spark, sf_dir):
    df = views.clf_big(spark, sf_dir).select("row_id", "price", "discount")
    return rounded(fe.interaction(df, "price", "discount").drop("price", "discount"))


@query("f12_bin_numeric", f"""{with_views('clf_big')},
e AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c FROM clf_big)
SELECT row_id, CASE WHEN quantity < 10 THEN 0 WHEN quantity < 25 THEN 1 WHEN quantity < 40 THEN 2 WHEN quantity >= 40 THEN 3 END AS quantity_bin,
  CASE WHEN price < a THEN 0 WHEN price < b THEN 1 WHEN price < c THEN 2 ELSE 3 END AS price_bin FROM clf_big, e""")
def f12_bin_numeric(spark, sf_dir):
    df = views.clf_big(spark, sf_dir).select("row_id", "quantity", "price")
    steps = [fe.equal_bins("quantity", [10, 25, 40]), fe.fit_quantile_bins(df, ["price"], 4)]
    return fe.transform(df, steps).drop("quantity", "price")


@query("f13_extract_title", "SELECT p_partkey, regexp_extract(p_name, '^(\\S+)', 1) AS title FROM part")
def f13_extract_title(spark, sf_dir):
    return fe.extract_title(views.table(spark, sf_dir, "part"), "p_name", r"^(\S+)").select("p_partkey", "title")


@query("f14_sum_columns", f"{with_views('clf_big')} SELECT row_id, {r('1 + quantity + discount', 'family_size')} FROM clf_big")
def f14_sum_columns(spark, sf_dir):
    df = fe.sum_columns(views.clf_big(spark, sf_dir), ["quantity", "discount"])
    return rounded(df.select("row_id", "family_size"))


@query("f15_log_transform", f"{with_views('clf_big')} SELECT row_id, {r('ln(1 + price)', 'price_log')} FROM clf_big")
def f15_log_transform(spark, sf_dir):
    return rounded(fe.log_transform(views.clf_big(spark, sf_dir).select("row_id", "price"), ["price"]).drop("price"))


def _prep_sql(c: str) -> str:
    return f"(f.{c} - avg(f.{c}) OVER ()) / stddev_pop(f.{c}) OVER ()"


@query("f16_preprocess", f"""{with_views('clf')}, k AS (SELECT * FROM clf WHERE y_true IS NOT NULL),
m AS (SELECT median(n_chars) AS c, median(n_words) AS w FROM k),
f AS (SELECT row_id, y_true, coalesce(CAST(n_chars AS DOUBLE), m.c) AS n_chars, coalesce(CAST(n_words AS DOUBLE), m.w) AS n_words,
      coalesce(lang, 'missing') AS lang, source FROM k, m)
SELECT f.row_id, f.y_true, {r(_prep_sql('n_chars'), 'n_chars')}, {r(_prep_sql('n_words'), 'n_words')},
  {_dummies('lang', [*LANGS, 'missing'][1:], 'f.lang')}, {_dummies('source', SOURCES[1:], 'f.source')} FROM f""")
def f16_preprocess(spark, sf_dir):
    df = co.with_int_target(views.clf(spark, sf_dir), "y_true")
    steps = fe.fit_preprocess(df, ["n_chars", "n_words"], ["lang", "source"])
    return rounded(fe.transform(df, steps))


# --- splits -----------------------------------------------------------------------------

KEYED = "k AS (SELECT *, md5(concat(row_id, ':42')) AS key FROM clf_big)"
QUOTA = """s AS (SELECT y_true, count(*) AS n FROM clf_big GROUP BY y_true),
t AS (SELECT sum(n) AS total, CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS BIGINT) AS held FROM s),
b AS (SELECT y_true, (n * held) // total AS base, (n * held) % total AS rest, held FROM s, t),
q AS (SELECT y_true, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y_true) <= held - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)"""
FOLDS = """s AS (SELECT y_true, count(*) AS n FROM clf_big GROUP BY y_true),
a AS (SELECT y_true, coalesce(sum(n) OVER (ORDER BY y_true ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
o AS (SELECT k.*, row_number() OVER (PARTITION BY k.y_true ORDER BY key, row_id) AS rn FROM k),
d AS (SELECT y_true, f, row_number() OVER (PARTITION BY y_true ORDER BY f) AS rn
      FROM (SELECT o.y_true, CAST((start + rn - 1) % 5 AS INT) AS f FROM o JOIN a ON o.y_true = a.y_true)),
folded AS (SELECT o.row_id, o.y_true, o.y_pred, d.f AS fold FROM o JOIN d ON o.y_true = d.y_true AND o.rn = d.rn)"""


@query("d1_stratified_split", f"""{with_views('clf_big')}, {KEYED}, {QUOTA}
SELECT k.row_id, k.y_true, row_number() OVER (PARTITION BY k.y_true ORDER BY key, row_id) <= quota AS is_validation
FROM k JOIN q ON k.y_true = q.y_true""")
def d1_stratified_split(spark, sf_dir):
    df = views.clf_big(spark, sf_dir).select("row_id", "y_true")
    return sp.stratified_split(df, "y_true", ["row_id"])


@query("d2_random_split", f"""{with_views('clf_big')}, {KEYED}
SELECT row_id, row_number() OVER (ORDER BY key, row_id) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_validation FROM k""")
def d2_random_split(spark, sf_dir):
    return sp.random_split(views.clf_big(spark, sf_dir).select("row_id"), ["row_id"])


@query("d3_stratified_kfold", f"{with_views('clf_big')}, {KEYED}, {FOLDS} SELECT row_id, y_true, fold FROM folded")
def d3_stratified_kfold(spark, sf_dir):
    df = views.clf_big(spark, sf_dir).select("row_id", "y_true")
    return sp.stratified_kfold(df, "y_true", ["row_id"])


@query("d4_kfold", f"""{with_views('reg')}, o AS (SELECT row_id, row_number() OVER (ORDER BY order_key, row_id) - 1 AS i, count(*) OVER () AS n FROM reg)
SELECT row_id, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS fold FROM o""")
def d4_kfold(spark, sf_dir):
    return sp.kfold(views.reg(spark, sf_dir).select("row_id", "order_key"), ["order_key", "row_id"], 7).drop("order_key")


# --- metrics ----------------------------------------------------------------------------

CONF = "c AS (SELECT y_true, y_pred, count(*) AS n FROM clf_big GROUP BY y_true, y_pred)"
PRF = f"""SELECT {r('coalesce(tp / nullif(predicted, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(actual, 0), 0)', 'recall')},
  {r('coalesce(2 * tp / nullif(predicted + actual, 0), 0)', 'f1')}, {r('hits / total', 'accuracy')}
FROM (SELECT CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN n ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN y_pred = 1 THEN n ELSE 0 END) AS predicted,
  sum(CASE WHEN y_true = 1 THEN n ELSE 0 END) AS actual, CAST(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS DOUBLE) AS hits, sum(n) AS total FROM c)"""
AUC = """au AS (SELECT sum(CAST(pos AS DOUBLE) * (2 * neg_below + neg)) / (2 * CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM clf_big GROUP BY score)))"""


@query("e1_confusion", f"{with_views('clf_big')}, {CONF} SELECT * FROM c")
def e1_confusion(spark, sf_dir):
    return me.confusion(views.clf_big(spark, sf_dir))


@query("e2_accuracy", f"""{with_views('clf_big')}
SELECT line_level, {r('avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END)', 'accuracy')} FROM clf_big GROUP BY line_level""")
def e2_accuracy(spark, sf_dir):
    return rounded(me.accuracy(views.clf_big(spark, sf_dir), ["line_level"]))


@query("e3_binary_scores", f"{with_views('clf_big')}, {CONF} {PRF}")
def e3_binary_scores(spark, sf_dir):
    return rounded(me.binary_scores(views.clf_big(spark, sf_dir)))


MULTI_ROWS = "m AS (SELECT DISTINCT row_id, y_true, y_pred FROM multi)"
WEIGHTED = f"""k AS (SELECT cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(a) AS DOUBLE) AS actual, CAST(sum(p) AS DOUBLE) AS predicted FROM (
    SELECT y_true AS cls, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp, 1 AS a, 0 AS p FROM m
    UNION ALL SELECT y_pred, 0, 0, 1 FROM m) GROUP BY cls),
w AS (SELECT sum(actual * coalesce(tp / nullif(predicted, 0), 0)) / sum(actual) AS precision, sum(actual * coalesce(tp / nullif(actual, 0), 0)) / sum(actual) AS recall,
  sum(actual * coalesce(2 * tp / nullif(predicted + actual, 0), 0)) / sum(actual) AS f1, sum(tp) / sum(actual) AS accuracy FROM k)"""


@query("e4_weighted_scores", f"""{with_views('multi')}, {MULTI_ROWS}, {WEIGHTED}
SELECT {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, {r('accuracy', 'accuracy')} FROM w""")
def e4_weighted_scores(spark, sf_dir):
    one_each = views.multi(spark, sf_dir).filter("cls = y_true")  # the long form has one such row per row
    return rounded(me.weighted_scores(one_each))


@query("e5_roc_auc", f"{with_views('clf_big')}, {AUC} SELECT {r('auc', 'roc_auc')} FROM au")
def e5_roc_auc(spark, sf_dir):
    return rounded(me.roc_auc(views.clf_big(spark, sf_dir)))


OVR = """x AS (SELECT cls, score, count(*) FILTER (WHERE y_true = cls) AS pos, count(*) FILTER (WHERE y_true <> cls) AS neg FROM multi GROUP BY cls, score),
y AS (SELECT cls, pos, neg, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x),
z AS (SELECT cls, CAST(sum(pos) AS DOUBLE) AS p, sum(CAST(pos AS DOUBLE) * (2 * below + neg)) / (2 * CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM y GROUP BY cls)"""
OVO = """prs AS (SELECT a.cls AS a, b.cls AS b FROM (SELECT DISTINCT cls FROM multi) a JOIN (SELECT DISTINCT cls FROM multi) b ON a.cls <> b.cls),
dx AS (SELECT prs.a, prs.b, score, count(*) FILTER (WHERE y_true = prs.a) AS pos, count(*) FILTER (WHERE y_true = prs.b) AS neg
      FROM multi JOIN prs ON multi.cls = prs.a AND (multi.y_true = prs.a OR multi.y_true = prs.b) GROUP BY prs.a, prs.b, score),
dy AS (SELECT a, b, pos, neg, coalesce(sum(neg) OVER (PARTITION BY a, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM dx),
dz AS (SELECT a, b, sum(pos) + sum(neg) AS n, sum(CAST(pos AS DOUBLE) * (2 * below + neg)) / (2 * CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM dy GROUP BY a, b),
du AS (SELECT least(a, b) AS u, greatest(a, b) AS v, avg(auc) AS auc, CAST(max(n) AS DOUBLE) AS n FROM dz GROUP BY 1, 2)"""


@query("e6_roc_auc_ovr", f"{with_views('multi')}, {OVR} SELECT {r('sum(auc * p) / sum(p)', 'roc_auc_ovr')} FROM z")
def e6_roc_auc_ovr(spark, sf_dir):
    return rounded(me.roc_auc_ovr(views.multi(spark, sf_dir)))


@query("e7_roc_auc_ovo", f"{with_views('multi')}, {OVO} SELECT {r('sum(auc * n) / sum(n)', 'roc_auc_ovo')} FROM du")
def e7_roc_auc_ovo(spark, sf_dir):
    return rounded(me.roc_auc_ovo(views.multi(spark, sf_dir)))


@query("e8_regression_scores", f"""{with_views('reg')}
SELECT {r('avg((y_true - y_pred) * (y_true - y_pred))', 'mse', 2)}, {r('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 'rmse', 2)},
  {r('avg(abs(y_true - y_pred))', 'mae', 2)}, {r('1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true)', 'r2', 2)} FROM reg""")
def e8_regression_scores(spark, sf_dir):
    return rounded(me.regression_scores(views.reg(spark, sf_dir)), 2)


@query("e9_cv_summary", f"""{with_views('clf_big')}, {KEYED}, {FOLDS},
v AS (SELECT fold, avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS score FROM folded GROUP BY fold)
SELECT 'accuracy' AS metric, {r('avg(score)', 'mean')}, {r('stddev_pop(score)', 'std')},
  string_agg(printf('%.6f', score), ',' ORDER BY fold) AS scores FROM v""")
def e9_cv_summary(spark, sf_dir):
    df = views.clf_big(spark, sf_dir).select("row_id", "y_true", "y_pred")
    by_fold = me.accuracy(sp.stratified_kfold(df, "y_true", ["row_id"]), ["fold"])
    summary = me.cv_summary(by_fold.select("fold", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("score")))
    text = F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), ",")
    return rounded(summary.withColumn("scores", text))


@query("e10_primary_score", f"{with_views('runs')} SELECT run_id, {r('coalesce(f1_score, 0)', 'score')} FROM runs")
def e10_primary_score(spark, sf_dir):
    metrics = F.map_filter(
        F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("f1_score"), F.col("f1_score")), lambda k, v: v.isNotNull()
    )
    log = views.run_log(views.table(spark, sf_dir, "events"))
    return rounded(log.select("run_id", me.primary_score(metrics, "f1_score").alias("score")))


ERR = "CASE WHEN y_true = y_pred THEN 0 ELSE 1 END"


@query("e11_error_summary", f"""{with_views('clf_big')}
SELECT {r(f'avg({ERR})', 'error_rate')}, count(*) FILTER (WHERE y_true = y_pred) AS correct_count, count(*) FILTER (WHERE y_true <> y_pred) AS incorrect_count FROM clf_big""")
def e11_error_summary(spark, sf_dir):
    return rounded(er.error_summary(views.clf_big(spark, sf_dir)))


@query("e12_class_errors", f"{with_views('clf_big')} SELECT y_true, {r(f'avg({ERR})', 'error_rate')}, count(*) AS n FROM clf_big GROUP BY y_true")
def e12_class_errors(spark, sf_dir):
    return rounded(er.class_errors(views.clf_big(spark, sf_dir)))


def _corr(view: str, feature: str, error: str) -> str:
    x, e = f"CAST({feature} AS DOUBLE)", f"CASE WHEN {feature} IS NOT NULL THEN CAST({error} AS DOUBLE) END"
    return (f"SELECT '{feature}' AS feature, " + r(f"covar_pop({x}, {e}) / nullif(stddev_pop({x}) * stddev_pop({e}), 0)", "correlation")
            + f" FROM {view}")


@query("e13_feature_error_correlation", with_views("clf_big") + "\n" + "\nUNION ALL ".join(
    _corr("clf_big", f, ERR) for f in ("quantity", "price", "discount", "tax", "constant_feature")))
def e13_feature_error_correlation(spark, sf_dir):
    features = ["quantity", "price", "discount", "tax", "constant_feature"]
    return rounded(er.feature_error_correlation(views.clf_big(spark, sf_dir), features))


@query("e13_feature_residual_correlation", with_views("reg") + "\n" + "\nUNION ALL ".join(
    _corr("reg", f, "(y_true - y_pred)") for f in ("quantity", "discount", "size")))
def e13_feature_residual_correlation(spark, sf_dir):
    residual = F.col("y_true") - F.col("y_pred")
    return rounded(er.feature_error_correlation(views.reg(spark, sf_dir), ["quantity", "discount", "size"], residual))


@query("e14_categorical_error_rates", f"""{with_views('clf_big')}
SELECT 'linestatus' AS feature, linestatus AS level, {r(f'avg({ERR})', 'error_rate')}, count(*) AS n FROM clf_big WHERE linestatus IS NOT NULL GROUP BY linestatus
UNION ALL SELECT 'line_level', line_level, {r(f'avg({ERR})', 'error_rate')}, count(*) FROM clf_big WHERE line_level IS NOT NULL GROUP BY line_level""")
def e14_categorical_error_rates(spark, sf_dir):
    return rounded(er.categorical_error_rates(views.clf_big(spark, sf_dir), ["linestatus", "line_level"]))


def _stats(rows: list[tuple[str, str]], source: str, places: int = 6) -> str:
    return "\nUNION ALL ".join(f"SELECT '{n}' AS statistic, {r(e, 'value', places)} FROM {source}" for n, e in rows)


@query("e15_regression_error_stats", f"""{with_views('reg')}, d AS (SELECT y_true - y_pred AS e FROM reg)
""" + _stats([("mean_absolute_error", "avg(abs(e))"), ("max_error", "max(abs(e))"), ("mean_error", "avg(e)"), ("mean", "avg(e)"),
              ("std", "stddev_pop(e)"), ("min", "min(e)"), ("max", "max(e)"), ("25%", "quantile_cont(e, 0.25)"), ("50%", "quantile_cont(e, 0.5)"),
              ("75%", "quantile_cont(e, 0.75)"), ("median_absolute_error", "quantile_cont(abs(e), 0.5)")], "d"))
def e15_regression_error_stats(spark, sf_dir):
    return rounded(er.regression_error_stats(views.reg(spark, sf_dir)))


def _unpivoted(source: str, names: list[str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM {source}" for n in names)


@query("e16_metrics_report", f"""{with_views('clf_big')}, {CONF}, p AS ({PRF}), {AUC}
{_unpivoted('p', ['accuracy', 'precision', 'recall', 'f1'])}
UNION ALL SELECT 'roc_auc', {r('auc', 'value')} FROM au""")
def e16_metrics_report(spark, sf_dir):
    return rounded(me.metrics_report(views.clf_big(spark, sf_dir)))


@query("e16_metrics_report_multiclass", f"""{with_views('multi')}, {MULTI_ROWS}, {WEIGHTED}, {OVR}, {OVO}
""" + "\nUNION ALL ".join(f"SELECT '{n}' AS metric, {r(n, 'value')} FROM w" for n in ("accuracy", "precision", "recall", "f1")) + f"""
UNION ALL SELECT 'roc_auc_ovr', {r('sum(auc * p) / sum(p)', 'value')} FROM z
UNION ALL SELECT 'roc_auc_ovo', {r('sum(auc * n) / sum(n)', 'value')} FROM du""")
def e16_metrics_report_multiclass(spark, sf_dir):
    return rounded(me.metrics_report(views.multi(spark, sf_dir), "multiclass"))


@query("e16_metrics_report_weighted", f"""{with_views('clf_big')}, m AS (SELECT row_id, y_true, y_pred FROM clf_big), {WEIGHTED},
v AS (SELECT f1 FROM w) SELECT metric, {r('value', 'value')} FROM (
  SELECT 'accuracy' AS metric, avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS value FROM m UNION ALL SELECT 'f1_weighted', f1 FROM v)""")
def e16_metrics_report_weighted(spark, sf_dir):
    """The two metrics of the default evaluation of two classes."""
    return rounded(ev.report_of(views.clf_big(spark, sf_dir), 2).filter(F.col("metric").isin("accuracy", "f1_weighted")))


@query("e16_metrics_report_regression", f"{with_views('reg')}, d AS (SELECT y_true, y_true - y_pred AS e FROM reg)\n" + _stats(
    [("mse", "avg(e * e)"), ("rmse", "sqrt(avg(e * e))"), ("mae", "avg(abs(e))"), ("r2", "1 - avg(e * e) / var_pop(y_true)")], "d", 2).replace("statistic", "metric"))
def e16_metrics_report_regression(spark, sf_dir):
    return rounded(me.metrics_report(views.reg(spark, sf_dir), "regression"), 2)


# --- archive ----------------------------------------------------------------------------


def _halves(spark, sf_dir):
    log = views.numbered(spark, sf_dir)
    sizes = log.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    both = log.join(sizes, "task_id")
    return both.filter("seq * 2 <= n").drop("n"), both.filter("seq * 2 > n").drop("n")


@query("a1_admit", f"""{with_views('runs')}, n AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n FROM runs),
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, agent_id ORDER BY seq DESC) AS rn FROM n WHERE seq * 2 <= n) WHERE rn = 1),
bars AS (SELECT task_id, median(accuracy) AS m, max(accuracy) AS b FROM early GROUP BY task_id)
SELECT n.task_id, n.run_id, {r('n.accuracy', 'accuracy')} FROM n JOIN bars ON n.task_id = bars.task_id
WHERE seq * 2 > n.n AND (n.accuracy >= m OR n.accuracy >= b)""")
def a1_admit(spark, sf_dir):
    early, late = _halves(spark, sf_dir)
    return rounded(ar.admit(late, ar.upsert(early), "accuracy").select("task_id", "run_id", "accuracy"))


@query("a2_upsert", f"""{with_views('runs')}, {ARCH}
SELECT task_id, agent_id, run_id, seq, first_seq, {r('accuracy', 'accuracy')}, {r('f1_score', 'f1_score')} FROM arch""")
def a2_upsert(spark, sf_dir):
    got = ar.upsert(views.numbered(spark, sf_dir))
    return rounded(got.select("task_id", "agent_id", "run_id", "seq", "first_seq", "accuracy", "f1_score"))


HIST = "h AS (SELECT *, row_number() OVER (PARTITION BY task_id, agent_id ORDER BY seq) AS attempt FROM runs)"


@query("a3_evict_worst", f"""{with_views('runs')}, {ARCH}, {HIST},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY accuracy DESC NULLS LAST, first_seq DESC) AS rn FROM arch) WHERE rn <= 100)
SELECT h.task_id, h.agent_id, h.run_id, h.attempt FROM h JOIN kept ON h.task_id = kept.task_id AND h.agent_id = kept.agent_id""")
def a3_evict_worst(spark, sf_dir):
    log = views.numbered(spark, sf_dir)
    kept = ar.evict_worst(ar.upsert(log), 100)
    return ar.drop_evicted(ar.history(log), kept).select("task_id", "agent_id", "run_id", "attempt")


#: The fold step by step: ``e`` holds the entries of a task's archive after its first ``seq`` rows.
REPLAY = """ev AS MATERIALIZED (SELECT task_id, seq, agent_id, run_id, accuracy AS score FROM runs),
st AS (
  SELECT task_id, CAST(0 AS BIGINT) AS seq, CAST([] AS STRUCT(agent BIGINT, place BIGINT, run BIGINT, score DOUBLE)[]) AS e,
    CAST(NULL AS BIGINT) AS run_id, false AS accepted FROM (SELECT DISTINCT task_id FROM ev)
  UNION ALL
  SELECT task_id, seq, CASE WHEN ok THEN list_append(list_filter(e, lambda x: x.agent <> coalesce(gone, -1)),
      {'agent': agent_id, 'place': CASE WHEN len(own) > 0 THEN own[1].place ELSE seq END, 'run': run_id, 'score': score}) ELSE e END, run_id, ok
  FROM (SELECT *, n = 0 OR score >= (s[(n + 1) // 2] + s[n // 2 + 1]) / 2 AS ok,
          CASE WHEN len(own) > 0 THEN agent_id WHEN n >= 100 THEN low[1].agent END AS gone
        FROM (SELECT ev.task_id, ev.seq, ev.agent_id, ev.run_id, ev.score, st.e, len(st.e) AS n,
                list_sort(list_transform(st.e, lambda x: x.score)) AS s, list_filter(st.e, lambda x: x.agent = ev.agent_id) AS own,
                list_sort(list_transform(st.e, lambda x: {'score': x.score, 'place': x.place, 'agent': x.agent})) AS low
              FROM st JOIN ev ON st.task_id = ev.task_id AND ev.seq = st.seq + 1)))"""
REPLAY_END = f"""z AS (SELECT task_id, unnest(e) AS x FROM (SELECT *, max(seq) OVER (PARTITION BY task_id) AS top FROM st) WHERE seq = top)
SELECT task_id, x.agent AS agent_id, x.run AS run_id, {r('x.score', 'score')}, x.place AS place FROM z"""


@query("a4_replay_archive", f"{with_views('runs')}, {REPLAY}, {REPLAY_END}")
def a4_replay_archive(spark, sf_dir):
    archive, _ = rp.replay_archive(views.numbered(spark, sf_dir), 100)
    return rounded(archive)


@query("a4_replay_decisions", f"{with_views('runs')}, {REPLAY} SELECT task_id, run_id, seq, accepted FROM st WHERE seq > 0")
def a4_replay_decisions(spark, sf_dir):
    _, decisions = rp.replay_archive(views.numbered(spark, sf_dir), 100)
    return decisions


@query("a5_history", f"{with_views('runs')}, {HIST} SELECT task_id, agent_id, run_id, attempt FROM h")
def a5_history(spark, sf_dir):
    return ar.history(_log(spark, sf_dir), order=("ts", "run_id")).select("task_id", "agent_id", "run_id", "attempt")


@query("a6_agent_history", f"""{with_views('runs')}, {HIST}
SELECT task_id, agent_id, run_id, attempt, {r('accuracy', 'accuracy')} FROM h WHERE agent_id = 7""")
def a6_agent_history(spark, sf_dir):
    got = ar.agent_history(ar.history(_log(spark, sf_dir).filter("agent_id = 7"), order=("ts", "run_id")), 7)
    return rounded(got.select("task_id", "agent_id", "run_id", "attempt", "accuracy"))


@query("a7_top_n", f"""{with_views('runs')}, {ARCH},
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY f1_score DESC NULLS LAST, first_seq) AS INT) AS place FROM arch)
SELECT task_id, place, agent_id, run_id, {r('f1_score', 'f1_score')} FROM t WHERE place <= 5""")
def a7_top_n(spark, sf_dir):
    best = ar.top_n(ar.upsert(views.numbered(spark, sf_dir)), 5, "f1_score")
    return rounded(best.select("task_id", "place", "agent_id", "run_id", "f1_score"))


@query("a7_top_n_overall", f"""{with_views('runs')}, {ARCH}
SELECT task_id, agent_id, run_id, {r('accuracy', 'accuracy')} FROM (SELECT * FROM arch ORDER BY accuracy DESC NULLS LAST, first_seq, agent_id LIMIT 20)""")
def a7_top_n_overall(spark, sf_dir):
    best = ar.top_n(ar.upsert(views.numbered(spark, sf_dir)), 20, "accuracy", None)
    return rounded(best.select("task_id", "agent_id", "run_id", "accuracy"))


@query("a8_feature_usage", f"""{with_views('resp')},
l AS (SELECT response_id, unnest(string_split(code, chr(10))) AS line FROM resp),
u AS (SELECT DISTINCT response_id, f.feature FROM l JOIN (SELECT concat('f', CAST(range AS VARCHAR)) AS feature FROM range(20)) f
  ON (contains(line, 'X[') OR contains(line, 'X.')) AND NOT (contains(line, 'drop') AND contains(line, 'columns')) AND contains(line, f.feature))
SELECT resp.response_id, coalesce(string_agg(u.feature, ',' ORDER BY u.feature), '') AS features_used, CAST(count(u.feature) AS INT) AS num_features_used
FROM resp LEFT JOIN u ON resp.response_id = u.response_id GROUP BY resp.response_id""")
def a8_feature_usage(spark, sf_dir):
    code = views.resp(spark, sf_dir).select("response_id", "code")
    known = code.select("response_id", F.explode(F.array(*[F.lit(f"f{i}") for i in range(20)])).alias("feature"))
    used = ar.feature_usage(code, known, "response_id")
    return used.withColumn("features_used", F.array_join("features_used", ","))


RARITY = """u AS (SELECT DISTINCT task_id, agent_id, feature FROM runs),
f AS (SELECT task_id, feature, count(*) AS n FROM u GROUP BY task_id, feature),
s AS (SELECT u.task_id, u.agent_id, round(sum(1.0 / CAST(f.n AS DOUBLE)), 9) AS rarity FROM u JOIN f ON u.task_id = f.task_id AND u.feature = f.feature GROUP BY u.task_id, u.agent_id),
v AS (SELECT arch.*, coalesce(s.rarity, 0) AS rarity FROM arch LEFT JOIN s ON arch.task_id = s.task_id AND arch.agent_id = s.agent_id)"""


@query("a9_diverse_n", f"""{with_views('runs')}, {ARCH}, {RARITY},
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY rarity DESC, first_seq) AS INT) AS place FROM v)
SELECT task_id, place, agent_id, {r('rarity', 'rarity')} FROM t WHERE place <= 10""")
def a9_diverse_n(spark, sf_dir):
    log = views.numbered(spark, sf_dir)
    return rounded(ar.diverse_n(ar.upsert(log), views.usage(log), 10).select("task_id", "place", "agent_id", "rarity"))


@query("a10_sample_n", f"""{with_views('runs')}, {ARCH}
SELECT task_id, agent_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5(concat(task_id, ':', CAST(agent_id AS VARCHAR), ':42')), agent_id) AS rn FROM arch) WHERE rn <= 50""")
def a10_sample_n(spark, sf_dir):
    return ar.sample_n(ar.upsert(views.numbered(spark, sf_dir)), 50).select("task_id", "agent_id", "run_id")


@query("a11_archive_summary", f"""{with_views('runs')}, {ARCH},
u AS (SELECT task_id, count(DISTINCT feature) AS uf, count(DISTINCT concat(CAST(agent_id AS VARCHAR), '/', feature)) AS uses FROM runs GROUP BY task_id)
SELECT arch.task_id, count(*) AS num_agents, {r('max(accuracy)', 'best_accuracy')}, {r('max(f1_score)', 'best_f1_score')},
  max(uf) AS unique_features, {r('max(uses) / CAST(count(*) AS DOUBLE)', 'avg_features_per_agent')} FROM arch JOIN u ON arch.task_id = u.task_id GROUP BY arch.task_id""")
def a11_archive_summary(spark, sf_dir):
    log = views.numbered(spark, sf_dir)
    return rounded(ar.archive_summary(ar.upsert(log), views.usage(log), ["accuracy", "f1_score"]))


@query("a12_lineage", f"""{with_views('runs')},
up AS (SELECT run_id, run_id AS root, parent_run_id AS next, CAST(0 AS BIGINT) AS depth, CAST('' AS VARCHAR) AS chain FROM runs
  UNION ALL SELECT up.run_id, p.run_id, p.parent_run_id, up.depth + 1, concat(up.chain, '/', CAST(p.run_id AS VARCHAR)) FROM up JOIN runs p ON up.next = p.run_id)
SELECT run_id, root AS root_run_id, depth, chain FROM up WHERE next IS NULL""")
def a12_lineage(spark, sf_dir):
    got = ar.lineage(views.runs(spark, sf_dir), with_chain=True)
    chain = F.array_join(F.transform("chain", lambda c: F.concat(F.lit("/"), c.cast("string"))), "")
    return got.withColumn("chain", chain)


@query("a13_best_so_far", f"""{with_views('runs')},
b AS (SELECT *, max(accuracy) OVER (PARTITION BY task_id ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM runs)
SELECT task_id, run_id, seq, {r('accuracy', 'accuracy')}, {r('previous_best', 'previous_best')} FROM b WHERE previous_best IS NULL OR accuracy > previous_best""")
def a13_best_so_far(spark, sf_dir):
    got = ar.best_so_far(_log(spark, sf_dir))
    return rounded(got.select("task_id", "run_id", F.col("place").alias("seq"), "accuracy", "previous_best"))


PLACES = """pl AS (SELECT task_id, agent_id, accuracy, first_seq, row_number() OVER (PARTITION BY task_id ORDER BY first_seq, agent_id) - 1 AS i,
  count(*) OVER (PARTITION BY task_id) AS n FROM arch),
el AS (SELECT task_id, agent_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY accuracy DESC NULLS LAST, first_seq) AS rn FROM arch) WHERE rn = 1)"""


def _draw_sql(name: str, first: int, last: int, seed: str) -> str:
    key = f"md5(concat(task_id, ':', CAST(slot AS VARCHAR), ':{seed}'))"
    return (f"{name} AS (SELECT task_id, CAST(slot AS INT) AS slot, n, CAST(concat('0x', substr({key}, 1, 8)) AS BIGINT) AS draw "
            f"FROM (SELECT DISTINCT task_id, n FROM pl), range({first}, {last + 1}) AS g(slot))")


@query("a14_next_generation", f"""{with_views('runs')}, {ARCH}, {PLACES}, {_draw_sql('dr', 2, 12, '42')}
SELECT task_id, CAST(1 AS INT) AS slot, 'elite' AS role, agent_id FROM el
UNION ALL SELECT dr.task_id, dr.slot, 'child', pl.agent_id FROM dr JOIN pl ON dr.task_id = pl.task_id AND dr.draw % dr.n = pl.i""")
def a14_next_generation(spark, sf_dir):
    return ar.next_generation(ar.upsert(views.numbered(spark, sf_dir)), 12)


@query("a15_select_parent", f"""{with_views('runs')}, {ARCH}, {PLACES},
{_draw_sql('un', 1, 20, '42:uniform')}, {_draw_sql('co', 1, 20, '42:coin')}, {_draw_sql('ro', 1, 20, '42:roulette')},
pick AS (SELECT un.task_id, un.slot, pl.agent_id FROM un JOIN pl ON un.task_id = pl.task_id AND un.draw % un.n = pl.i),
wh AS (SELECT task_id, agent_id, first_seq, accuracy AS w, coalesce(sum(accuracy) OVER (PARTITION BY task_id ORDER BY first_seq, agent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  sum(accuracy) OVER (PARTITION BY task_id) AS total FROM arch)
SELECT 'uniform' AS strategy, task_id, slot, agent_id FROM pick
UNION ALL SELECT 'elite', el.task_id, CAST(slot AS INT), agent_id FROM el, range(1, 21) AS g(slot)
UNION ALL SELECT 'elite_plus_diversity', pick.task_id, pick.slot, CASE WHEN co.draw / CAST(4294967296 AS DOUBLE) < 0.7 THEN el.agent_id ELSE pick.agent_id END
  FROM pick JOIN co ON pick.task_id = co.task_id AND pick.slot = co.slot JOIN el ON pick.task_id = el.task_id
UNION ALL SELECT 'roulette', ro.task_id, ro.slot, wh.agent_id FROM ro JOIN wh ON ro.task_id = wh.task_id
  AND ro.draw / CAST(4294967296 AS DOUBLE) * wh.total >= wh.start AND ro.draw / CAST(4294967296 AS DOUBLE) * wh.total < wh.start + wh.w""")
def a15_select_parent(spark, sf_dir):
    archive = ar.upsert(views.numbered(spark, sf_dir))
    out = None
    for strategy in ("uniform", "elite", "elite_plus_diversity", "roulette"):
        part = ar.select_parent(archive, strategy, 20).select(F.lit(strategy).alias("strategy"), "task_id", "slot", "agent_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("a16_recent_context", f"""{with_views('runs')}, {ARCH},
l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY first_seq DESC) AS rn FROM arch)
SELECT task_id, string_agg(printf('- Generation %d, Agent ID %s, Model: %s, accuracy: %.4f', generation, concat('agent_', CAST(1000000 + agent_id AS VARCHAR)), feature, coalesce(accuracy, 0)), chr(10) ORDER BY first_seq) AS context
FROM l WHERE rn <= 5 GROUP BY task_id""")
def a16_recent_context(spark, sf_dir):
    named = F.concat(F.lit("agent_"), (F.lit(1_000_000) + F.col("agent_id")).cast("string"))
    return ar.recent_context(_arch(views.numbered(spark, sf_dir)).withColumn("agent_id", named), model="feature")


@query("a17_generation_stats", f"""{with_views('runs')}, {GEN},
p AS (SELECT c.task_id, c.generation, c.accuracy - q.accuracy AS gain FROM g c JOIN g q ON c.task_id = q.task_id AND c.parent_run_id = q.run_id)
SELECT task_id, generation, count(*) AS children, {r('avg(gain)', 'mean_gain')}, {r('max(gain)', 'best_gain')},
  {r('avg(CASE WHEN gain > 0 THEN 1 ELSE 0 END)', 'improved_share')} FROM p GROUP BY task_id, generation""")
def a17_generation_stats(spark, sf_dir):
    return rounded(ar.generation_stats(ar.with_generation(views.runs(spark, sf_dir))))


@query("a18_stream_archive", f"{with_views('runs')}, {REPLAY}, {REPLAY_END}")
def a18_stream_archive(spark, sf_dir):
    """The log in four files by time, each a batch that goes on from the archive of the one before."""
    path, checkpoint, feed = (scratch_path(spark, f"stream-{n}") for n in ("archive", "checkpoint", "feed"))
    events = views.table(spark, sf_dir, "events")
    cuts = events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = events if low is None else events.filter(F.col("ts") >= F.lit(low))
        some = some if high is None else some.filter(F.col("ts") < F.lit(high))
        some.coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    st.stream_archive(views.run_log(stream), path, checkpoint, 100).awaitTermination()
    return rounded(st.current_archive(spark, path))


# --- responses and code -----------------------------------------------------------------

_FENCE_SQL = "concat(chr(96), chr(96), chr(96))"
JSON_SQL = r"""j AS (SELECT *, regexp_extract(text, '(?s)(?:^|\n)[ \t\r\f]*```json[^\n]*((?:\n.*?)??)(?:\n[ \t\r\f]*```|\z)', 1) AS block,
  regexp_extract_all(text, '(?s)\{.*?\}') AS objects FROM resp),
jj AS (SELECT *, CASE WHEN block <> '' THEN list_value(regexp_replace(block, '^\s+|\s+\z', '', 'g')) ELSE objects END AS candidates FROM j),
jv AS (SELECT *, list_filter(list_transform(candidates, lambda c: CASE WHEN json_valid(c) THEN c
  WHEN json_valid(regexp_replace(c, '[\x00-\x1F\x7F]', '', 'g')) THEN regexp_replace(c, '[\x00-\x1F\x7F]', '', 'g') END), lambda c: c IS NOT NULL)[1] AS found FROM jj),
jc AS (SELECT *, CASE WHEN starts_with(found, '{"suggestion": "old", "suggestion": ') THEN replace(found, '"suggestion": "old", ', '') ELSE found END AS json_text FROM jv),
je AS (SELECT *, json_extract_string(json_text, '$.suggestion') AS suggestion, json_extract_string(json_text, '$.code') AS json_code FROM jc)"""
BLOCKS_SQL = r"""bl AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '(?s)```(?:python\n)?(.*?)```', 1),
  lambda b: regexp_replace(b, '^\s+|\s+\z', '', 'g')), lambda b: b <> '') AS blocks FROM je)"""


@query("t1_extract_json", f"{with_views('resp')}, {JSON_SQL} SELECT response_id, kind, json_text, suggestion, json_code AS code FROM je")
def t1_extract_json(spark, sf_dir):
    got = views.resp(spark, sf_dir).select("response_id", "kind", tx.extract_json(F.col("text")).alias("json_text"))
    return got.select(
        "*", tx.json_field(F.col("json_text"), "suggestion").alias("suggestion"), tx.json_field(F.col("json_text"), "code").alias("code")
    )


@query("t2_extract_code_blocks", f"""{with_views('resp')}, {JSON_SQL}, {BLOCKS_SQL}
SELECT response_id, CAST(len(blocks) AS INT) AS n_blocks, blocks[1] AS first_block, array_to_string(blocks, '|') AS all_blocks FROM bl""")
def t2_extract_code_blocks(spark, sf_dir):
    got = views.resp(spark, sf_dir).select("response_id", tx.extract_code_blocks(F.col("text")).alias("b"))
    return got.select(
        "response_id", F.size("b").alias("n_blocks"), F.get("b", F.lit(0)).alias("first_block"), F.array_join("b", "|").alias("all_blocks")
    )


@query("t3_repair_json", rf"""{with_views('resp')},
a AS (SELECT *, instr(text, concat({_FENCE_SQL}, 'json')) AS s, length(text) - instr(reverse(text), {_FENCE_SQL}) - 1 AS e FROM resp),
b AS (SELECT *, regexp_replace(CASE WHEN s > 0 AND e > s + 7 THEN substr(text, CAST(s + 7 AS BIGINT), CAST(e - s - 7 AS BIGINT)) ELSE text END, '^\s+|\s+\z', '', 'g') AS t FROM a),
c AS (SELECT *, array_to_string(list_filter(string_split(replace(replace(replace(t, 'True', 'true'), 'False', 'false'), 'None', 'null'), chr(10)),
  lambda x: NOT regexp_matches(x, '^\s*(?://|#)')), chr(10)) AS u FROM b),
d AS (SELECT *, replace(replace(u, concat(',', chr(10), ']'), concat(chr(10), ']')), concat(',', chr(10), '}}'), concat(chr(10), '}}')) AS v FROM c)
SELECT response_id, kind, CASE WHEN json_valid(v) THEN CASE WHEN json_exists(v, '$.suggestion') AND json_exists(v, '$.code') THEN v END END AS repaired FROM d""")
def t3_repair_json(spark, sf_dir):
    repaired = tx.repair_json(F.col("text"), ["suggestion", "code"])
    return views.resp(spark, sf_dir).select("response_id", "kind", repaired.alias("repaired"))


@query("t4_response_quality", f"""SELECT role, count(*) AS n, count(*) FILTER (WHERE length(text) < 20) AS bad,
  {r('avg(CASE WHEN length(text) < 20 THEN 1 ELSE 0 END)', 'bad_rate')} FROM conversations GROUP BY role""")
def t4_response_quality(spark, sf_dir):
    bad = tx.is_bad_response(F.col("text"))
    return rounded(views.table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.avg(bad.cast("double")).alias("bad_rate")
    ))


_PARTS = [(n, rf"(?m)^\s*def {n}\s*\(") for n in tx.REQUIRED_FUNCTIONS] + [(n, rf"(?m)^\s*{n}\s*=[^=]") for n in tx.REQUIRED_GLOBALS]
MISSING_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT regexp_matches(code, '{p}') THEN '{n}' END" for n, p in _PARTS) + ")"


@query("t5_missing_parts", f"{with_views('resp')} SELECT response_id, {MISSING_SQL} AS missing FROM resp")
def t5_missing_parts(spark, sf_dir):
    return views.resp(spark, sf_dir).select("response_id", F.array_join(tx.missing_parts(F.col("code")), ",").alias("missing"))


@query("t5_validate_code", f"""{with_views('resp')}
SELECT response_id, {MISSING_SQL} = '' AS valid, {MISSING_SQL} AS missing FROM resp""")
def t5_validate_code(spark, sf_dir):
    got = views.resp(spark, sf_dir).select("response_id", tx.code_findings(F.col("code")).alias("v"))
    return got.select("response_id", "v.valid", F.array_join("v.missing", ",").alias("missing"))


@query("t5_missing_part_counts", f"""{with_views('resp')}, m AS (SELECT unnest(string_split({MISSING_SQL}, ',')) AS part FROM resp)
SELECT part, count(*) AS n FROM m WHERE part <> '' GROUP BY part""")
def t5_missing_part_counts(spark, sf_dir):
    parts = views.resp(spark, sf_dir).select(F.explode(tx.missing_parts(F.col("code"))).alias("part"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("t6_parse_code_header", rf"""{with_views('resp')}
SELECT response_id, regexp_extract(code, '(?m)^# Agent ID: ([^\n]*)', 1) AS agent_id, CAST(regexp_extract(code, '(?m)^# Generation: ([^\n]*)', 1) AS INT) AS generation,
  nullif(regexp_extract(code, '(?m)^# Parent ID: ([^\n]*)', 1), 'None') AS parent_id,
  regexp_replace(regexp_replace(code, '(?m)^# (?:Agent ID|Generation|Parent ID): [^\n]*\n?', '', 'g'), '^\n', '') AS code FROM resp""")
def t6_parse_code_header(spark, sf_dir):
    got = views.resp(spark, sf_dir).select("response_id", tx.parse_code_header(F.col("code")).alias("h"))
    return got.select("response_id", "h.*")


@query("t7_render_code_file", f"""{with_views('runs')}, {GEN}
SELECT run_id, concat('# Agent ID: ', CAST(agent_id AS VARCHAR), chr(10), '# Generation: ', CAST(generation AS VARCHAR), chr(10), '# Parent ID: ',
  coalesce(CAST(parent_run_id AS VARCHAR), 'None'), chr(10), chr(10), 'X["', feature, '"] = 1') AS text,
  CAST(agent_id AS VARCHAR) AS agent_id, generation, CAST(parent_run_id AS VARCHAR) AS parent_id, concat('X["', feature, '"] = 1') AS code FROM g""")
def t7_render_code_file(spark, sf_dir):
    """Rendered text, and what parsing it gives back."""
    log = ar.with_generation(views.runs(spark, sf_dir))
    code = F.concat(F.lit('X["'), F.col("feature"), F.lit('"] = 1'))
    text = tx.render_code_file(F.col("agent_id"), F.col("generation"), F.col("parent_run_id"), code)
    return log.select("run_id", text.alias("text")).withColumn("h", tx.parse_code_header(F.col("text"))).select("run_id", "text", "h.*")


@query("t8_build_prompts", f"""{with_views('runs')}
SELECT run_id, concat('Task: ', task_id, chr(10), 'Metrics:', chr(10), printf('- accuracy: %.4f', accuracy),
  CASE WHEN f1_score IS NULL THEN '' ELSE concat(chr(10), printf('- f1_score: %.4f', f1_score)) END, chr(10), 'Code:', chr(10), 'X["', feature, '"]') AS prompt FROM runs""")
def t8_build_prompts(spark, sf_dir):
    log = views.run_log(views.table(spark, sf_dir, "events"))
    metrics = F.create_map(F.lit("f1_score"), F.col("f1_score"), F.lit("accuracy"), F.col("accuracy"))
    code = F.concat(F.lit('X["'), F.col("feature"), F.lit('"]'))
    prompt = tx.build_prompt(F.col("task_id"), metrics, code, "Task: {task}\nMetrics:\n{metrics}\nCode:\n{code}")
    return log.select("run_id", prompt.alias("prompt"))


@query("t9_choose_code", f"""{with_views('resp')}, {JSON_SQL}, {BLOCKS_SQL}
SELECT response_id, kind, coalesce(nullif(json_code, ''), blocks[1], code) AS chosen FROM bl""")
def t9_choose_code(spark, sf_dir):
    return views.resp(spark, sf_dir).select("response_id", "kind", tx.choose_code(F.col("text"), F.col("code")).alias("chosen"))


# --- models -----------------------------------------------------------------------------

TARGET, IDS = "y_true", ["row_id"]


def _facts(spark, done: ev.Evaluation) -> DataFrame:
    """Per metric of a trained spec: rows it was measured on, and whether it agrees with plain counts of its predictions."""
    if done.error:
        raise RuntimeError(done.error)
    hit = F.col("y_true") == F.col("y_pred")
    n, hits, tp, said, real = done.predictions.agg(
        F.count(F.lit(1)), F.count_if(hit), F.count_if(hit & (F.col("y_true") == 1)), F.count_if(F.col("y_pred") == 1), F.count_if(F.col("y_true") == 1)
    ).first()
    precision, recall = tp / said if said else 0.0, tp / real if real else 0.0
    f1, tn = 2 * tp / (said + real) if said + real else 0.0, hits - tp
    other = 2 * tn / (2 * n - said - real) if 2 * n - said - real else 0.0
    want = {"accuracy": hits / n, "precision": precision, "recall": recall, "f1": f1, "f1_weighted": (real * f1 + (n - real) * other) / n}
    rows = [(done.spec.name, m, n, bool(abs(want.get(m, v) - v) < 1e-9 and 0 <= v <= 1)) for m, v in done.metrics.items()]
    return spark.createDataFrame(rows, "name string, metric string, n_valid bigint, agrees boolean")


def _facts_sql(name: str, view: str = "clf") -> str:
    return f"""{with_views(view)} SELECT '{name}' AS name, unnest(['accuracy', 'precision', 'recall', 'f1', 'f1_weighted', 'roc_auc']) AS metric,
  CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_valid, true AS agrees FROM {view} WHERE y_true IS NOT NULL"""


def _evaluated(spark, sf_dir, spec: PipelineSpec) -> DataFrame:
    return _facts(spark, ev.evaluate_spec(views.clf(spark, sf_dir), spec, TARGET, IDS))


def _of_known(text: str) -> str:
    """A text of CTEs over clf_big, over the rows of clf with a known class instead."""
    return "known AS (SELECT * FROM clf WHERE y_true IS NOT NULL), " + text.replace("clf_big", "known").replace("concat(row_id", "concat(CAST(row_id AS VARCHAR)")


@query("m1_fit_logistic", _facts_sql("logistic"))
def m1_fit_logistic(spark, sf_dir):
    return _evaluated(spark, sf_dir, PipelineSpec("logistic", "logistic"))


@query("m2_fit_random_forest", _facts_sql("forest"))
def m2_fit_random_forest(spark, sf_dir):
    params = {"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 2, "max_features": "sqrt", "bootstrap": True}
    return _evaluated(spark, sf_dir, PipelineSpec("forest", "random_forest", params))


@query("m3_fit_gbt", _facts_sql("boosted"))
def m3_fit_gbt(spark, sf_dir):
    return _evaluated(spark, sf_dir, PipelineSpec("boosted", "gbt", {"n_estimators": 5}))


SMALL_SPACE = {**mo.FOREST_SPACE, "n_estimators": ("int", 5, 20, 5), "max_depth": ("int", 3, 6, 1)}


def _prepared(spark, sf_dir):
    rows = co.with_int_target(views.clf(spark, sf_dir), TARGET)
    marked = sp.stratified_split(rows, TARGET, IDS)
    train, valid = marked.filter("NOT is_validation").drop("is_validation"), marked.filter("is_validation").drop("is_validation")
    ready = prepare(train, PipelineSpec("prepared"), TARGET, IDS)
    return ready, ready.transform(train), ready.transform(valid)


@query("m4_tune", f"""{with_views('clf')}, v AS (SELECT ceil(CAST(0.2 AS DOUBLE) * count(*)) AS n FROM clf WHERE y_true IS NOT NULL)
SELECT CAST(range AS INT) AS trial, true AS whole_hits, true AS best_is_highest FROM v, range(3) WHERE n > 0""")
def m4_tune(spark, sf_dir):
    """Trials, each with a whole number of hits on the held-out rows, and one best, the highest."""
    ready, train, valid = _prepared(spark, sf_dir)
    _, trials = mo.tune(train, valid, ready.features, TARGET, space=SMALL_SPACE, n_trials=3, id_cols=IDS)
    top = trials.agg(F.max("accuracy"), F.count_if("best"), F.max(F.when(F.col("best"), F.col("accuracy")))).first()
    hits = F.col("accuracy") * valid.count()
    return trials.select("trial", (F.abs(hits - F.round(hits)) < 1e-6).alias("whole_hits"), F.lit(top[1] == 1 and top[0] == top[2]).alias("best_is_highest"))


@query("m5_score", f"""{with_views('clf')}, {_of_known(KEYED)}, {QUOTA.replace('clf_big', 'known')}
SELECT row_id, y_true, true AS sums_to_one, true AS likeliest FROM (
  SELECT k.row_id, k.y_true, row_number() OVER (PARTITION BY k.y_true ORDER BY key, row_id) <= quota AS held FROM k JOIN q ON k.y_true = q.y_true) WHERE held""")
def m5_score(spark, sf_dir):
    """Held-out rows with class probabilities that sum to 1 and the likeliest class predicted."""
    ready, train, valid = _prepared(spark, sf_dir)
    trained = mo.fit_logistic(train, ready.features, TARGET)
    scored = mo.score(trained, valid, [*IDS, TARGET])
    total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
    return scored.select(*IDS, TARGET, (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (F.get("proba", F.col("y_pred")) == F.array_max("proba")).alias("likeliest"))


@query("m6_evaluate_spec", _facts_sql("mixed"))
def m6_evaluate_spec(spark, sf_dir):
    spec = PipelineSpec("mixed", "logistic", numeric_fill="mean", categorical_fill="mode", encode="label",
                        interactions=(("n_chars", "n_words"),), logs=("n_words",))
    return _evaluated(spark, sf_dir, spec)


@query("m7_cross_validate", f"""{with_views('clf')}, {_of_known(KEYED)}, {FOLDS.replace('clf_big', 'known').replace('% 5', '% 3').replace('o.y_pred, ', '')},
c AS (SELECT fold, count(*) AS n FROM folded GROUP BY fold)
SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'f1_weighted', 'roc_auc']) AS metric, string_agg(CAST(n AS VARCHAR), ',' ORDER BY fold) AS fold_rows,
  true AS each_row_once, true AS mean_of_folds FROM c""")
def m7_cross_validate(spark, sf_dir):
    """Metrics over three folds, the rows predicted in each, and whether the mean is that of the folds."""
    df, spec = views.clf(spark, sf_dir), PipelineSpec("logistic", "logistic", {"max_iter": 20})
    folded = ev.fold_rows(df, TARGET, IDS, 3)
    made = ev.fold_predictions(folded, spec, TARGET, IDS, 3)
    sizes = made.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids")).orderBy("fold").collect()
    once = sum(s["ids"] for s in sizes) == made.select("row_id").distinct().count() == sum(s["n"] for s in sizes)
    folded.unpersist()
    got = ev.cross_validate(df, spec, TARGET, IDS, 3)
    mean = F.aggregate("scores", F.lit(0.0), lambda a, b: a + b) / F.size("scores")
    return got.select(
        "metric", F.lit(",".join(str(s["n"]) for s in sizes)).alias("fold_rows"), F.lit(once).alias("each_row_once"),
        ((F.abs(mean - F.col("mean")) < 1e-9) & (F.size("scores") == 3)).alias("mean_of_folds"),
    )


@query("m7_cross_validate_regression", f"""{with_views('reg')}, o AS (SELECT *, row_number() OVER (ORDER BY order_key, row_id) - 1 AS i, count(*) OVER () AS n FROM reg),
f AS (SELECT *, CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM o),
c AS (SELECT t.fold, regr_slope(h.y_true, h.y_pred) AS b, regr_intercept(h.y_true, h.y_pred) AS a FROM (SELECT DISTINCT fold FROM f) t JOIN f h ON h.fold <> t.fold GROUP BY t.fold),
e AS (SELECT f.fold, f.y_true, f.y_true - (a + b * f.y_pred) AS d FROM f JOIN c ON f.fold = c.fold),
s AS (SELECT fold, avg(d * d) AS mse, avg(abs(d)) AS mae, 1 - sum(d * d) / (var_pop(y_true) * count(*)) AS r2 FROM e GROUP BY fold)
SELECT 'mse' AS metric, {r('avg(mse)', 'mean', 1)} FROM s UNION ALL SELECT 'mae', round(avg(mae), 1) FROM s UNION ALL SELECT 'r2', round(avg(r2), 1) FROM s""")
def m7_cross_validate_regression(spark, sf_dir):
    """A straight line through one feature, over three contiguous folds, against the closed form."""
    df = views.reg(spark, sf_dir).select("row_id", "order_key", "y_true", F.col("y_pred").alias("x"))
    spec = PipelineSpec("line", "linear", scale=False)
    got = ev.cross_validate(df, spec, "y_true", ["order_key", "row_id"], 3, metrics=["mse", "mae", "r2"], task_type="regression")
    return rounded(got.select("metric", "mean"), 1)


@query("m8_compare_specs", f"""{with_views('clf')}, n AS (SELECT count(*) AS n FROM clf WHERE y_true IS NOT NULL)
SELECT name, status, CAST(metrics AS BIGINT) AS metrics, failed AS has_error FROM n,
  (VALUES ('logistic', 'completed', 6, false), ('forest', 'completed', 6, false), ('broken', 'failed', 0, true)) AS v(name, status, metrics, failed) WHERE n > 0""")
def m8_compare_specs(spark, sf_dir):
    specs = [
        PipelineSpec("logistic", "logistic", {"max_iter": 20}),
        PipelineSpec("forest", "random_forest", {"n_estimators": 5, "max_depth": 3}),
        PipelineSpec("broken", "no_such_model"),
    ]
    got = ev.compare_specs(views.clf(spark, sf_dir), specs, TARGET, IDS, 2)
    return got.groupBy("name", "status").agg(F.count("metric").alias("metrics"), F.max(F.col("error").isNotNull()).alias("has_error"))


@query("m9_feature_importance", f"""{with_views('clf')}, known AS (SELECT coalesce(lang, 'missing') AS lang, source FROM clf WHERE y_true IS NOT NULL),
d AS (SELECT DISTINCT concat('lang_', lang) AS f, lang = min(lang) OVER () AS first FROM known
  UNION SELECT DISTINCT concat('source_', source), source = min(source) OVER () FROM known)
SELECT f AS feature, true AS shares FROM d WHERE NOT first UNION ALL SELECT unnest(['n_chars', 'n_words']), true""")
def m9_feature_importance(spark, sf_dir):
    ready, train, _ = _prepared(spark, sf_dir)
    got = mo.feature_importance(spark, mo.fit_random_forest(train, ready.features, TARGET, n_estimators=10))
    total = got.agg(F.sum("importance")).first()[0]
    return got.select("feature", ((F.col("importance") >= 0) & F.lit(abs(total - 1) < 1e-9)).alias("shares"))


@query("m10_search", f"""{with_views('clf')}, n AS (SELECT count(*) AS n FROM clf WHERE y_true IS NOT NULL)
SELECT CAST(range / 3 > 0.99 AS INT) AS generation, CAST(range + 1 AS BIGINT) AS agent_id, range < 3 AS is_root, true AS scored, true AS new_id FROM n, range(5) WHERE n > 0""")
def m10_search(spark, sf_dir):
    """Evaluated specs of two generations of three: the best is kept and not evaluated again."""
    start = PipelineSpec("start", "logistic", {"max_iter": 20})
    log = ev.search(views.clf(spark, sf_dir), TARGET, IDS, start, generations=2, population=3).log
    again = log.groupBy("agent_id").count().filter("count > 1").count()
    return log.select(
        "generation", "agent_id", F.col("parent_id").isNull().alias("is_root"),
        (F.col("error").isNull() & F.col("score").between(0, 1)).alias("scored"), F.lit(again == 0).alias("new_id"),
    )


@query("m11_save_load_model", f"""{with_views('clf')}
SELECT count(*) AS n, CAST(0 AS BIGINT) AS different FROM clf""")
def m11_save_load_model(spark, sf_dir):
    """Rows scored by a model and by its reloaded copy, and how many differ."""
    df = views.clf(spark, sf_dir)
    train = co.with_int_target(df, TARGET)
    ready = prepare(train, PipelineSpec("saved", "logistic"), TARGET, IDS)
    trained = mo.fit_logistic(ready.transform(train), ready.features, TARGET, max_iter=20)
    path = scratch_path(spark, "model")
    mo.save_model(spark, trained, path)
    rows = ready.transform(df)
    before = mo.score(trained, rows, IDS).withColumnsRenamed({"y_pred": "p1", "proba": "a1"})
    after = mo.score(mo.load_model(spark, path), rows, IDS)
    return before.join(after, "row_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("p1") != F.col("y_pred")) | (F.col("a1") != F.col("proba"))).alias("different")
    )


def _large(spark, sf_dir, measured: Callable[[ev.Evaluation], DataFrame]) -> DataFrame:
    """What is measured of a spec on the large table; its split is kept until then."""
    raw = views.clf_big(spark, sf_dir).drop("score", "y_pred", "constant_feature")
    marked = ev.split_rows(raw, TARGET, IDS)
    try:
        return measured(ev.evaluate_spec(raw, PipelineSpec("large", "logistic", {"max_iter": 20}), TARGET, IDS, marked=marked))
    finally:
        marked.unpersist()


@query("m6_evaluate_large", _facts_sql("large", "clf_big"))
def m6_evaluate_large(spark, sf_dir):
    """Split, preparation, training, scoring and metrics on the large table."""
    return _large(spark, sf_dir, lambda done: _facts(spark, done))


def large_report(spark, sf_dir) -> DataFrame:
    """(metric, value) of the held-out rows of the large table."""

    def report(done: ev.Evaluation) -> DataFrame:
        if done.error:
            raise RuntimeError(done.error)
        return me.metrics_report(done.predictions, "binary")  # counts are checkpointed, so the split is not read after

    return _large(spark, sf_dir, report)
