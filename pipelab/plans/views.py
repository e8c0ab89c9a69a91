"""Input views over the given tables, as DataFrames and as SQL text for the checks.

Nulls are injected by key because the tables hold none. All rows and whole texts are used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelab.operators.ordering import ranked

FENCE = "```"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _row_id():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", *[c.cast("string") for c in (
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), cents)])


def clf_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary classification with nulls and tied scores."""
    raised = F.when(F.col("l_returnflag") == "R", 20).otherwise(0)
    points = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 101 + raised
    return table(spark, sf_dir, "lineitem").select(
        _row_id().alias("row_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        (points.cast("double") / F.lit(121.0)).alias("score"),
        F.when(points >= 60, 1).otherwise(0).alias("y_pred"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.lit(5.0).alias("constant_feature"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_linestatus")).alias("linestatus"),
        F.col("l_linenumber").cast("string").alias("line_level"),
    )


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression with a prediction."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        _row_id().alias("row_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("p_size").alias("size"),
        F.col("p_type").alias("part_type"),
    )


def clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small labelled table with text features."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("n_words"),
        F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("lang"),
        "source",
    )
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 19 != 0, F.col("quality")).alias("y_true")
    )
    return marks.join(docs, F.col("row_id") == F.col("doc_id")).select(
        "row_id", "y_true", "n_chars", "n_words", "lang", "source"
    )


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes, one row per (row, class) with a score."""
    y_true = F.substring("o_orderpriority", 1, 1).cast("int")
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        "o_custkey",
        y_true.alias("y_true"),
        ((F.col("o_orderkey") * 3 + F.col("o_custkey")) % 5 + 1).cast("int").alias("y_pred"),
        F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("cls"),
    )
    raised = F.when(F.col("y_true") == F.col("cls"), 20).otherwise(0)
    points = (F.col("row_id") * (7 + F.col("cls")) + F.col("o_custkey")) % 101 + raised
    return base.select("row_id", "y_true", "y_pred", "cls", (points.cast("double") / F.lit(121.0)).alias("score"))


def run_log(events: DataFrame) -> DataFrame:
    """Events as results of agents on tasks, without the place in the task's log."""
    k = F.regexp_extract("props", r"\{\"k\": (\d+)\}", 1).cast("int")
    return events.select(
        F.col("event_type").alias("task_id"),
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("agent_id"),
        "ts",
        (F.col("value") / (F.col("value") + 50.0)).alias("accuracy"),
        F.when(F.col("event_id") % 13 != 0, F.col("value") / (F.col("value") + 80.0)).alias("f1_score"),
        F.concat(F.lit("f"), (k % 20).cast("string")).alias("feature"),
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every run's place ``seq`` in its task."""
    return ranked(run_log(table(spark, sf_dir, "events")), ["task_id"], ["ts", "run_id"], "seq")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log: five tasks, agents that re-run, a parent tree over each task's log."""
    log = numbered(spark, sf_dir)
    parents = log.select(
        F.col("task_id").alias("p_task"), F.col("seq").alias("p_seq"), F.col("run_id").alias("parent_run_id")
    )
    on = (F.col("task_id") == F.col("p_task")) & (F.expr("seq div 2") == F.col("p_seq"))
    return log.join(parents, on, "left").select(
        "task_id", "seq", "run_id", "agent_id", "ts", "parent_run_id", "accuracy", "f1_score", "feature"
    )


def usage(log: DataFrame) -> DataFrame:
    return log.select("task_id", "agent_id", "feature").distinct()


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses in six shapes, each with the whole text of its turn.

    In JSON the text is escaped; one shape repeats a key. Code carries the text as comment
    lines and comes in four lengths.
    """
    body = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    plain = F.translate("text", "`{}", "")
    quoted = F.concat(F.lit("\n# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    code = F.concat(
        F.lit("# Agent ID: "), F.col("conv_id").cast("string"),
        F.lit("\n# Generation: "), F.col("turn").cast("string"),
        F.lit('\n# Parent ID: None\n\nMODEL_TYPE = "RandomForest"\ndef preprocess_data(df, cfg):\n'
              '    X = df\n    X["f1"] = X["f2"]'),
        F.when(F.col("turn") % 2 == 0, F.lit("\ndef evaluate_model(m):\n    return m")).otherwise(F.lit("")),
        F.when(F.col("conv_id") % 3 == 0, F.lit('\nFE_STEPS_DESCRIPTION = ["a"]\ndef train_final_model(p):\n    pass')).otherwise(F.lit("")),
        F.translate(quoted, "`", ""),
    )
    base = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", ((F.col("conv_id") + F.col("turn")) % 6).alias("kind"),
        F.translate(body, "`{}", "").alias("body"), plain.alias("plain"), code.alias("code"),
    )
    kind = F.col("kind")
    open_json = F.lit('{"suggestion": "')
    text = (
        F.when(kind == 0, F.concat(F.lit(f"Here it is.\n{FENCE}json\n"), open_json, "body",
                                   F.lit(f'", "code": "def preprocess_data(df): pass"}}\n{FENCE}\nDone.')))
        .when(kind == 1, F.concat(F.lit('Answer: {"suggestion": "old", "suggestion": "'), "body", F.lit('", "code": "MODEL_TYPE = 1"} end')))
        .when(kind == 2, F.concat("plain", F.lit(f"\n{FENCE}python\n"), "code", F.lit(f"\n{FENCE}")))
        .when(kind == 3, F.concat(F.lit(f"{FENCE}\n  a = 1\n{FENCE} and {FENCE}python\n"), "code", F.lit(f"\n{FENCE}\n"), "plain"))
        .when(kind == 4, F.concat(open_json, "body"))
        .otherwise(F.concat(F.lit("ok "), "plain"))
    )
    return base.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"),
        F.col("conv_id").alias("agent_id"), "role", "kind", "code", text.alias("text"),
    )


_ROW_ID_SQL = """concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-',
  CAST(l_suppkey AS VARCHAR), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))"""

SQL = {
    "clf_big": f"""SELECT {_ROW_ID_SQL} AS row_id,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CAST((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 101 + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END AS DOUBLE) / CAST(121 AS DOUBLE) AS score,
  CASE WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 101 + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END >= 60 THEN 1 ELSE 0 END AS y_pred,
  CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(5 AS DOUBLE) AS constant_feature,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linestatus END AS linestatus,
  CAST(l_linenumber AS VARCHAR) AS line_level
FROM lineitem""",
    "reg": f"""SELECT {_ROW_ID_SQL} AS row_id, l_orderkey AS order_key,
  l_extendedprice AS y_true, l_quantity * p_retailprice AS y_pred,
  l_quantity AS quantity, l_discount AS discount, p_size AS size, p_type AS part_type
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "clf": """SELECT d.doc_id AS row_id,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE l.quality END AS y_true,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.n_chars END AS n_chars,
  CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS BIGINT) AS n_words,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.lang END AS lang, d.source AS source
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "multi": """SELECT o.o_orderkey AS row_id, CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS y_true,
  CAST((o.o_orderkey * 3 + o.o_custkey) % 5 + 1 AS INT) AS y_pred, k.cls AS cls,
  CAST((o.o_orderkey * (7 + k.cls) + o.o_custkey) % 101 + CASE WHEN CAST(substr(o.o_orderpriority, 1, 1) AS INT) = k.cls THEN 20 ELSE 0 END AS DOUBLE) / CAST(121 AS DOUBLE) AS score
FROM orders o CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS k(cls)""",
    "runs": """SELECT e.task_id, e.seq, e.run_id, e.agent_id, e.ts, p.run_id AS parent_run_id, e.accuracy, e.f1_score, e.feature
FROM (SELECT event_type AS task_id, event_id AS run_id, user_id AS agent_id, ts,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq,
    value / (value + CAST(50 AS DOUBLE)) AS accuracy,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / (value + CAST(80 AS DOUBLE)) END AS f1_score,
    concat('f', CAST(CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) % 20 AS VARCHAR)) AS feature
  FROM events) e
LEFT JOIN (SELECT event_type AS task_id, event_id AS run_id,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events) p
  ON e.task_id = p.task_id AND p.seq = e.seq // 2""",
    "resp": """SELECT conv_id * 1000 + turn AS response_id, conv_id AS agent_id, role, (conv_id + turn) % 6 AS kind, code,
  CASE (conv_id + turn) % 6
    WHEN 0 THEN concat('Here it is.', chr(10), fence, 'json', chr(10), '{"suggestion": "', body, '", "code": "def preprocess_data(df): pass"}', chr(10), fence, chr(10), 'Done.')
    WHEN 1 THEN concat('Answer: {"suggestion": "old", "suggestion": "', body, '", "code": "MODEL_TYPE = 1"} end')
    WHEN 2 THEN concat(plain, chr(10), fence, 'python', chr(10), code, chr(10), fence)
    WHEN 3 THEN concat(fence, chr(10), '  a = 1', chr(10), fence, ' and ', fence, 'python', chr(10), code, chr(10), fence, chr(10), plain)
    WHEN 4 THEN concat('{"suggestion": "', body)
    ELSE concat('ok ', plain) END AS text
FROM (SELECT conv_id, turn, role, concat(chr(96), chr(96), chr(96)) AS fence,
    translate(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), '`{}', '') AS body,
    translate(text, '`{}', '') AS plain,
    concat('# Agent ID: ', CAST(conv_id AS VARCHAR), chr(10), '# Generation: ', CAST(turn AS VARCHAR), chr(10), '# Parent ID: None', chr(10), chr(10),
      'MODEL_TYPE = "RandomForest"', chr(10), 'def preprocess_data(df, cfg):', chr(10), '    X = df', chr(10), '    X["f1"] = X["f2"]',
      CASE WHEN turn % 2 = 0 THEN concat(chr(10), 'def evaluate_model(m):', chr(10), '    return m') ELSE '' END,
      CASE WHEN conv_id % 3 = 0 THEN concat(chr(10), 'FE_STEPS_DESCRIPTION = ["a"]', chr(10), 'def train_final_model(p):', chr(10), '    pass') ELSE '' END,
      translate(concat(chr(10), '# ', replace(text, chr(10), concat(chr(10), '# '))), '`', '')) AS code
  FROM conversations) c""",
}


def with_views(*names: str) -> str:
    """CTE prefix for the check SQL."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
