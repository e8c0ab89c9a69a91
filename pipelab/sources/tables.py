"""Tables in and out: inputs, predictions, archive snapshots, results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelab.sources.csv_records import read_csv_records

#: Words of a CSV file that stand for a missing value; fixed values.
NULL_WORDS = ("NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A", "-nan", "-NaN")
DONE = "_DONE"

ARCHIVE_TABLES = {
    "agents": "task_id string, agent_id string, run_id string, parent_run_id string, generation int, first_seq bigint",
    "agent_metrics": "task_id string, agent_id string, metric string, value double",
    "performance_history": "task_id string, agent_id string, attempt bigint, metrics map<string,double>, ts timestamp_ntz",
    "agent_features": "task_id string, agent_id string, feature string",
    "agent_code": "task_id string, agent_id string, code string",
}


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, target: str | None = None, multi_line: bool = True, null_words: tuple[str, ...] = NULL_WORDS) -> DataFrame:
    """Read CSV or Parquet; rows without a target are dropped when a target is named.

    Give a schema for CSV: without one the file is read once more. CSV fields may be quoted,
    with doubled quotes and, unless ``multi_line`` is off, line breaks inside; files are cut into
    splits either way. Words that stand for a missing value become null.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        if multi_line:
            df = read_csv_records(spark, path, schema)
        else:
            reader = spark.read.option("header", True).option("escape", '"')
            df = (reader.option("inferSchema", True) if schema is None else reader.schema(schema)).csv(path)
        words = F.lit([*null_words]) if null_words else None
        if words is not None:
            df = df.select(*[
                F.when(~F.array_contains(words, F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")
                for c, t in df.dtypes
            ])
    elif kind == ".parquet":
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    else:
        raise ValueError(f"unsupported file format: {path}")
    return df.na.drop(subset=[target]) if target and target in df.columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """On any file system the session can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_predictions(df: DataFrame, path: str, agent: str = "agent_id", batch: str = "batch", fmt: str = "csv") -> None:
    """One folder per agent and batch, replaced when it is written again. Rows are rebalanced by folder first: adaptive
    execution splits a large folder over several tasks and puts small ones together."""
    writer = df.hint("rebalance", agent, batch).write.mode("overwrite").partitionBy(agent, batch)
    writer = writer.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_predictions(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Predictions of all agents; a filter on agent or batch prunes folders."""
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def save_archive(tables: dict[str, DataFrame], path: str, snapshot: int) -> str:
    """Write the archive tables under a new snapshot; earlier snapshots stay.

    A mark is written last: a snapshot without it is unfinished and is not read.
    """
    base = os.path.join(path, f"snapshot={snapshot}")
    for name in ARCHIVE_TABLES:
        cast = tables[name].select(*[F.col(f.name).cast(f.dataType) for f in tables[name].sparkSession.createDataFrame([], ARCHIVE_TABLES[name]).schema.fields])
        cast.write.mode("overwrite").parquet(os.path.join(base, name))
    jvm = spark_of(tables)._jvm
    mark = jvm.org.apache.hadoop.fs.Path(os.path.join(base, DONE))
    mark.getFileSystem(spark_of(tables)._jsc.hadoopConfiguration()).create(mark, True).close()
    return base


def spark_of(tables: dict[str, DataFrame]):
    return next(iter(tables.values())).sparkSession.sparkContext


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    if not path_exists(spark, path):
        return []
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return [s.getPath().getName() for s in listed]


def latest_snapshot(spark: SparkSession, path: str) -> int | None:
    """Number of the newest finished snapshot; None when there is none."""
    numbers = [int(n.split("=")[1]) for n in list_names(spark, path) if n.startswith("snapshot=")]
    done = (n for n in sorted(numbers, reverse=True) if path_exists(spark, os.path.join(path, f"snapshot={n}", DONE)))
    return next(done, None)


def load_archive(spark: SparkSession, path: str, snapshot: int | None = None) -> dict[str, DataFrame]:
    """The archive tables of a snapshot, by default the newest finished one.

    Empty tables where nothing was ever saved; an unfinished snapshot asked for is an error.
    """
    if snapshot is None:
        snapshot = latest_snapshot(spark, path)
    if snapshot is None:
        return {name: spark.createDataFrame([], schema) for name, schema in ARCHIVE_TABLES.items()}
    base = os.path.join(path, f"snapshot={snapshot}")
    if not path_exists(spark, os.path.join(base, DONE)):
        raise ValueError(f"snapshot {snapshot} under {path} is missing or unfinished")
    return {name: spark.read.schema(schema).parquet(os.path.join(base, name)) for name, schema in ARCHIVE_TABLES.items()}


def load_agent(spark: SparkSession, path: str, agent_id: str, snapshot: int | None = None) -> DataFrame:
    """An agent's entries with its code: agents beside agent_code of one id."""
    tables = load_archive(spark, path, snapshot)
    mine = F.col("agent_id") == F.lit(str(agent_id))
    return tables["agents"].filter(mine).join(tables["agent_code"].filter(mine), ["task_id", "agent_id"], "left")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def submission(scored: DataFrame, id_col: str, prediction: str = "prediction") -> DataFrame:
    """Id and prediction per row."""
    return scored.select(id_col, F.col(prediction).cast("int").alias("prediction"))
