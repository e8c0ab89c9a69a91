"""From raw documents to packed training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as
Parquet in the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelab.llm import curriculum, decontaminate, jaccard_join, quality_rules, token_store
from pipelab.llm.components import cut_and_clear
from pipelab.llm.queries import END_ID, table, tokenizer_path, vocabulary_size
from pipelab.session import scratch_path

WORDS = 5
SHARE = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels of ``sf_dir``, does not reject."""
    model = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_quality(docs, model).filter("rule_label = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that of the smallest id; all others are single.

    Rows are told apart by id and text, so each row of a repeated or null id is decided by itself. A row
    without an id goes where its group has one with an id. Texts without words link with nothing and
    stay. Rows that repeat id and text count once.
    """
    text = F.xxhash64("text")
    found = cut_and_clear(jaccard_join.jaccard_components(docs, n=WORDS, share=SHARE, tag=text))  # read twice
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("tag"))).alias("first")
    grouped = found.filter("component is not null").groupBy("component").agg(first).select("first.id", "first.tag")
    single = found.filter("component is null").select(F.col("doc_id").alias("id"), "tag").distinct()
    kept = cut_and_clear(grouped.unionByName(single))  # and this by the look for repeated rows and the result
    stay = docs.withColumn("__text", text)
    stay = stay.join(kept, stay["doc_id"].eqNullSafe(kept["id"]) & (stay["__text"] == kept["tag"]), "left_semi")
    if not stay.groupBy("doc_id", "__text").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "__text"])
    return stay.drop("__text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order; part files and rows in them keep that order."""
    return curriculum.training_order(curriculum.plan_mixture(docs)).select(*docs.columns)


def stored_order() -> tuple[Column, ...]:
    """Place of a row in Parquet that was written sorted: number of its part, file, row in the file."""
    name = F.col("_metadata.file_name")
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), name, F.col("_metadata.row_index")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids in training order, and what the store holds for every document.

    ``docs`` is the Parquet that ``mixed`` was written to. The documents' columns have no room for
    a position, so the order is taken from where a row lies in it.
    """
    out = scratch_path(spark, "pipeline-tokens")
    token_store.write_store(docs, out, tokenizer_path(), END_ID, vocabulary_size(), order=stored_order())
    return token_store.read_documents(spark, out)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("tokens", tokens),
]

#: A fitted classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
