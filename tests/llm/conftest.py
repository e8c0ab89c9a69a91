import pytest
from llm_texts import prose
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, a passage, a long text, repeated rows."""
    base = prose(1, 120)
    words = base.split()
    passage = prose(99, 30)
    rows = [
        (1, base), (2, base), (3, " ".join(words[:60] + ["changed"] + words[61:])), (4, " ".join(words[:119])),
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "One"), (10, "two words"),
        (11, prose(2, 40) + " " + passage + " " + prose(3, 40)), (12, passage + " " + prose(4, 50)), (13, prose(5, 20) + " " + passage),
        (14, prose(6, 5000)), (15, "é" * 60 + " ünïcödé 漢字 " + prose(7, 30)), (16, "x " * 200), (17, "x " * 150),
        (18, prose(8, 60)), (18, prose(8, 60)), (18, prose(9, 60)), (None, prose(10, 60)), (20, base.upper()),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with further columns, some with names that operators use inside."""
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    return df.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)).alias("source"),
        F.length("text").cast("long").alias("n_chars"), F.lit(0).alias("id"), F.lit("k").alias("key"), F.lit(1).alias("node"), F.lit(2).alias("size"),
        F.lit(3).alias("range"), F.lit("w").alias("words"), F.lit(4).alias("rank"), F.lit(5).alias("target"), F.lit(6).alias("start"),
    ).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
