"""Contiguous shards of nearly equal bytes, with DataFrame functions only.

Documents are put in one order (id, nulls first; then size and checksum of the text). Narrow
rows without the text are range-partitioned by that order; the totals of the ranges, one row
each, are prefixed, and a running sum inside each range adds up to the bytes before every
document in the whole table. A shard is a piece between equal targets of that sum: a document
belongs to the shard in whose span of bytes its middle lies, so no shard is further from its
target than half a document at either end.

Null texts have no bytes, null ids come first, rows with equal id and text are
interchangeable. An empty table gives no rows. A document larger than a shard leaves the shards it
covers without documents. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelab.session import cut_lineage

SHARDS = 40
OVERHEAD = 16
#: Ranges whose totals are sent to every executor at most; with more the rows are shuffled to them.
BROADCAST_RANGES = 200_000

_ORDER = ["doc_id", "size", "text_crc32", "__tie"]


def _text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _with_prefix(rows: DataFrame) -> DataFrame:
    """Rows with ``__before`` (bytes ahead of the row), ``__rank`` (rows ahead) and ``__total`` (all bytes)."""
    # The tie is the row's own number, so that repeated rows, however many, can be cut between ranges.
    kept = cut_lineage(rows.withColumn("__tie", F.monotonically_increasing_id()))
    placed = cut_lineage(kept.repartitionByRange(*_ORDER).withColumn("__range", F.spark_partition_id()))
    totals = placed.groupBy("__range").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))  # one row a range
    whole = Window.orderBy("__range")
    ahead = whole.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__range",
        F.coalesce(F.sum("__bytes").over(ahead), F.lit(0)).alias("__bytes_ahead"),
        F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__rows_ahead"),
        F.sum("__bytes").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    small = totals.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    inside = Window.partitionBy("__range").orderBy(*_ORDER)
    return (
        placed.withColumn("__in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__nth", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(starts) if small else starts, "__range")
        .withColumn("__before", F.col("__bytes_ahead") + F.col("__in") - F.col("size"))
        .withColumn("__rank", F.col("__rows_ahead") + F.col("__nth") - 1)
        .drop("__tie", "__range", "__in", "__nth", "__bytes_ahead", "__rows_ahead")
    )


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, whole_rows: bool = False
) -> DataFrame:
    """doc_id, size (bytes of the text plus ``overhead``), text_crc32, law, shard, slot, grown_shard of every row.

    Slots count from 0 in every shard, in the order of the documents. ``grown_shard`` is null:
    with another number of shards all cuts move. With ``whole_rows`` the columns of ``docs`` come
    along as the struct ``row``.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (_text_bytes(text) + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *more
    )
    middle = 2 * F.col("__before") + F.col("size")
    cut = _with_prefix(rows).withColumns({"__middle": middle, "__twice": 2 * F.col("__total")}).withColumn(
        # a total of 0 has empty texts only, and no overhead
        "shard", F.when(F.col("__twice") > 0, F.expr(f"least({shards - 1}, (__middle * {shards}) div nullif(__twice, 0))")).otherwise(0).cast("int")
    )
    firsts = cut.groupBy("shard").agg(F.min("__rank").alias("__first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__rank") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if whole_rows else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write the rows of ``docs`` as one folder a shard, rows in the order of their slots; a large shard has several files."""
    placed = balanced_shards(docs, shards, whole_rows=True, **options)
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(F.col("shard").alias("__shard"), "row.*").withColumnRenamed("__shard", "shard_number").write.partitionBy("shard_number").parquet(path)
