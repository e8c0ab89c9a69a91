"""Size of the batches that texts go to Python in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Lower the rows of an Arrow batch to ``rows``; whole texts make batches of Spark's default rows large."""
    now = int(spark.conf.get(_SETTING))
    if now <= 0 or now > rows:
        spark.conf.set(_SETTING, str(rows))


def release() -> None:
    """Give memory that batches no longer use back to the machine, at the end of a task."""
    pa.default_memory_pool().release_unused()
