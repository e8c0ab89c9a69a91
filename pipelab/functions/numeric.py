"""Small numeric and hashing column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when den is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def hash_key(seed: int | str, *ids: str | Column) -> Column:
    """md5 of ``id:...:seed``: a shuffle order that depends on ids and seed only."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_int(key: Column, digits: int = 8) -> Column:
    """The first hex digits of a hash key as a bigint."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def hash_unit(key: Column) -> Column:
    """A hash key as a double in [0, 1)."""
    return hash_int(key) / F.lit(float(16**8))


def numeric_sort_key(df: DataFrame, name: str) -> Column:
    """A double that never decreases when ``name`` increases.

    Used only to pick range buckets, so equal keys for different values are fine.
    Nulls come first, as in an ascending Spark sort.
    """
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.TimestampNTZType):
        day = F.unix_date(c.cast("date")).cast("double") * 86400.0
        key = day + F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")
    elif isinstance(dtype, T.TimestampType):
        key = F.unix_micros(c).cast("double")
    elif isinstance(dtype, T.DateType):
        key = F.unix_date(c).cast("double")
    elif isinstance(dtype, T.StringType):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        key = F.conv(head, 16, 10).cast("double")
    else:
        key = c.cast("double")
    return F.coalesce(key, F.lit(float("-inf")))


SMALL_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """The frame as a broadcast table when it has at most ``max_rows`` rows.

    One row more than the bound is asked for, so the check itself is bounded; a larger
    frame comes back unchanged and is joined by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on equally named keys, kept once; with ``null_safe`` null keys match."""
    if not null_safe:
        return left.join(right, keys, how)
    on = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"__r_{k}")
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    return left.join(right, on, how).drop(*[f"__r_{k}" for k in keys])
