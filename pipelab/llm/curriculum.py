"""Mixing sources to target weights along a curriculum that changes with time.

Each source gets a target number of words: its share by weight of all words, at most
``MOST`` times its own size; what is above goes to the others by weight. A document is
taken a whole number of times, at most ``MOST``: every copy of a source's full passes, then
the documents that lie, in hash order, in the first part of one more pass.

A source's weight schedule gives its weight at every training time from 0 to 1. Its
integral is the cumulative demand; inverting it for the words that come before the middle
of a copy gives the copy's training position. Sorting by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
#: Knots (time, weight) of the schedules, repeating over the sources; weights between knots are linear.
SCHEDULES = (
    ((0.0, 1.2), (1.0, 0.8)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
MOST = 3
RANGE_ROWS = 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target words of each source: columns source, source_size, rank, target.

    Sources are numbered by code point, null last. Filling up by weight under upper limits is
    done in one pass: sources in order of limit over weight reach their limit one after the
    other, and the first whose even share is within its limit fixes the share of all the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("w", w)
        .withColumn("limit", (F.col("source_size") * most).cast("double"))
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    within = F.col("level") <= F.col("limit") / F.col("w")
    level = F.min(F.when(within, F.struct(F.col("limit") / F.col("w"), "rank", "level"))).over(everything)["level"]
    return rest.select("source", "source_size", "rank", F.least("limit", level * F.col("w")).alias("target"))


def plan_mixture(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Every row of ``docs`` with ``mix_``: size, source_size, rank, target, before, copies, taken.

    ``mix_before`` is the number of the source's words ahead of the row in the order of
    md5(id), then id, size and a hash of the text. Sources are cut into ranges of that hash so that a large
    one is not ordered in one task; range totals give the start of each range.
    Null texts and texts without words have size 0 and are taken 0 words; a null source is a
    source of its own; rows with the same id are separate rows; an empty table stays empty.
    """
    keyed = docs.withColumn("mix_size", word_count(text_col)).withColumn(
        "mix_hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    ).withColumn("mix_tie", F.xxhash64(text_col))
    sizes = keyed.groupBy(F.col(source_col).alias("source")).agg(
        F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    largest = sizes.agg(F.max("rows")).first()[0] or 0
    digits = 1
    while 16**digits * range_rows < 4 * largest and digits < 8:
        digits += 1
    keyed = keyed.withColumn("mix_range", F.substring("mix_hash", 1, digits))
    targets = source_targets(sizes.drop("rows"), weights, most).select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"),
        F.col("rank").alias("mix_rank"), F.col("target").alias("mix_target"),
    )
    totals = keyed.groupBy(F.col(source_col).alias("mix_source"), F.col("mix_range").alias("mix_part")).agg(
        F.sum("mix_size").alias("n")
    )
    earlier = Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "mix_source", "mix_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("mix_start")
    ).alias("s")
    known = starts.join(targets.alias("t"), F.col("s.mix_source").eqNullSafe(F.col("t.mix_source"))).select(
        "s.*", "mix_source_size", "mix_rank", "mix_target"
    )
    inside = (
        Window.partitionBy(source_col, "mix_range")
        .orderBy("mix_hash", id_col, "mix_size", "mix_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ordered = keyed.withColumn("mix_inner", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    placed = ordered.join(
        known, F.col(source_col).eqNullSafe(F.col("mix_source")) & (F.col("mix_range") == F.col("mix_part"))
    ).withColumn("mix_before", F.col("mix_start") + F.col("mix_inner"))
    full = F.least(F.lit(most), F.floor(F.col("mix_target") / F.nullif(F.col("mix_source_size"), F.lit(0))))
    left = F.col("mix_target") - full * F.col("mix_source_size")
    extra = (full < most) & (F.col("mix_before") + F.col("mix_size") / 2 <= left)
    copies = F.when(F.col("mix_size") == 0, F.lit(0)).otherwise(full + extra.cast("int"))
    return (
        placed.withColumn("mix_copies", copies.cast("int"))
        .withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
        .drop("mix_source", "mix_part", "mix_start", "mix_inner", "mix_hash", "mix_tie", "mix_range")
    )


def _inverse(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the normalised integral of the schedule reaches ``share``."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, done = sum(areas), 0.0
    out = F.lit(1.0)
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        need = share * total - done
        slope = (w1 - w0) / (t1 - t0)
        # Root of w0 x + slope x^2 / 2 = need that also holds for slope 0.
        root = 2 * need / F.nullif(w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)), F.lit(0.0))
        pieces.append(((done + area) / total, t0 + root))
        done += area
    for limit, value in reversed(pieces):
        out = F.when(share <= limit, value).otherwise(out)
    return out


def with_places(planned: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """Every row of ``planned`` with ``mix_positions``: the training position (0 to 1) of each of its copies."""
    kind = F.col("mix_rank") % len(schedules)

    def place(copy: Column) -> Column:
        ahead = copy * F.col("mix_source_size") + F.col("mix_before") + F.col("mix_size") / 2
        share = F.least(F.lit(1.0), ahead / F.nullif(F.col("mix_target"), F.lit(0.0)))
        position = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            position = F.when(kind == k, _inverse(share, knots)).otherwise(position)
        return position

    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.col("mix_copies") - 1)).otherwise(F.array().cast("array<int>"))
    return planned.withColumn("mix_positions", F.transform(copies, place))


def with_positions(planned: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per taken copy, with ``mix_copy`` (from 0) and ``mix_position`` (0 to 1)."""
    placed = with_places(planned, schedules)
    return placed.select(*planned.columns, F.posexplode("mix_positions").alias("mix_copy", "mix_position"))


def training_order(planned: DataFrame, schedules: tuple = SCHEDULES, id_col: str = "doc_id") -> DataFrame:
    """Copies in training order, range-sorted by position; ties by id, source and place in the source."""
    return with_positions(planned, schedules).sort("mix_position", id_col, "mix_rank", "mix_before", "mix_copy")


def documents_in_order(planned: DataFrame, schedules: tuple = SCHEDULES, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``planned`` with the positions of its copies, range-sorted by the first; rows not taken come last."""
    first = F.get("mix_positions", F.lit(0))
    return with_places(planned, schedules).sort(first.asc_nulls_last(), id_col, "mix_rank", "mix_before", "mix_size")
