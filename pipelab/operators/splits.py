"""Repeatable hold-outs and folds.

A row's place in the shuffle is the md5 of its id and the seed. Only the cut points
are looked up (counts per hash range, then a rank inside the one range that holds a
cut; a range that is too large to rank is counted by a longer prefix first, it alone), so
the rows themselves are labelled in a narrow pass without any shuffle. Contiguous folds bracket
their cut points by samples of whole order keys, closer and closer, until few rows are left to rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelab.functions.numeric import hash_key, join_on, small_side
from pipelab.operators.ordering import HOT_ROWS

MAX_LOCAL_STRATA = 10_000
_HASH_DIGITS = 4  # 65,536 hash ranges per stratum, and as many parts of one that holds a cut
_KEY_DIGITS = 32
#: Order keys that are sampled between two brackets at most.
SAMPLED = 20_000


def _placed(df: DataFrame, strata: list[str], bucket: str) -> DataFrame:
    """Rows per hash range, and rows of the stratum in the ranges before it."""
    counts = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def _borders(aimed: DataFrame, strata: list[str], bucket: str) -> DataFrame:
    """Where each cut falls: (strata..., range, cut_rank, within, times).

    A rank of 0 comes with the first range and ``within`` 0.
    """
    hit = "cut_rank > __below AND cut_rank <= __below + __n OR cut_rank = 0 AND __below = 0"
    found = aimed.filter(hit).select(*strata, bucket, "__n", "cut_rank", (F.col("cut_rank") - F.col("__below")).alias("__within"))
    # equal borders are empty blocks: looked up once, counted each time
    return found.groupBy(*strata, bucket, "__n", "cut_rank", "__within").agg(F.count(F.lit(1)).cast("int").alias("times"))


def _narrowed(df: DataFrame, strata: list[str], bucket: str, borders: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows and borders with hash ranges so short that those with a border have at most ``most`` rows.

    Only ranges that hold a border are counted again, by a longer prefix. Rows of equal hash stay together.
    """
    digits = _HASH_DIGITS
    while digits < _KEY_DIGITS:
        largest = borders.filter("__within > 0").agg(F.max("__n")).first()[0]
        if largest is None or largest <= most:
            break
        digits = min(_KEY_DIGITS, digits + _HASH_DIGITS)
        cuts = borders.filter("__within > 0")
        ranges = cuts.select(*strata, bucket).distinct()
        near = join_on(df.select(*strata, bucket, "__key"), small_side(ranges), [*strata, bucket], "left_semi", null_safe=True)
        counts = near.groupBy(*strata, bucket, F.substring("__key", 1, digits).alias("__part")).agg(F.count(F.lit(1)).alias("__m"))
        before = Window.partitionBy(*strata, bucket).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("__below", F.coalesce(F.sum("__m").over(before), F.lit(0)))
        held = join_on(cuts.drop("__n"), placed, [*strata, bucket], null_safe=True).filter("__within > __below AND __within <= __below + __m")
        finer = held.select(*strata, F.col("__part").alias(bucket), F.col("__m").alias("__n"), "cut_rank", (F.col("__within") - F.col("__below")).alias("__within"), "times")
        borders = small_side(finer.unionByName(borders.filter("__within = 0")))
        df = df.withColumn(bucket, F.substring("__key", 1, digits))
    return df, borders


def _cut_rows(df: DataFrame, strata: list[str], bucket: str, order: list[str], borders: DataFrame) -> DataFrame:
    """The row at each border: (strata..., at, times). Only ranges that hold a border are
    ranked, once each."""
    cuts = borders.filter("__within > 0")
    ranges = cuts.select(*strata, bucket).distinct()
    near = join_on(df.select(*strata, bucket, *order), ranges, [*strata, bucket], "left_semi", null_safe=True)
    placed = near.withColumn("__within", F.row_number().over(Window.partitionBy(*strata, bucket).orderBy(*order)).cast("bigint"))
    picked = join_on(placed, cuts.select(*strata, bucket, "__within", "times"), [*strata, bucket, "__within"], null_safe=True)
    return picked.select(*strata, F.struct(*order).alias("at"), "times")


def _blocks_passed(order: list[str], cuts: Column, borders: int) -> Column:
    """How many blocks end before this row; ``cuts`` holds up to ``borders`` (row, times)
    structs. One comparison per border, so the expression stays in generated code."""
    here = F.struct(*order)
    passed = F.lit(0)
    for i in range(borders):
        cut = F.get(cuts, F.lit(i))
        passed = passed + F.when(cut["at"] < here, cut["times"]).otherwise(0)
    return passed


def _label_strata(
    df: DataFrame, strata: list[str], bucket: str, order: list[str], targets: Callable[[DataFrame], DataFrame], out: str, borders: int, most: int
) -> DataFrame:
    """Number the block of each row inside its stratum.

    ``targets`` turns (strata..., n) into (strata..., cut_rank): the rank of the last row
    of each of the ``borders`` inner blocks. Sizes and ranges come out of one pass.
    """
    placed = _placed(df, strata, bucket)
    sizes = placed.groupBy(*strata).agg(F.sum("__n").alias("n"))
    aimed = join_on(placed, targets(sizes), strata, null_safe=True)
    ranged, found = _narrowed(df, strata, bucket, small_side(_borders(aimed, strata, bucket)), most)
    cuts = _cut_rows(ranged, strata, bucket, order, found).groupBy(*strata).agg(F.collect_list(F.struct("at", "times")).alias("__cuts"))
    empty = found.groupBy(*strata).agg(F.sum(F.when(F.col("__within") == 0, F.col("times")).otherwise(0)).alias("__empty"))
    lookup = small_side(join_on(empty, cuts, strata, "left", null_safe=True), MAX_LOCAL_STRATA)
    passed = _blocks_passed(order, F.col("__cuts"), borders)
    return (
        join_on(df, lookup, strata, "left", null_safe=True)
        .withColumn(out, (passed + F.coalesce("__empty", F.lit(0))).cast("int"))
        .drop("__empty", "__cuts")
    )


def _label_all(df: DataFrame, order: list[str], rows: list, empty: int, out: str) -> DataFrame:
    """Number the block of each row among all rows; ``rows`` hold the last row of a block (``at``) and how many blocks end there."""
    if not rows:
        return df.withColumn(out, F.lit(empty).cast("int"))
    cuts = F.array(*[F.struct(_literal(df, order, r["at"]).alias("at"), F.lit(r["times"]).alias("times")) for r in rows])
    return df.withColumn(out, (_blocks_passed(order, cuts, len(rows)) + empty).cast("int"))


def _literal(df: DataFrame, order: list[str], key) -> Column:
    return F.struct(*[F.lit(key[c]).cast(df.schema[c].dataType).alias(c) for c in order])


def _hashed_rows(df: DataFrame, bucket: str, order: list[str], ranks: list[int], most: int) -> list:
    aimed = _placed(df, [], bucket).withColumn("cut_rank", F.explode(F.array(*[F.lit(r) for r in ranks]).cast("array<bigint>")))
    ranged, found = _narrowed(df, [], bucket, small_side(_borders(aimed, [], bucket)), most)  # at most one row per rank
    return _cut_rows(ranged, [], bucket, order, found).collect()


def _segment(df: DataFrame, order: list[str], brackets: list[tuple]) -> Column:
    """Between brackets (pairs of order keys, None: no end) segments are even, inside one odd; both ends are inside."""
    here, out = F.struct(*order), F.lit(2 * len(brackets))
    for k, (low, high) in reversed(list(enumerate(brackets))):
        if high is not None:
            out = F.when(here > _literal(df, order, high), out)
        out = F.when(F.lit(True), 2 * k + 1) if high is None else out.otherwise(2 * k + 1)
        if low is not None:
            out = F.when(here < _literal(df, order, low), 2 * k).otherwise(out)
    return out


def key_rows(df: DataFrame, order: list[str], ranks: list[int], total: int, most: int, sampled: int = SAMPLED) -> list:
    """The rows (order columns) at these ranks, from 1, in the order of all ``order`` columns: (at, times), and no row for a rank of 0.

    Samples of whole keys bracket every rank; rows between and inside the brackets are counted,
    and the brackets are sampled again until at most ``most`` rows lie in one, which are ranked. Rows of equal keys
    cannot be told apart and end one bracket.
    """
    wanted = sorted({r for r in ranks if r > 0})
    if not wanted:
        return []
    narrow = df.select(*order)
    brackets, sizes = [(None, None)], [total]  # in order and disjoint
    belows = [0]
    home = {r: 0 for r in wanted}
    while max(sizes) > most:
        share = min(1.0, sampled * len(brackets) / sum(sizes))
        inside = narrow.withColumn("__segment", _segment(df, order, brackets)).filter("__segment % 2 = 1")
        drawn = inside.sample(share, seed=len(brackets) + sum(sizes) % 9973).orderBy("__segment", F.struct(*order)).collect()
        cuts = []  # (bracket, first and last place in its sample)
        samples = {k: [r for r in drawn if r["__segment"] == 2 * k + 1] for k in range(len(brackets))}
        for r in wanted:
            k = home[r]
            m = len(samples[k])
            place, slack = (r - 1 - belows[k]) / sizes[k] * m, 5 * m**0.5 + 2
            low, high = int(place - slack), int(place + slack) + 1
            if cuts and cuts[-1][0] == k and low <= cuts[-1][2]:
                cuts[-1] = (k, cuts[-1][1], max(cuts[-1][2], high))
            else:
                cuts.append((k, low, high))
        closer = [
            (samples[k][a] if a > 0 else brackets[k][0], samples[k][b] if b < len(samples[k]) else brackets[k][1]) for k, a, b in cuts
        ]
        counts = dict(narrow.groupBy(_segment(df, order, closer).alias("s")).count().collect())
        spans, upto = [], 0  # segments with rows before them
        for s in range(2 * len(closer) + 1):
            spans.append((upto, counts.get(s, 0)))
            upto += counts.get(s, 0)
        used: dict[int, tuple] = {}
        held = {}
        for r in wanted:
            s = next(i for i, (before, n) in enumerate(spans) if before < r <= before + n)
            k = s // 2
            # a rank that was missed is looked for in the gap it lies in, ends included
            used[s] = closer[k] if s % 2 else (closer[k - 1][1] if k else None, closer[k][0] if k < len(closer) else None)
            held[r] = s
        order_of = {s: n for n, s in enumerate(sorted(used))}
        if all(s % 2 for s in used):
            fresh = ([used[s] for s in sorted(used)], [spans[s][1] for s in sorted(used)], [spans[s][0] for s in sorted(used)])
        else:  # gaps share their ends with brackets: one bracket around all of it, counted anew
            whole = (used[min(used)][0], used[max(used)][1])
            again = dict(narrow.groupBy(_segment(df, order, [whole]).alias("s")).count().collect())
            fresh, order_of = ([whole], [again.get(1, 0)], [again.get(0, 0)]), dict.fromkeys(used, 0)
        if fresh[1] == sizes and fresh[2] == belows:
            if max(sizes) == sum(sizes) and sampled >= sum(sizes) or all(a is not None and a == b for a, b in fresh[0]):
                break  # rows of one key
            sampled *= 4
        brackets, sizes, belows = fresh
        home = {r: order_of[s] for r, s in held.items()}
    within = Window.partitionBy("__segment").orderBy(*order)
    placed = narrow.withColumn("__segment", _segment(df, order, brackets)).filter("__segment % 2 = 1").withColumn("__nth", F.row_number().over(within))
    hits = " OR ".join(f"(__segment = {2 * home[r] + 1} AND __nth = {r - belows[home[r]]})" for r in wanted)
    found = {(q["__segment"], q["__nth"]): q for q in placed.filter(hits).collect()}
    return [{"at": found[2 * home[r] + 1, r - belows[home[r]]], "times": ranks.count(r)} for r in wanted]


def _shuffled(df: DataFrame, id_cols: list[str], seed: int) -> DataFrame:
    keyed = df.withColumn("__key", hash_key(seed, *id_cols))
    return keyed.withColumn("__range", F.substring("__key", 1, _HASH_DIGITS))  # hex sorts like its number


def holdout_quota(sizes: DataFrame, target: str, ratio: float) -> DataFrame:
    """Rows to hold out per class: ceil(ratio * total) shared in proportion.

    Largest remainders get the rows left over; ties go to the smaller class.
    """
    everything = Window.partitionBy(F.lit(1))  # one row per class
    total = F.sum("n").over(everything)
    held = F.ceil(F.lit(float(ratio)) * total).cast("bigint")
    wide = [c.cast("decimal(19,0)") for c in (F.col("n"), total, held)]  # n * held outgrows a bigint
    shares = sizes.select(target, *[c.alias(a) for c, a in zip(wide, ("n", "total", "held"))]).select(
        target,
        F.expr("(n * held) div total").alias("base"),
        F.expr("(n * held) % total").alias("rest"),
        F.col("held").cast("bigint").alias("held"),
    )
    by_rest = everything.orderBy(F.col("rest").desc(), F.col(target))
    left = F.col("held") - F.sum("base").over(everything)
    return shares.select(
        target,
        (F.col("base") + F.when(F.row_number().over(by_rest) <= left, 1).otherwise(0)).alias("cut_rank"),
    )


def stratified_split(
    df: DataFrame, target: str, id_cols: list[str], ratio: float = 0.2, seed: int = 42, out: str = "is_validation", most: int = HOT_ROWS
) -> DataFrame:
    """Mark ``ratio`` of every class for validation."""
    keyed = _shuffled(df, id_cols, seed)
    quota = lambda sizes: holdout_quota(sizes, target, ratio)
    block = _label_strata(keyed, [target], "__range", ["__key", *id_cols], quota, "__block", 1, most)
    return block.withColumn(out, F.col("__block") == 0).drop("__block", "__key", "__range")


def random_split(
    df: DataFrame, id_cols: list[str], ratio: float = 0.2, seed: int = 42, out: str = "is_validation", most: int = HOT_ROWS
) -> DataFrame:
    """Mark ``ratio`` of all rows for validation, without strata."""
    held = math.ceil(ratio * df.count())
    keyed = _shuffled(df, id_cols, seed)
    order = ["__key", *id_cols]
    block = _label_all(keyed, order, _hashed_rows(keyed, "__range", order, [held], most), int(held == 0), "__block")
    return block.withColumn(out, F.col("__block") == 0).drop("__block", "__key", "__range")


def _dealt(upto: Column, fold: Column, k: int) -> Column:
    """How many of the positions 0..upto-1 go to a fold when dealt round-robin."""
    return F.floor((upto - fold + (k - 1)) / k)


def fold_quota(sizes: DataFrame, target: str, k: int) -> DataFrame:
    """Rank of the last row of each fold but the last, per class."""
    before = Window.partitionBy(F.lit(1)).orderBy(target).rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    folds = spans.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 2))))
    first, fold = F.col("first"), F.col("f")
    dealt = folds.withColumn("size", _dealt(first + F.col("n"), fold, k) - _dealt(first, fold, k))
    upto = Window.partitionBy(target).orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.select(target, F.sum("size").over(upto).cast("bigint").alias("cut_rank"))


def stratified_kfold(
    df: DataFrame, target: str, id_cols: list[str], k: int = 5, seed: int = 42, out: str = "fold", most: int = HOT_ROWS
) -> DataFrame:
    """Shuffled folds with the same class mix; fold sizes differ by one row at most.

    Fold sizes per class come from dealing the class-sorted rows round-robin.
    """
    if k < 2:
        return df.withColumn(out, F.lit(0))
    keyed = _shuffled(df, id_cols, seed)
    deal = lambda sizes: fold_quota(sizes, target, k)
    return _label_strata(keyed, [target], "__range", ["__key", *id_cols], deal, out, k - 1, most).drop("__key", "__range")


def kfold(
    df: DataFrame, order_cols: list[str], k: int = 5, out: str = "fold", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Contiguous folds in row order; the first n mod k folds hold one row more."""
    total = df.count()
    base, extra = divmod(total, k)
    borders = [base * (i + 1) + min(i + 1, extra) for i in range(k - 1)]
    return _label_all(df, order_cols, key_rows(df, order_cols, borders, total, hot_rows), borders.count(0), out)
