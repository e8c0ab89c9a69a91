"""Exact Jaccard join of sets of word n-grams, and the groups its links form.

Two sets link when 100 * |intersection| >= share * |union|. Links are found by partitioning
the universe of n-grams:

1. *Size bands.* Partners of a set have nearly its size. In a band, H bounds the symmetric
   difference of any linked pair. A set is looked at in its own band, and in a lower one where
   it can be the larger partner.
2. *Segments.* A hash deals the n-grams of a band out to m = H + 1 + Z segments. At most H
   segments of a linked pair differ, so at least Z + 1 are equal: the part of the set in each
   segment is hashed to a key. Up to Z segments of a set can be left out at no loss.
3. *Stars.* In each group of sets with one key, the smallest is paired with every other one.
   Of its pairs, a set is first verified against the smallest it shares most keys with; what then still
   joins different components is verified after that. Copies and near copies so collapse without all
   their pairs. What is left are keys whose sets lie in several components.
4. *Rest.* Of those, keys with few components and few partners a set are paired across components. Keys with many
   (common passages) and empty segments are too dear: a set leaves them out. Where it leaves
   out more than Z, it is indexed by the *one-deletion neighbourhoods* of its other segments:
   two sets that share a left-out segments (a > Z) and no other one differ by exactly one
   n-gram in all other segments but a - Z - 1, so one's segment is a neighbour of the other's.
   This holds while two sets together leave out fewer than m + Z + 1 segments. Sets that leave
   out over half of that are little more than a common passage. They are compared by their
   *rarest* n-grams: two linked sets agree in one that is among the few rarest of both, at
   places that leave room for the overlap they need.

Every candidate pair passes a lossless test of size and of parity bits inside the join that
makes it, and is then verified on the sets, in rounds that bound the data on its way. Parity bits: n-grams are dealt to PARITY buckets; a
bucket in which one set has an odd and the other an even number holds a differing n-gram.

N-grams are compared by 64-bit hash, and equal sets are found by a 64-bit hash of the set.
Null and empty texts and texts without words have the empty set, which links with nothing;
a text with fewer than n words is one n-gram. Repeated rows stay rows of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelab.llm.batches import bound_batches, release
from pipelab.llm.components import EDGES_A_PART, connected_components, cut_and_clear

#: Ratio of the sizes at the ends of a band.
BAND = 1.5
#: Keys with sets of more components than this are left out in favour of one-deletion neighbourhoods.
DEAR = 32
#: So are keys under which a set has, on average, more partners in other components than this.
PARTNERS = 1_000
#: In a chunk of rows, keys of more sets than this are grouped chunk by chunk first.
HOT_IN_CHUNK = 64
CHUNK_ROWS = 2048
#: Nodes whose texts are fetched with a broadcast at most; above it the join shuffles. Keys a row holds count as rows.
BROADCAST_ROWS = 500_000
#: Nodes in one part of their list. A short list in many parts would make many nearly empty tasks in every step that reads it.
NODES_A_PART = 50_000
#: N-grams sent along with pairs in one round of verification, as a share of those of all sets.
ROUND = 0.5
#: Rounds of verification after which garbage is collected, as after the last.
COLLECT_ROUNDS = 4
#: Buckets of the parity bits, 64 to a column.
PARITY = 512
_WORDS = [f"p{k}" for k in range(PARITY // 64)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_hash = xxhash.xxh3_64_intdigest


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of lower-cased (A-Z) words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash, words), np.uint64, len(words))
    size = min(n, len(w))
    count = len(w) - size + 1
    acc = np.full(count, size, np.uint64)
    for k in range(size):
        acc = (acc ^ (acc >> np.uint64(31))) * _STEP + w[k : k + count]
    return np.unique(_mix(acc))


def set_id(grams: np.ndarray) -> int:
    return int(_mix(np.array([_mix(grams ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0].astype(np.int64))


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """Bit of each bucket: whether an odd number of n-grams lies in it."""
    odd = np.bincount((grams >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def difference_bound(total: int, share: int) -> int:
    """Largest symmetric difference of a linked pair whose sizes add up to ``total``."""
    return total * (100 - share) // (100 + share)


@lru_cache(maxsize=16)
def bands(share: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(lowest size, highest size, segments m, slack Z, seed) of every band that can hold links of unequal sets."""
    out, low = [], 1
    while difference_bound(low + low * 100 // share, share) == 0:
        low += 1
    while low < 1 << 40:
        high = max(low, int(low * BAND) - 1)
        h = difference_bound(high + high * 100 // share, share)
        empty = (h + 1) * float(np.exp(-low / (h + 1)))
        slack = int(np.ceil(empty + 2.5 * empty**0.5))
        out.append((low, high, h + 1 + slack, slack, len(out) + 1))
        low = high + 1
    return tuple(out)


def bands_of(size: int, share: int) -> list[tuple[int, int, int, int, int]]:
    """The bands a set of ``size`` is looked at in: its own, and lower ones with smaller partners."""
    least = -(-size * share // 100)
    return [b for b in bands(share) if b[0] <= size and b[1] >= least]


def segments(grams: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one band: mixed n-grams, their segments, and the sum and the size of each segment."""
    mixed = _mix(grams + np.uint64(seed * int(_STEP) % (1 << 64)))
    place = ((mixed >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, place, mixed)
    return mixed, place, sums, np.bincount(place, minlength=m)


def segment_keys(sums: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    return _mix(sums + (places.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(0xD6E8FEB86659FD93))


def _texts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = 512) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield tuple(part.column(c).to_pylist() for c in columns)
    release()


def _members(n: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tags in _texts(batches, ("id", "text", "tag")):
            sizes, nodes, parity, spare = [], [], [], []
            for text in texts:
                grams = ngram_set(text, n)
                sizes.append(len(grams))
                nodes.append(set_id(grams))
                parity.append(parity_bits(grams))
                spare.append(any((segments(grams, m, seed)[3] == 0).sum() > slack for _, _, m, slack, seed in bands_of(len(grams), share)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(spare, pa.bool_()),
                 *map(pa.array, np.stack(parity).T.copy() if parity else np.zeros((len(_WORDS), 0), np.int64))],
                ["doc_id", "tag", "n", "node", "sparse", *_WORDS],
            )

    return run


def _index(n: int, share: int):
    def flush(keys: list[np.ndarray], nodes: list[int], salt: int) -> pa.RecordBatch:
        key = np.concatenate(keys)
        node = np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.append(starts, len(key)))
        hot = np.repeat(runs > HOT_IN_CHUNK, runs)
        leads = starts[runs > HOT_IN_CHUNK]  # the smallest node stands for the chunk
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key, key[leads]]).view(np.int64)),
                pa.array(np.concatenate([np.where(hot, salt, 0), np.zeros(len(leads), np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([node, node[leads]])),
            ],
            ["key", "salt", "node"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() * 997 % (1 << 24) * 64 + 1
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        rows = 0
        for (texts,) in _texts(batches, ("text",)):
            for text in texts:
                rows += 1
                grams = ngram_set(text, n)
                node = set_id(grams)
                if node in seen:
                    continue
                seen.add(node)
                own = []
                for _, _, m, _, seed in bands_of(len(grams), share):
                    _, _, sums, sizes = segments(grams, m, seed)
                    some = np.flatnonzero(sizes)
                    own.append(segment_keys(sums[some], some, seed))
                if own:
                    keys.append(np.concatenate(own))
                    nodes.append(node)
            if rows >= CHUNK_ROWS and keys:
                yield flush(keys, nodes, salt)
                keys, nodes, seen, rows, salt = [], [], set(), 0, salt + 1
        if keys:
            yield flush(keys, nodes, salt)

    return run


def _gram_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                nodes, sets = [], []
                for node, text in zip(part["node"], part["text"]):
                    grams = ngram_set(text, n)
                    if node not in seen and set_id(grams) == node:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(grams.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])
        release()

    return run


def _bounded(df: DataFrame, rows: int = BROADCAST_ROWS, held: Column | None = None) -> DataFrame:
    """Sent to all executors if it has at most so many rows, and values ``held`` in them."""
    weight = F.lit(1) if held is None else held + 1
    total = df.limit(rows + 1).agg(F.sum(weight)).first()[0]
    return F.broadcast(df) if (total or 0) <= rows else df


def _collect_garbage(df: DataFrame) -> None:
    """Let Spark's cleaner drop the checkpoints and broadcasts that nothing refers to.

    The driver's collector tells the cleaner of them; by itself it runs too seldom
    (``spark.cleaner.periodicGC.interval`` is half an hour), and many large ones would pile up. A full collection
    stops the driver, and several close together make its heap grow, so there is none after each result.
    """
    df.sparkSession.sparkContext._jvm.System.gc()


def _likely(x: str, y: str, share: int) -> Column:
    """Size and parity of two sets, in columns with these prefixes, allow a link."""
    total = F.col(f"{x}n") + F.col(f"{y}n")
    apart = sum((F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))) for w in _WORDS[1:]), F.bit_count(F.col(f"{x}p0").bitwiseXOR(F.col(f"{y}p0"))))
    return (F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * share) & (apart * (100 + share) <= total * (100 - share))


def _named(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """All columns but ``key`` with a prefix."""
    return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key])


def _neighbourhoods(share: int):
    """Keys of sets that leave out segments: E light segments, D one-deletion neighbours. K: the set leaves out most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                lists = rows.column("grams")
                flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                part = rows.select(["node", "dear"]).to_pydict()
                out_node, out_kind, out_key = [], [], []

                def put(node: int, kind: str, keys: np.ndarray) -> None:
                    out_node.append(np.full(len(keys), node, np.int64))
                    out_kind.extend(kind * len(keys))
                    out_key.append(keys.view(np.int64))

                for k, (node, dear) in enumerate(zip(part["node"], part["dear"])):
                    grams = flat[ends[k] : ends[k + 1]].view(np.uint64)
                    costly = np.array(dear or [], np.int64).view(np.uint64)
                    for _, _, m, slack, seed in bands_of(len(grams), share):
                        mixed, place, sums, sizes = segments(grams, m, seed)
                        keys = segment_keys(sums, np.arange(m), seed)
                        is_dear = np.isin(keys, costly) & (sizes > 0)
                        out = is_dear | (sizes == 0)
                        if out.sum() <= slack:
                            continue
                        if 2 * out.sum() > m + slack:
                            put(node, "K", keys[:1])
                        light = np.flatnonzero(~out)
                        put(node, "E", keys[light])
                        ok = ~out[place] & (sizes[place] > 1)
                        put(node, "D", segment_keys(sums[place[ok]] - mixed[ok], place[ok], seed))
                if out_node:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out_node)), pa.array(out_kind, pa.string()), pa.array(np.concatenate(out_key))],
                        ["node", "kind", "key"],
                    )

    return run


def _by_rarest(sets: DataFrame, facts: DataFrame, share: int) -> DataFrame:
    """Pairs of nodes of different components that agree in one of the rarest n-grams of both.

    ``facts`` (node, component, most, n, parity) names the nodes; one of a pair has ``most`` set. In order
    of frequency, the first n-gram two linked sets share is early in both: the overlap they
    need must still fit behind it.
    """
    # Partners are of nearly one size: nodes without a set of that kind near their size are left out.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / share)))
    steps = [r[0] for r in facts.filter("most").select(step).distinct().collect()]  # few: a logarithm of the largest size
    near = sorted({s + d for s in steps for d in (-1, 0, 1)})
    if not near:
        return facts.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    facts = facts.filter(step.isin(near))
    own = sets.join(_bounded(facts.select("node")), "node", "left_semi").dropDuplicates(["node"])
    grams = own.select("node", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").count()
    rank = F.row_number().over(Window.partitionBy("node").orderBy("count", "gram"))
    placed = cut_and_clear(grams.join(often, "gram").withColumn("place", rank)).join(facts, "node")
    n = F.col("n")
    columns = ("node", "n", "place", "component", "most", *_WORDS)
    ceil = lambda x, y: F.expr(f"-(-({x}) div ({y}))")
    low = placed.filter(F.col("place") <= n - ceil(f"{2 * share} * n", str(100 + share)) + 1)
    high = placed.filter(F.col("place") <= n - ceil(f"{share} * n", "100") + 1)
    x, y = _named(low.select("gram", *columns), "x_", "gram"), _named(high.select("gram", *columns), "y_", "gram")
    fits = (
        (F.struct("x_n", "x_node") < F.struct("y_n", "y_node"))
        & _likely("x_", "y_", share)
        & (F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) + 1 >= ceil(f"{share} * (x_n + y_n)", str(100 + share)))
        & (F.col("x_component") != F.col("y_component"))
        & (F.col("x_most") | F.col("y_most"))
    )
    return x.join(y, (x["gram"] == y["gram"]) & fits).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _across(left: DataFrame, right: DataFrame, share: int) -> DataFrame:
    """Likely pairs of nodes of different components with one key; both sides have node, component, n, parity."""
    x, y = _named(left, "x_", "key"), _named(right, "y_", "key")
    fits = (F.col("x_component") != F.col("y_component")) & _likely("x_", "y_", share)
    return x.join(y, (x["key"] == y["key"]) & fits).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def jaccard_components(
    docs: DataFrame, n: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id reachable by links, the own one included. Rows with
    the same set are one node from the start. Other columns of ``docs`` are not read. With ``tag``,
    a whole number that tells rows of one id apart, ``tag`` and ``component`` follow: a number of the component, null where the set is empty.
    """
    bound_batches(docs.sparkSession)
    mark = F.lit(None) if tag is None else tag
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark.cast("long").alias("tag"))
    members = cut_and_clear(rows.mapInArrow(_members(n, share), "doc_id long, tag long, n long, node long, sparse boolean, " + ", ".join(f"{w} long" for w in _WORDS)))
    nodes = cut_and_clear(members.groupBy("node").agg(
        F.min("doc_id").alias("first_doc"), F.max("n").alias("n"), F.max("sparse").alias("sparse"), *[F.max(w).alias(w) for w in _WORDS]
    ))
    held, count = nodes.agg(F.sum("n"), F.count(F.lit(1))).first()
    grams_held = max(1, held or 0)
    nodes = nodes.coalesce(1 + count // NODES_A_PART)
    group = Window.partitionBy("key", "salt")
    shared = cut_and_clear(
        rows.select("text").mapInArrow(_index(n, share), "key long, salt int, node long")
        .withColumns({"lead": F.min("node").over(group), "last": F.max("node").over(group)})
        .filter("lead < last")
        .dropDuplicates(["key", "salt", "node"])
        .select("key", "node", "lead")
    )
    wanted = shared.select("node").distinct().unionByName(nodes.filter("sparse").select("node")).distinct()
    wanted = cut_and_clear(wanted.join(nodes.select("node", "first_doc"), "node"))
    fetched = rows.join(_bounded(wanted), rows["id"].eqNullSafe(wanted["first_doc"])).select("node", "text")
    sets = cut_and_clear(fetched.mapInArrow(_gram_rows(n), "node long, grams array<bigint>"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs that link. Verified in rounds, so that the sets on their way stay a share of all, however many pairs there are."""
        pairs = cut_and_clear(pairs.distinct())
        count, sent = pairs.join(nodes.select(F.col("node").alias("a"), "n"), "a").agg(F.count(F.lit(1)), F.sum("n")).first()
        parts = 1 + count // EDGES_A_PART
        pairs = pairs.coalesce(parts)
        rounds = 1 + int((sent or 0) / (ROUND * grams_held))
        found = []
        for k in range(rounds):
            found.append(verified(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)))
            if k + 1 == rounds or k % COLLECT_ROUNDS == COLLECT_ROUNDS - 1:
                _collect_garbage(pairs)
        return reduce(DataFrame.unionByName, found).coalesce(parts)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = sets.join(_bounded(ends), "node", "left_semi").dropDuplicates(["node"])
        both = pairs.join(own.withColumnsRenamed({"node": "a", "grams": "g1"}), "a").join(own.withColumnsRenamed({"node": "b", "grams": "g2"}), "b")
        shared_grams = F.size(F.array_intersect("g1", "g2"))
        union = F.size("g1") + F.size("g2") - shared_grams
        return cut_and_clear(both.filter(shared_grams.cast("long") * 100 >= union.cast("long") * share).select("a", "b"))

    def tie(components: DataFrame, to: DataFrame, end: str = "node", out: str = "component") -> DataFrame:
        names = components.select(F.col("node").alias(end), F.col("component").alias(out))
        return to.join(names, end, "left").withColumn(out, F.coalesce(out, end))

    def joined(components: DataFrame, links: DataFrame) -> DataFrame:
        known = components.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        return connected_components(known.unionByName(links))

    facts = nodes.select("node", "n", *_WORDS)
    arms = shared.filter("node > lead").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    arms = arms.join(_named(facts.withColumnRenamed("node", "a"), "x_", "a"), "a").join(_named(facts.withColumnRenamed("node", "b"), "y_", "b"), "b")
    arms = cut_and_clear(arms.filter(_likely("x_", "y_", share)).select("a", "b", "keys"))
    nearest = arms.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a"))
    components = connected_components(linked(nearest.select("a", "b")))
    others = tie(components, tie(components, arms.select("a", "b"), "a", "x"), "b", "y").filter("x <> y")
    more = linked(others.select("a", "b"))
    if not more.isEmpty():
        components = joined(components, more)
    tied = cut_and_clear(tie(components, shared.select("key", "node")).distinct())
    sizes = tied.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
    spread = cut_and_clear(
        sizes.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum("c").alias("sets"), F.sum(F.col("c") * F.col("c")).alias("own"))
        .filter("count > 1").withColumn("dear", (F.col("count") > DEAR) | ((F.col("sets") - F.col("own") / F.col("sets")) > PARTNERS))
        .select("key", "dear")
    )
    dear = spread.filter("dear")
    left_out = tied.join(dear.select("key"), "key", "left_semi").groupBy("node").agg(F.collect_set("key").alias("dear"))
    thin = nodes.filter("sparse").select("node", F.lit(None).cast("array<bigint>").alias("dear"))
    left_out = cut_and_clear(left_out.unionByName(thin.join(left_out.select("node"), "node", "left_anti")))
    around = cut_and_clear(
        sets.join(_bounded(left_out, held=F.coalesce(F.size("dear"), F.lit(0))), "node").select("node", "grams", "dear")
        .mapInArrow(_neighbourhoods(share), "node long, kind string, key long")
    )
    leaving = around.groupBy("node").agg(F.max(F.col("kind") == "K").alias("most"))
    leaving = cut_and_clear(tie(components, leaving).join(facts, "node"))
    light = spread.filter(~F.col("dear"))
    few = tied.join(light.select("key"), "key", "left_semi").join(facts, "node")
    told = around.filter("kind <> 'K'").select("key", "node", "kind").distinct().join(leaving.drop("most"), "node")
    # One kind of candidates after the other, so that the shuffles of each go before the next.
    rest = [
        cut_and_clear(_across(few, few, share).distinct()),
        cut_and_clear(_across(told.filter("kind = 'E'").drop("kind"), told.filter("kind = 'D'").drop("kind"), share).distinct()),
        cut_and_clear(_by_rarest(sets, leaving, share)),
    ]
    late = linked(reduce(DataFrame.unionByName, rest))
    if not late.isEmpty():
        components = joined(components, late)
    placed = members.select("doc_id", "tag", "n", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("doc_id").alias("low"))
    some = F.col("n") > 0
    return placed.join(lowest, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"),
        *([] if tag is None else ["tag", F.when(some, F.col("component")).alias("component")]),
    )
