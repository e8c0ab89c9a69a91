"""Clustering of integer vectors around centroids, with exact distances behind simplex bounds.

The distances of a vector to several pivots place it as the *apex* of a simplex over the
pivots: coordinates in the space that the pivots span, and a height above it. They are worked
out once and kept with the vector. For two apexes, the difference of the coordinates with the
difference of the heights is a lower bound of the true distance, with their sum an upper bound.
Centroids whose lower bound is above the least upper bound cannot be nearest; only the others
are compared, in exact integers. Bounds carry a slack above their rounding error, so the result
is that of comparing everything.

Vectors of another length, with a null or a number that is not finite, and null vectors are
left out. A null id is as the empty text where seeds are drawn; rows of one id are vectors of their own
(equal hashes: by the bytes of the vector). With fewer vectors than centroids there are as
many centroids as vectors; without any there is no row. A component above ``LARGEST`` after scaling is an error,
since distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelab.llm.batches import release
from pipelab.session import cut_lineage, scratch_path

CENTROIDS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
PIVOTS = 16
SEED = "2:"
LARGEST = 1 << 27
#: Share of the squared size of two apexes by which their squared bounds are widened. Pivots are chosen so that
#: rounding stays well below it.
SLACK = 1e-5
#: A pivot stands above the span of those before it by at least this share of the largest height, squared.
STEEP = 1e-2
_PAIRS = 1 << 16


def integer_vectors(vectors: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are kept, and their components as integers floor(scale * x)."""
    sized = pc.equal(pc.list_value_length(vectors), dimensions).fill_null(False)
    at = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    values = vectors.filter(sized).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    real = np.isfinite(values).all(axis=1)  # a null reads as nan
    floored = np.floor(values[real] * scale)
    if floored.size and np.abs(floored).max() > LARGEST:
        raise ValueError(f"a component is above {LARGEST} after scaling")
    return at[real], floored.astype(np.int32)


@dataclass(frozen=True)
class Simplex:
    """Pivots, and what turns squared distances to them into an apex."""

    pivots: np.ndarray  # pivots x dimensions, integers
    lengths: np.ndarray  # squared distance of every further pivot to the first
    inverse: np.ndarray  # of the lower triangle that holds the further pivots' own coordinates

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates over the pivots and the height, per vector."""
        squared = np.stack([_squared(vectors, p[None, :]) for p in self.pivots], axis=1).astype(np.float64)
        along = (squared[:, :1] + self.lengths[None, :] - squared[:, 1:]) / 2 @ self.inverse.T
        height = np.sqrt(np.maximum(0.0, squared[:, 0] - np.square(along).sum(axis=1)))
        return np.column_stack([along, height])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", apart, apart)


def build_simplex(candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
    """The first candidate, then always the one highest above the span of those taken."""
    first = candidates[0].astype(np.int64)
    ways = (candidates - first).astype(np.float64)
    rest, chosen, highest = ways.copy(), [], None
    while len(chosen) < most - 1:
        heights = np.square(rest).sum(axis=1)
        top = int(heights.argmax())
        highest = heights[top] if highest is None else highest
        if heights[top] <= STEEP * highest or heights[top] == 0:
            break
        chosen.append(top)
        unit = rest[top] / np.sqrt(heights[top])
        rest = rest - np.outer(rest @ unit, unit)
    base = ways[chosen]
    triangle = np.linalg.cholesky(base @ base.T) if chosen else np.zeros((0, 0))
    return Simplex(np.vstack([first[None, :], candidates[chosen].astype(np.int64)]), np.square(base).sum(axis=1), np.linalg.inv(triangle))


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), its squared distance, and how many pairs were compared exactly."""
    own, other = np.square(apexes).sum(axis=1)[:, None], np.square(centroid_apexes).sum(axis=1)[None, :]
    # sizes less the product of all coordinates but the height, which counts with either sign
    flat = own + other - 2 * apexes[:, :-1] @ centroid_apexes[:, :-1].T
    heights = 2 * np.outer(apexes[:, -1], centroid_apexes[:, -1])
    slack = SLACK * (own + other) + 1e-3
    possible = flat - heights - slack <= (flat + heights + slack).min(axis=1, keepdims=True)
    row, col = np.nonzero(possible)
    exact = np.concatenate([_squared(vectors[row[k : k + _PAIRS]], centroids[col[k : k + _PAIRS]]) for k in range(0, len(row), _PAIRS)] or [np.zeros(0, np.int64)])
    starts = np.searchsorted(row, np.arange(len(vectors)))
    least = np.minimum.reduceat(exact, starts) if len(vectors) else exact
    hit = np.flatnonzero(exact == least[row])
    return col[hit[np.searchsorted(row[hit], np.arange(len(vectors)))]], least, len(row)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of equally long values as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.dtype.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
    offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())])


def _prepared(dimensions: int, scale: int, simplex: Simplex | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ints = integer_vectors(batch.column("vector"), dimensions, scale)
            out = [batch.column("vec_id").take(pa.array(at)), _binary(ints)]
            if simplex is not None:
                out.append(_binary(simplex.apexes(ints)))
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "vector", "apex"][: len(out)])
        release()

    return run


def _assigned(batch: pa.RecordBatch, dimensions: int, simplex: Simplex, centroids: np.ndarray, apexes: np.ndarray):
    vectors = _matrix(batch.column("vector"), np.int32, dimensions)
    return vectors, *nearest(vectors, _matrix(batch.column("apex"), np.float64, len(simplex.pivots)), centroids, apexes)[:2]


def _summed(dimensions: int, simplex: Simplex, centroids: np.ndarray):
    """Component sums of the vectors of every centroid, and under ``dimensions`` their number; one row each and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apexes = simplex.apexes(centroids)
        sums = np.zeros((len(centroids), dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, cluster, _ = _assigned(batch, dimensions, simplex, centroids, apexes)
                order = np.argsort(cluster, kind="stable")
                at = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                sums[cluster[order][at], :-1] += np.add.reduceat(vectors[order].astype(np.int64), at, axis=0)
                sums[:, -1] += np.bincount(cluster, minlength=len(centroids))
        some = np.repeat(sums[:, -1] > 0, dimensions + 1)
        places = np.arange(sums.size)[some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places // (dimensions + 1), pa.int32()), pa.array(places % (dimensions + 1), pa.int32()), pa.array(sums.ravel()[some])],
            ["cluster", "component", "value"],
        )
        release()

    return run


def _labelled(dimensions: int, simplex: Simplex, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apexes = simplex.apexes(centroids)
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance = _assigned(batch, dimensions, simplex, centroids, apexes)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])
        release()

    return run


def _moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids replaced by floor(sum / count); ``sums`` has a row for every centroid and component."""
    table = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for r in sums:
        table[r["cluster"], r["component"]] = r["value"]
    held = table[:, -1:]
    return np.where(held > 0, table[:, :-1] // np.maximum(held, 1), centroids)


def cluster_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, pivots: int = PIVOTS, seed: str = SEED,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    First centroids are the vectors with the smallest sha256 of ``seed`` and id. Vectors and
    apexes are written once in the shared folder and read in every round; to the driver come centroids
    and their sums only (centroids x dimensions numbers).
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    kept = narrow.mapInArrow(_prepared(dimensions, scale, None), "vec_id long, vector binary")
    first = kept.orderBy(drawn, "vector").limit(centroids).collect()
    names = "vec_id long, cluster int, distance long"
    if not first:
        none = spark.createDataFrame([], f"{names}, cluster_inertia long, inertia long, centroid_sha256 string")
        return none
    middle = np.stack([np.frombuffer(r["vector"], np.int32) for r in first]).astype(np.int64)
    simplex = build_simplex(middle, pivots)
    store = scratch_path(spark, "vectors")
    narrow.mapInArrow(_prepared(dimensions, scale, simplex), "vec_id long, vector binary, apex binary").write.parquet(store)
    vectors = spark.read.schema("vec_id long, vector binary, apex binary").parquet(store)
    for _ in range(rounds):
        parts = vectors.select("vector", "apex").mapInArrow(_summed(dimensions, simplex, middle), "cluster int, component int, value long")
        middle = _moved(middle, parts.groupBy("cluster", "component").agg(F.sum("value").alias("value")).collect())
    placed = cut_lineage(vectors.mapInArrow(_labelled(dimensions, simplex, middle), names))
    held = placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()  # one row a centroid
    inertia = sum(r["n"] for r in held)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in middle]
    facts = spark.createDataFrame(
        [(r["cluster"], r["n"], inertia, digests[r["cluster"]]) for r in held], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
