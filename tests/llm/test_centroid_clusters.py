import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelab.llm import centroid_clusters as cc

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dim, seed="2:"):
    kept = [
        (d, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for d, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    byte = lambda v: np.array(v, np.int32).tobytes()
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), byte(r[1])))[:k]
    centres = [list(v) for _, v in first]

    def assign():
        out = []
        for d, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d, v, apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        held = assign()
        for c in range(len(centres)):
            own = [v for _, v, k2, _ in held if k2 == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    held = assign()
    inertia = sum(r[3] for r in held)
    each = {c: sum(r[3] for r in held if r[2] == c) for c in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((d, c, n, each[c], inertia, digest[c]) for d, _, c, n in held), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, dim=6, near=4):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(near)]
    return [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(hubs)]) for k in range(n)]


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_equals_brute_force(spark, pivots):
    rows = vectors(1, 300) + [
        (1000, None), (1001, []), (1002, [0.5] * 5), (1003, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (1004, [float("nan")] + [0.0] * 5),
        (1005, [float("inf")] + [0.0] * 5), (None, [0.3] * 6), (None, [0.31] * 6), (7, [0.2] * 6), (7, [0.2] * 6),
    ] + [(2000 + k, [0.25] * 6) for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("vector", F.lit(1)).withColumn("cluster", F.lit("c"))
    got = cc.cluster_vectors(df, centroids=9, rounds=5, dimensions=6, pivots=pivots)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert _rows(got) == brute(rows, 9, 5, 6)


def test_few_or_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.5] * 6), (2, [-0.5] * 6)], [(k, [0.1] * 6) for k in range(20)]):
        got = cc.cluster_vectors(spark.createDataFrame(rows, SCHEMA), centroids=9, dimensions=6)
        assert _rows(got) == brute(rows, 9, 5, 6)


def test_too_large_numbers_are_told(spark):
    with pytest.raises(Exception, match="after scaling"):
        cc.cluster_vectors(spark.createDataFrame([(1, [1e30] * 6)], SCHEMA), dimensions=6).collect()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    hubs = rng.integers(-200, 200, (30, 64))
    x = (hubs[rng.integers(0, 30, 2000)] + rng.normal(0, 20, (2000, 64))).astype(np.int64)
    centres = hubs.astype(np.int64)
    simplex = cc.build_simplex(centres, 16)
    a, c = simplex.apexes(x), simplex.apexes(centres)
    true = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    low, high = flat + (a[:, None, -1] - c[None, :, -1]) ** 2, flat + (a[:, None, -1] + c[None, :, -1]) ** 2
    assert (low <= true * (1 + 1e-6) + 1e-3).all() and (true <= high * (1 + 1e-6) + 1e-3).all()
    cluster, least, pairs = cc.nearest(x, a, centres, c)
    assert (cluster == true.argmin(axis=1)).all() and (least == true.min(axis=1)).all()
    assert pairs < true.size / 3


def test_ties_and_vectors_in_the_span_of_the_pivots():
    """Heights of 0 and equal distances are where rounding could turn a bound round."""
    rng = np.random.default_rng(6)
    base = rng.integers(-1000, 1000, (5, 16))
    centres = np.vstack([base, base[0] + base[1] - base[2], base[:2]]).astype(np.int64)
    x = np.vstack([centres, (centres[0] + centres[1]) // 2, 2 * centres[3] - centres[4], rng.integers(-1000, 1000, (50, 16))]).astype(np.int64)
    simplex = cc.build_simplex(centres, 16)
    cluster, least, _ = cc.nearest(x, simplex.apexes(x), centres, simplex.apexes(centres))
    true = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == true.argmin(axis=1)).all() and (least == true.min(axis=1)).all()
    assert cluster[6] == 0 and cluster[7] == 1
