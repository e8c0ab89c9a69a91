import random
from collections import defaultdict

import numpy as np
import pytest

from pipelab.llm import jaccard_join as jj
from pipelab.llm.components import connected_components


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, share):
    rows = [(d, shingles(t, n)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return sorted(
        ((d, len(s), min(low[find(i)], default=None) if s else d) for i, (d, s) in enumerate(rows)), key=str
    )


def compare(df, rows, n, share):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, n, share).collect()), key=str)
    assert got == brute(rows, n, share)


@pytest.mark.parametrize("n,share", [(4, 85), (5, 80)])
def test_edge_cases(docs, texts, n, share):
    compare(docs, texts, n, share)


def test_empty(empty):
    assert jj.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("dear,hot", [(32, 64), (1, 2)])
def test_random_copies_and_common_passages(spark, monkeypatch, dear, hot):
    monkeypatch.setattr(jj, "DEAR", dear)
    monkeypatch.setattr(jj, "HOT_IN_CHUNK", hot)
    rng = random.Random(dear)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=45)
    rows, k = [], 0
    for _ in range(25):  # chains of edits: links between neighbours, not always to the first
        words = rng.choices(vocabulary, k=rng.choice((8, 15, 30, 60, 140)))
        for _ in range(rng.randint(1, 6)):
            rows.append((k, " ".join(words)))
            k += 1
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    for _ in range(40):  # texts that are mostly one passage
        own = rng.choices(vocabulary, k=rng.choice((1, 3, 6, 12)))
        rows.append((k, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
        k += 1
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 4, 85)


def test_bounds_hold_for_all_small_sizes():
    for share in (80, 85):
        for a in range(1, 60):
            for b in range(a, 80):
                most = [a + b - 2 * i for i in range(a + 1) if 100 * i >= share * (a + b - i)]
                if most:
                    assert max(most) <= jj.difference_bound(a + b, share)
                    both = [x for x in jj.bands_of(a, share) if x in jj.bands_of(b, share)]
                    if max(most) > 0:
                        own = [x for x in both if x[0] <= a <= x[1]]
                        assert own and own[0][2] - own[0][3] > max(most)


def test_filter_is_lossless():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 90).astype(np.uint64))
        b = np.unique(np.concatenate([a[6:], rng.integers(0, 2**63, 5).astype(np.uint64)]))
        apart = sum(int(x).bit_count() for x in (jj.parity_bits(a) ^ jj.parity_bits(b)).view(np.uint64))
        assert 0 < apart <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k + 1, k) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + [(5, 5), (1, 0)], "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[1000 + k] == 1000 for k in range(200)) and len(got) == 501


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_verified_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(jj, "ROUND", 0.3)
    words = [f"w{k}" for k in range(80)]
    texts = [(k, " ".join(words[: 80 - k % 9] + [f"x{k}"])) for k in range(18)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    compare(df, texts, 4, 85)


def test_cut_and_clear_leaves_the_source_and_the_setting(spark):
    from pipelab.llm.components import _CLEAN, cut_and_clear

    before = spark.conf.get(_CLEAN, "false")
    counted = spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count()
    want = sorted(map(tuple, counted.collect()))
    cut = cut_and_clear(counted)
    assert sorted(map(tuple, cut.collect())) == want
    assert sorted(map(tuple, counted.collect())) == want
    assert sorted(map(tuple, cut.join(counted.withColumnRenamed("count", "n"), "k").select("k", "n").collect())) == want
    assert spark.conf.get(_CLEAN, "false") == before
