"""The similarity join by blocks: how much it copies, and its results against brute force."""

import math
import random
from functools import reduce

import numpy as np

from factloom.operators.relate import BLOCK, POOL_BLOCK, deal, recall_at_k, top_k_similar, unordered_pairs


def vectors(spark, n=200):
    """Vectors of few small whole numbers, so that many products are equal, and the k best of each by brute force."""
    rng = np.random.default_rng(5)
    x, ids = rng.integers(-2, 3, size=(n, 4)), random.Random(5).sample(range(10 * n), n)
    s = x @ x.T
    best = {i: [b for _, b in sorted((-s[a, j], ids[j]) for j in range(n) if j != a)] for a, i in enumerate(ids)}
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id long, embedding array<float>"), best


def test_copies_grow_with_the_input():
    def copied(rows):
        n, m = deal(rows, rows, 24, BLOCK // 64, POOL_BLOCK // 64)
        assert rows / n <= BLOCK // 64 and rows / m <= POOL_BLOCK // 64
        return rows * (n + m)

    assert copied(100_000) <= 10 * copied(10_000) and copied(600_000) <= 7 * copied(100_000)


def test_recall_by_blocks(spark):
    v, best = vectors(spark)
    pairs = [(i, b[at]) for i, b in best.items() for at in (0, 5, 30)]
    got = recall_at_k(spark.createDataFrame(pairs, "fact_id_a long, fact_id_b long"), v).collect()
    assert [(r.k, r.pairs, r.hits) for r in sorted(got)] == [(4, 600, 200), (8, 600, 400), (16, 600, 400), (32, 600, 600)]


def test_unordered_pairs_by_blocks(spark):
    v, best = vectors(spark)
    got = unordered_pairs(top_k_similar(v, v, 4, block=4 * 30, pool_block=4 * 70)).select("lo", "hi").collect()
    assert sorted(map(tuple, got)) == sorted({(min(i, j), max(i, j)) for i, b in best.items() for j in b[:4]})


def test_top_k_by_blocks(spark):
    v, best = vectors(spark)
    for k, block, pool in ((4, 30, 70), (20, 1000, 15), (300, 50, 50)):
        got = top_k_similar(v, v, k, block=4 * block, pool_block=4 * pool).collect()
        assert sorted((r.id, r["rank"], r.other_id) for r in got) == sorted((i, at + 1, j) for i, b in best.items() for at, j in enumerate(b[:k]))
    assert top_k_similar(v.limit(0), v).count() == 0 and top_k_similar(v, v.limit(0)).count() == 0


def doubles(spark, n=300):
    """Vectors of doubles, many of them alike or permuted, so that scores are equal or differ in the last bit, and the best of
    each by the sum that DuckDB forms: in double precision, in order, multiplied and added at once."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 64))[rng.integers(0, 12, n)]
    x[::5] = [rng.permutation(x[0]) for _ in x[::5]]
    ids = random.Random(7).sample(range(10 * n), n)
    best = {}
    for i, v in zip(ids, x):
        score = np.array([reduce(lambda s, ab: math.fma(*ab, s), zip(v.tolist(), w), 0.0) for w in x.tolist()])
        best[i] = [(ids[j], float(score[j])) for j in np.lexsort((ids, -score)) if ids[j] != i]
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, embedding array<double>"), best


def test_unordered_pairs_of_copies(spark):
    v, best = doubles(spark)
    got = unordered_pairs(top_k_similar(v, v, 4, block=64 * 90, pool_block=64 * 110)).select("lo", "hi", "score").collect()
    assert {(r.lo, r.hi): r.score for r in got} == {(min(i, j), max(i, j)): score for i, b in best.items() for j, score in b[:4]}


def test_copies_grow_no_faster_than_a_million_rows():
    def copied(rows):
        return rows * sum(deal(rows, rows, 24, BLOCK // 64, POOL_BLOCK // 64))

    assert copied(600_000) <= 6 * copied(100_000) and copied(1_000_000) <= 10 * copied(100_000)
