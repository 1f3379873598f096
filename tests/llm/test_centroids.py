import hashlib
import math

import numpy as np
import pytest

from sievework.llm import centroids

LONG = (1 << 63) - 1


def brute(rows, k=40, rounds=5, width=64, seed=2, scale=256):
    """rows: (id, vector). Whole numbers of Python, one vector at a time."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    if not c:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(vs) for col in zip(*vs, strict=True)] if vs else x for vs, x in zip(own, c, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, j in found if j == n) for n in range(len(c))]
    return sorted(((i, j, min(d, LONG), min(sums[j], LONG), min(sum(sums), LONG), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, block string")


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(centroids.op13_centroids(spark, sf)) == brute(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).round(1).tolist()) for i in range(-40, 60)]
    rows = good + [(None, good[3][1]), (1, None), (2, good[0][1][:3]), (3, [0.0, None, 0.0, 0.0]), (4, [0.0, float("nan"), 0.0, 0.0]), (5, [0.0, float("inf"), 0.0, 0.0]), (6, [])] + [good[5]] * 50 + [(7, good[8][1])]
    assert rows_of(centroids.clustered(table(spark, rows), k=6, width=4)) == brute(rows, 6, width=4)
    # more centroids than vectors; ties of equal centroids; one vector
    assert rows_of(centroids.clustered(table(spark, good[:5] + good[:2]), k=40, width=4)) == brute(good[:5] + good[:2], width=4)
    assert rows_of(centroids.clustered(table(spark, good[:1]), k=3, width=4)) == brute(good[:1], 3, width=4)
    nameless = table(spark, [(None, good[0][1])])
    assert centroids.clustered(nameless, width=4).count() == 0 and centroids.clustered(nameless.limit(0), width=4).count() == 0
    assert centroids.clustered(nameless.limit(0), width=4).columns == centroids.clustered(table(spark, good), width=4).columns


@pytest.mark.parametrize("size", [1.0, 1e5, 2e6, 1e9, 1e300])
def test_any_magnitude_is_exact(spark, size):
    """Doubles, longs and whole numbers of any size give what whole numbers give."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * (size if i % 7 == 0 else 1.0)).tolist()) for i in range(80)]
    assert rows_of(centroids.clustered(table(spark, rows), k=5, rounds=3, width=3)) == brute(rows, 5, 3, 3)


def test_tiers_agree():
    rng = np.random.default_rng(3)
    c = centroids._big(np.floor(rng.normal(0, 1000, (7, 8))))
    x = np.floor(rng.normal(0, 1000, (50, 8)))
    at, d = centroids.nearest(x, c)
    for i, row in enumerate(x.astype(int).tolist()):
        want = min((sum((a - b) ** 2 for a, b in zip(row, y, strict=True)), j) for j, y in enumerate(c.tolist()))
        assert (d[i], at[i]) == want
    assert set(centroids._by_bound(np.array([[1.0], [2.0**28], [2.0**40]]), centroids._big(np.zeros((1, 1))))) == {0, 1, 2}
