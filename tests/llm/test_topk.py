import math
import random

import numpy as np
import pytest

from sievework.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, _group int, _q string"
LONG = (1 << 63) - 1


def takes_part(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, queries, k=10, scale=1024):
    """rows and queries: (id, vector)."""
    of = lambda rs: [(i, [math.floor(scale * x) for x in v]) for i, v in rs if takes_part(v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in of(queries)}:
        found = [(-max(-LONG, min(LONG, sum(a * b for a, b in zip(x, v, strict=False)))), i is None, i or 0, i) for i, v in of(rows) if i is None or i != q]
        out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 5, "q") for i, v in rows], SCHEMA)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(topk.op12_exact_topk(spark, sf)) == brute(rows, [r for r in rows if r[0] % 100 == 0])


@pytest.mark.parametrize("seed", range(3))
def test_pruning_loses_nothing(seed, monkeypatch):
    """Close and far vectors, many ties, chunks so small that bounds are at work from the second one on."""
    monkeypatch.setattr(topk, "FIRST", 40)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rng = np.random.default_rng(seed)
    dims = [3, 20, 64][seed]
    x = np.floor(rng.normal(0, 200, (500, dims)) * rng.choice([0.01, 1.0], (500, 1)))
    x[100:200] = x[7]
    ids = rng.permutation(500)
    q = rng.permutation(500)[:70]
    best = topk.Group(ids, np.zeros(500, bool), x).answer(ids[q], x[q], 10)
    got = sorted(zip(*(r.tolist() for r in best.rows), strict=True))
    want = []
    for n, j in enumerate(q.tolist()):
        score = (x @ x[j]).astype(int)
        order = sorted((c for c in range(500) if ids[c] != ids[j]), key=lambda c: (-score[c], ids[c]))[:10]
        want += [(n, int(score[c]), False, int(ids[c])) for c in order]
    assert got == sorted(want)


def test_odd_vectors(spark):
    rng = random.Random(4)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vector(rng.choice([5, 5, 5, 9, 1]))) for i in range(-200, 400, 4)]
    rows += [(None, vector(5)), (None, vector(5)), (3, None), (100, [0.1, None]), (100, [float("nan"), 1.0]), (200, [float("inf")]), (300, []), (5, []), (6, [0.0] * 5), (7, [0.0] * 5)]
    # repeated rows and ids, ties, and components of any size
    rows += [(100, rows[0][1])] * 3 + [(8, rows[0][1])] * 4 + [(100, [1e300, -1e300]), (200, [1e300, 1e5, 3.0]), (11, [-1e300, 1e300, 1e15]), (12, [2.0**40, 0.5])]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    t = table(spark, rows)
    assert rows_of(topk.top_k(t, t.where("vec_id % 100 = 0"))) == brute(rows, queries)
    assert rows_of(topk.top_k(t, t.where("vec_id = 100"), k=3, scale=7)) == brute(rows, [r for r in rows if r[0] == 100], 3, 7)


def test_few_and_none(spark):
    t = table(spark, [(0, [1.0, 2.0]), (1, [3.0]), (2, None)])
    assert rows_of(topk.top_k(t, t.where("vec_id = 0"))) == [(0, 1, 1, 3072 * 1024)]
    assert topk.top_k(t, t.where("vec_id = 2")).count() == 0
    assert topk.top_k(t.limit(0), t).count() == 0 and topk.top_k(t.limit(0), t.limit(0)).count() == 0


def test_groups_and_turns(spark, monkeypatch):
    """Results don't depend on how candidates and queries are dealt."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).round(1).tolist()) for i in range(600)]
    t = table(spark, rows)
    monkeypatch.setattr(topk, "GROUP_BYTES", 3000)
    monkeypatch.setattr(topk, "TASK_QUERIES", 2)
    assert rows_of(topk.top_k(t, t.where("vec_id % 100 = 0"))) == brute(rows, [r for r in rows if r[0] % 100 == 0])
