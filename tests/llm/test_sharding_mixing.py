import heapq
from collections import Counter

import numpy as np
import pytest

from sievework.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_and_inverts(n):
    x = np.arange(n)
    p = sharding.permute(x, n, seed=5)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, seed=5, back=True) == x).all()


def test_shards_are_even_gapless_and_repeat(spark, sf, odd, none):
    a = sharding.op1_sharding(spark, sf).collect()
    assert {r.law for r in a} == {"rows"} and all(r.grown_shard is None for r in a)
    sizes = Counter(r.shard for r in a)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in a if r.shard == s) == list(range(n))
    assert sorted(map(str, a)) == sorted(map(str, sharding.op1_sharding(spark, sf).collect()))
    b = sharding.sharded(odd, 4).collect()
    assert len(b) == odd.count() and len({(r.shard, r.slot) for r in b}) == len(b)
    assert {(r["size"], r.text_crc32) for r in b if r.doc_id == 0} == {(1, 0)}
    assert sharding.sharded(none).count() == 0


def test_sainte_lague_is_the_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w = (rng.integers(0, 50, rng.integers(1, 8)) * rng.choice([1.0, 0.5])).tolist()
        seats = int(rng.integers(0, 60))
        want = [0] * len(w)
        if sum(w):
            heap = [(-x, i) for i, x in enumerate(w) if x]
            heapq.heapify(heap)
            for _ in range(seats):
                _, i = heapq.heappop(heap)
                want[i] += 1
                heapq.heappush(heap, (-w[i] / (2 * want[i] + 1), i))
        assert mixing.sainte_lague(w, seats) == want


def test_targets_fill_and_stop():
    t = mixing.targets([100, 10, 0, 50], [3, 1, 2, 3], 1.5, 2.0)
    assert abs(sum(t) - 240) < 1e-9 and t[1] <= 20 and t[2] == 0 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [100, 10, 0, 50], strict=True))


def test_mix_meets_targets(spark, sf, odd, none, documents):
    a = mixing.op3_mixing(spark, sf).collect()
    assert sorted(map(str, a)) == sorted(map(str, mixing.op3_mixing(spark, sf).collect()))
    for s in {r.source for r in a}:
        own = [r for r in a if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(32, 0.02 * own[0].source_size)
    assert all(0 <= r.taken <= 2 * r["size"] for r in a)
    b = mixing.mixed(odd).collect()
    assert len(b) == odd.count() and all(r.taken == 0 for r in b if r.doc_id in (0, 1, 2)) and all(r.taken <= 2 * r["size"] for r in b)
    assert mixing.mixed(none).count() == 0
    m = mixing.mixed_documents(documents)
    assert m.columns == documents.columns
    words = Counter()
    for r in m.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in a if r.taken})
    assert mixing.mixed_documents(none).count() == 0 and mixing.mixed_documents(odd).count() > 0
