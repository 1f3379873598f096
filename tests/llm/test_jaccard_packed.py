import numpy as np
import pyarrow as pa

from sievework.llm import jaccard

U = np.uint64


def batches(*groups, rows=3):
    """What signed() shuffles of some groups of (node, signature) rows, in the order of buckets."""
    found = []
    for node, sig in groups:
        batch, nodes, buckets, words, first = jaccard.packed(node, sig)
        found += [(int(b), batch, None, words[i:j].tobytes()) for b, i, j in zip(buckets, first[:-1], first[1:], strict=True)]
        found.append((batch % jaccard.BUCKETS, batch, nodes.tobytes(), None))
    found.sort(key=lambda r: r[0])
    for i in range(0, len(found), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + rows], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "batch", "nodes", "words"])


def test_nodes_of_one_signature_meet_across_batches():
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 1 << 63, 400, dtype=U) * U(2) + U(1)
    groups = []
    for _ in range(5):
        node = rng.choice(rng.integers(-(1 << 62), 1 << 62, 60), 300)
        groups.append((node, rng.choice(sigs, 300)))
    want = {}
    for node, sig in groups:
        for n, s in zip(node.tolist(), sig.tolist(), strict=True):
            want.setdefault(s, set()).add(n)
    out = [r for b in jaccard._met(batches(*groups)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    name = {a: b for a, b, tag in out if tag == -1}
    assert set(name.values()) == set(np.concatenate([n for n, _ in groups]).tolist())
    up = {}
    for a, b, tag in out:
        if tag >= 0:
            up.setdefault(tag, []).append((name[a], name[b]))
    for s, nodes in want.items():
        group, edges = {min(nodes)}, up.get(int(s) % jaccard.TAGS, [])
        for _ in nodes:
            group |= {x for e in edges if group & set(e) for x in e}
        assert nodes <= group
    # nobody meets but by a shared signature
    shared = {(x, y, s % jaccard.TAGS) for s, nodes in want.items() for x in nodes for y in nodes}
    assert all((name[a], name[b], tag) in shared for a, b, tag in out if tag >= 0)


def test_a_signature_is_eight_bytes_and_nothing_is_nothing(spark):
    n = 20_000
    _, _, _, words, first = jaccard.packed(np.arange(n) // 100, np.arange(n, dtype=U) * U(0x9E3779B97F4A7C15))
    assert words.nbytes == 8 * n and first[-1] == n
    assert list(jaccard._met(iter([]))) == []
    empty = spark.createDataFrame([("",), (None,)], "text string")
    assert jaccard.candidates(jaccard.signed(empty, 4, jaccard.PartEnum())).count() == 0
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, k + 40)),) for k in (0, 1, 500, 500)], "text string").repartition(3)
    rows = jaccard.signed(docs, 4, jaccard.PartEnum())
    assert rows.columns == ["bucket", "batch", "nodes", "words"]
    assert {len({r.a, r.b}) for r in jaccard.candidates(rows).collect()} == {2}


def test_a_turn_shuffles_no_set_more_than_twice():
    assert jaccard.turns({}) == [(0, 0)] and jaccard.turns({1: 100}) == [(0, 0)]
    assert jaccard.turns({1: 10, 7: 90}) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    for sizes in ({1: 1000, 40: 10}, {2: 5, 3: 5, 100: 1000}, {1: 3, 9: 1}):
        got = jaccard.turns(sizes)
        assert [d for low, high in got for d in range(low, high + 1)] == list(range(max(sizes) // 2 + 1))
        for low, high in got:
            assert sum(n * (2 if d else 1) for d in range(low, high + 1) for b, n in sizes.items() if b // 2 >= d) <= 2 * sum(sizes.values())
    # at the distances of a ring each two blocks meet once
    for blocks in range(1, 9):
        met = [tuple(sorted((i, (i + d) % blocks))) for d in range(blocks // 2 + 1) for i in range(blocks)]
        assert set(met) == {(i, j) for j in range(blocks) for i in range(j + 1)}
