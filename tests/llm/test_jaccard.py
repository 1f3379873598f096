import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from sievework.llm import jaccard
from sievework.operators import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets_of(docs, k):
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").encode().translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute(docs, k, percent):
    sets = sets_of(docs, k)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(list)
    for i in sorted(sets):
        both = defaultdict(int)
        for g in sets[i]:
            for j in inverted[g]:
                both[j] += 1
            inverted[g].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "n2", "k2"), [(85, 2, 1), (80, 2, 1), (80, 3, 1), (90, 4, 2)])
def test_sets_within_the_threshold_share_a_signature(percent, n2, k2):
    rng = np.random.default_rng(percent)
    method = jaccard.PartEnum(percent, n2, k2)
    sets = []
    for _ in range(400):
        n = int(rng.choice([1, 2, 5, 6, 7, 11, 20, 40, 90, 200, 400]))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        k = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
        kept = a[k:]
        b = np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, k + 2)).astype(np.uint64)])
        sets += [a, b]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    doc, sig = method.signatures(np.concatenate(sets), first)
    of = [set(sig[doc == i].tolist()) for i in range(len(sets))]
    linked = 0
    for i in range(0, len(sets), 2):
        a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            linked += 1
            assert of[i] & of[i + 1]
    assert linked > 100
    apart = sum(bool(of[i] & of[j]) for i, j in combinations(range(0, len(sets), 2), 2))
    assert apart == 0


def test_query_against_brute_force(spark, sf, local):
    want = brute(local, 4, 85)
    got = jaccard.op5_jaccard_join(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(local)


@pytest.mark.parametrize("block", [40, 10**6])
def test_groups_of_near_copies(spark, block):
    rng = np.random.default_rng(3)
    docs = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(30):
            own = list(base)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                own[at] = f"x{rng.integers(1000)}"
            docs.append((len(docs) * 7 % 211, " ".join(own)))
    docs += [(1001, "a b"), (1002, "A  b"), (1003, "a b c"), (1004, ""), (1005, None), (1006, " "), (1000, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for k, percent in ((4, 85), (5, 80)):
        got = jaccard.linked(frame, k, percent, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, k, percent)
    kept = {r.doc_id for r in jaccard.one_of_each(frame).collect()}
    assert kept == {c for _, c in brute(docs, 5, 80).values()}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: y for x, y in up.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd, none):
    got = jaccard.linked(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0, 1, 2}
    assert {r.component_id for r in got if r.doc_id in (3, 4, None)} == {3}
    assert len({r.component_id for r in got if r.doc_id in (5, 6)}) == 1
    assert jaccard.linked(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert jaccard.one_of_each(odd).columns == odd.columns


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_repeating_patterns_stay_apart(spark):
    a, b = thue_morse(2048)
    common = " ".join(f"w{i}" for i in range(6))
    frame = spark.createDataFrame([(1, f"{common} {a} {common}"), (2, f"{common} {b} {common}")], "doc_id long, text string")
    assert {r.component_id for r in jaccard.linked(frame).collect()} == {1, 2}


def test_rows_that_repeat_an_id_keep_their_links(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, b), (9, b + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.linked(frame).collect()) == [(1, 1), (5, 1), (5, 5), (9, 5)]
    assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each(frame).collect()) == [(1, a), (5, b)]
    words = spark.createDataFrame([(f"k{i}", t) for i, t in rows], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.linked(words).collect()) == [("k1", "k1"), ("k5", "k1"), ("k5", "k5"), ("k9", "k5")]


def test_hot_signatures_are_combined():
    node = np.array([7, 5, 9, 7, 5, 9, 3])
    sig = np.array([256, 256, 256, 512, 512, 512, 384], np.uint64)
    n, s = jaccard.combined(node, sig)
    assert sorted(s.tolist())[:3] != [256, 256, 256] and np.count_nonzero(s == 256) == np.count_nonzero(s == 512) == 1
    own = {}
    for x, y in zip(n.tolist(), s.tolist(), strict=True):
        own.setdefault(y, set()).add(x)
    groups = [set(x) for x in own.values() if len(x) > 1]
    assert {frozenset(g) for g in groups} == {frozenset({7, 5}), frozenset({7, 9})}
