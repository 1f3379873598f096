import hashlib
import re

import numpy as np
import pytest

from sievework.llm import automaton, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs):
    low, words = {}, [(i, WORD.findall((t or "").encode())) for i, t in docs]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                low[g] = min(low.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and low[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_against_brute_force(spark, sf, local):
    want = brute(local)
    assert sum(x[2] > 0 for x in want) > 10
    assert rows(substrings.op4_substring_dedup(spark, sf)) == want


@pytest.mark.parametrize("hot", [2, 10**6])
def test_passages_and_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    rng = np.random.default_rng(hot)
    passages = [" ".join(f"p{k}w{i}" for i in range(int(rng.integers(11, 40)))) for k in range(5)]
    docs = []
    for i in rng.permutation(120).tolist():
        own = " ".join(f"d{rng.integers(400)}" for _ in range(int(rng.integers(0, 30))))
        parts = [passages[int(k)] for k in rng.integers(0, 5, int(rng.integers(0, 4)))] + [own]
        docs.append((i, "\n ".join(parts[j] for j in rng.permutation(len(parts)))))
    docs += [(200, docs[0][1]), (201, docs[0][1]), (202, "a b " * 20), (203, "a b " * 9), (7, docs[3][1] + " x"), (None, docs[0][1]), (204, None), (205, " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(substrings.deduplicated(frame)) == brute(docs)


def test_automaton_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = ["".join(rng.choice(list("abc"), int(rng.integers(1, 15)))) for _ in range(4)]
        sam = automaton.SuffixAutomaton()
        ends = [(v, i) for i, t in enumerate(texts) for v in sam.insert(t)]
        low, own, cut = sam.smallest(ends), sam.owners(ends, 3), sam.cut(3)
        probe = "".join(rng.choice(list("abcd"), 30))
        for i, (v, n) in enumerate(sam.stream(probe)):
            want = next((k for k in range(i + 1, 0, -1) if any(probe[i + 1 - k : i + 1] in t for t in texts)), 0)
            assert n == want
            if n >= 3:
                holders = {j for j, t in enumerate(texts) if probe[i - 2 : i + 1] in t}
                assert own[cut[v]] == holders and low[cut[v]] == min(holders)


def test_odd_rows(odd, none):
    got = substrings.deduplicated(odd)
    assert rows(got) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert substrings.deduplicated(none).count() == 0


def test_long_words_of_repeating_patterns_stay_apart(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))
    common = " ".join(f"w{i}" for i in range(12))
    frame = spark.createDataFrame([(1, f"{common} {a}"), (2, f"{common} {b}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.deduplicated(frame).collect()] == [0, 0]
