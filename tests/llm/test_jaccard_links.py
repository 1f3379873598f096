import re
from collections import Counter

import numpy as np
import pytest

from sievework.llm import jaccard


def links_of(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.findall("[^ ]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    out = Counter({i: 0 for i in sets})
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            out[i] += i != j and both > 0 and 100 * both >= percent * len(sets[i] | sets[j])
    return out


@pytest.mark.parametrize("block", [40, 10**6])
def test_links_are_counted_once(spark, block):
    rng = np.random.default_rng(9)
    docs = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            own = base[: 60 - int(rng.integers(0, 12))]
            for at in rng.choice(len(own), rng.integers(0, 3), replace=False):
                own[at] = f"x{rng.integers(1000)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs) + i, docs[5][1]) for i in range(4)] + [(500, "a b"), (501, "A  b"), (502, ""), (503, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_links for r in jaccard.linked(frame, block=block).collect()}
    want = links_of(docs, 4, 85)
    assert got == want and max(want.values()) > 5
