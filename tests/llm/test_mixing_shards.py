from collections import defaultdict

import numpy as np

from sievework.llm import mixing


def test_shards_quotas_sum_to_the_seats():
    plans = mixing.plan({"a": 4096, "b": 40_000, "c": 9_999, None: 16_000})
    for s, p in enumerate(plans):
        starts = np.arange(p.blocks) * p.block
        sizes = np.minimum(p.block, p.size - starts)
        source = np.full(p.blocks, s)
        doc, low, high, times, seats = mixing.taken(starts, sizes, source, plans)
        quotas = mixing.dealt(doc, np.ones_like(low), times, seats, source, plans).sum(0)
        assert quotas.sum() == p.seats == times.sum()
        assert (np.cumsum(quotas) == np.minimum(p.upto, p.seats)).all()


def test_shard_words_of_the_query(spark, sf, odd):
    rows = mixing.op3_mixing(spark, sf).collect()
    assert all(len(r.shard_words) == 16 and sum(r.shard_words) == r.taken for r in rows)
    whole = defaultdict(lambda: np.zeros(16, np.int64))
    for r in rows:
        whole[r.source] += r.shard_words
    plans = mixing.plan({r.source: r.source_size for r in rows})
    for p in plans:
        quotas = np.diff([0, *np.minimum(p.upto, p.seats)])
        assert (abs(whole[p.source] - quotas * p.block) <= 2 * p.block).all() and whole[p.source].sum() > 0
    assert all(sum(r.shard_words) == r.taken for r in mixing.mixed(odd, shards=3).collect())


def test_taken_against_a_walk_over_blocks(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 90))), "abc"[int(rng.integers(0, 3))]) for i in range(200)] + [(1000, "one two three four five", "tiny"), (1001, "one two three four five", "tiny")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mixed(frame).collect()
    plans = {p.source: p for p in mixing.plan({r.source: r.source_size for r in rows})}
    assert plans["tiny"].block == 1
    for source, p in plans.items():
        own = sorted((r.start, r["size"], r.taken, r.shard_words) for r in rows if r.source == source and r["size"])
        # each seat takes a block, word by word
        times, shard = np.zeros(p.size, int), np.zeros((p.size, 16), int)
        for seat in range(p.seats):
            at = int(mixing.permute(np.array([seat % p.blocks]), p.blocks, p.seed)[0])
            k = next(k for k, n in enumerate(p.upto) if n > seat)
            times[at * p.block : (at + 1) * p.block] += 1
            shard[at * p.block : (at + 1) * p.block, k] += 1
        assert sum(n for _, n, _, _ in own) == p.size
        for start, n, taken, words in own:
            assert taken == times[start : start + n].sum() and words == shard[start : start + n].sum(0).tolist()
        assert abs(times.sum() - p.target) <= max(2 * p.block, 2)
