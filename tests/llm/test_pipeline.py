import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import quality

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as linked
from .test_tokenfiles import brute as encoded


def test_stages_against_brute_force(spark, sf, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).persist()
        seen[name] = (before.collect(), docs.collect())
        if name != "token_output":
            assert docs.columns == documents.columns
    before, after = seen["quality_rules"]
    verdict = {r.doc_id: r.kept for r in quality.judged(documents).collect()}
    assert sorted(after) == sorted(r for r in before if verdict[r.doc_id]) and len(after) < len(before)
    before, after = seen["near_copies"]
    groups = linked([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {c for _, c in groups.values()} and len(after) == len({r.doc_id for r in after})
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = contaminated([(r.doc_id, r.text) for r in before], items)
    assert {r.doc_id for r in after} == {i for i, x in hit.items() if not x[4]}
    assert all(a in before for a in after if hit[a.doc_id][1] == 0)
    before, after = seen["source_mix"]
    words, kept = Counter(), Counter()
    for r in before:
        words[r.source] += len(r.text.split())
    for r in after:
        kept[r.source] += len(r.text.split())
    names = sorted(words)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(words.values()), set(names), {}
    while full := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * words[s]]:
        for s in full:
            target[s] = 2 * words[s]
            open_.remove(s)
        left = 1.5 * sum(words.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(kept[s] - target[s]) <= max(64, 0.02 * words[s]) for s in names)
    before, after = seen["token_output"]
    want = encoded([(r.doc_id, r.text) for r in before], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == sorted((i, n, c) for i, _, n, c in want)
    assert np.array_equal(np.cumsum([0] + [r.n_tokens for r in sorted(after, key=lambda r: r.start)])[:-1], sorted(r.start for r in after))
    assert zlib.crc32(b"") == 0


def test_odd_rows(spark, sf, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0
        stage(spark, odd, sf).count()
