import re

import numpy as np
import pytest

from sievework.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_against_brute_force(spark, sf, local):
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, sf).collect()}
    assert len(got) == len(local)
    for i, text in local:
        if len(text or "") < 8000:
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), i
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_posterior_beats_all_must_pass(spark, size):
    """Some documents that a rule objects to are kept, and more verdicts agree with the labels than if all rules had to pass."""
    sf = f"/root/testdata/{size}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    votes = quality.measured(docs).select("doc_id", "pattern")
    rows = quality.judged(docs).join(votes, "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").where("not base_failed").collect()
    objected = [any(r.pattern // 3**j % 3 == 2 for j in range(len(quality.RULES))) for r in rows]
    kept = [r.kept for r, o in zip(rows, objected, strict=True) if o]
    assert any(kept) and not all(kept)
    told = [(r.quality == 1, r.kept, not o) for r, o in zip(rows, objected, strict=True) if r.quality is not None]
    assert np.mean([y == k for y, k, _ in told]) > np.mean([y == p for y, _, p in told])
    assert np.mean([k for y, k, _ in told if y]) > 0.99 and np.mean([k for y, k, _ in told if not y]) < 0.05


def test_em_finds_rules_apart():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.85, 0.8]
    keys = np.zeros(len(y), np.int64)
    for a in right:
        vote = np.where(rng.random(len(y)) < a, y, ~y)
        keys = keys * 3 + np.where(rng.random(len(y)) < 0.1, 0, np.where(vote, 1, 2))
    k, n = np.unique(keys, return_counts=True)
    found = quality.fit(dict(zip(k.tolist(), n.tolist(), strict=True)), 4)
    p = found.posterior
    names = tuple(quality.Rule(str(j), "n_words", "n_words", 0, 1) for j in range(4))
    assert all(abs(x - y) < 0.03 for x, y in zip(found.accuracies(names).values(), right, strict=True))
    assert np.mean((np.array([p[x] for x in keys.tolist()]) >= 0.5) == y) > 0.95
    assert quality.fit({}, 3).posterior == {}


def test_em_weighs_a_rule_by_what_others_say():
    """Two rules agree on the bad tenth; a third objects at random: alone it rejects nobody, and it takes nothing from the two."""
    rng = np.random.default_rng(1)
    bad = rng.random(50_000) < 0.1
    votes = [np.where(rng.random(len(bad)) < np.where(bad, 0.95, 0.002), 2, 1) for _ in range(2)]
    votes.append(np.where(rng.random(len(bad)) < 0.05, 2, 1))
    keys, n = np.unique(votes[0] * 9 + votes[1] * 3 + votes[2], return_counts=True)
    found = quality.fit(dict(zip(keys.tolist(), n.tolist(), strict=True)), 3)
    p = found.posterior
    assert abs(found.prior - 0.9) < 0.02 and p[1 * 9 + 1 * 3 + 2] > 0.9 and p[2 * 9 + 2 * 3 + 1] < 0.1
    # the same counts in another order of keys give the same numbers
    again = quality.fit(dict(zip(keys[::-1].tolist(), n[::-1].tolist(), strict=True)), 3)
    assert again.posterior == p


def test_odd_rows(odd, none):
    got = quality.judged(odd).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (0, 1, 2))
    assert quality.judged(none).count() == 0 and quality.kept_documents(none).count() == 0
    kept = quality.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


def test_kept_documents_of_many_slices(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r.doc_id for r in quality.judged(documents).where("kept").collect()}
    got = quality.kept_documents(documents.coalesce(1)).select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id for r in got} == want and all(r.text == texts[r.doc_id] for r in got)
