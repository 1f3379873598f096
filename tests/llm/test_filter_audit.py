import re
from collections import Counter, defaultdict
from itertools import permutations

from sievework.llm import filter_audit


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). Every document goes through every order."""
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = defaultdict(Counter), Counter()
    for i, text, source in docs:
        text, part = text or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and low[text] < i,
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                c = out[part, "".join(order), step]
                if fails[x]:
                    c["redundant" if gone else "removed"] += 1
                    c["unique_fails"] += sum(fails.values()) == 1
                    c["good_lost"] += not gone and i in good
                    c["toxic_lost"] += not gone and i in toxic
                    shapley[part, x] += not gone
                    gone = True
                c["kept"] += not gone
    return sorted((p, o, s, *(c[k] for k in filter_audit.COUNTS[:-1]), shapley[p, o[s - 1]]) for (p, o, s), c in out.items())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_matrices_are_every_document_in_every_order():
    m = filter_audit.outcomes()
    assert all(x.shape == (32, 600) for x in m.values())
    assert (m["kept"].reshape(32, 120, 5)[0] == 1).all()
    # a mask goes once in each order, unless it is empty
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all() and not m["removed"][0].any()


def test_audit_equals_brute_force(spark, documents, local, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in documents.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert rows(filter_audit.op11_filter_audit(spark, sf)) == want


def test_odd_rows(spark, odd, none):
    marks = [(0, 1, None), (3, 1, 0), (3, None, 1), (3, 0, 0), (None, 1, 1), (77, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")
    # copies over two sources, one of them with the smallest id more than once, and ids below zero
    more = spark.createDataFrame([(-5, "copy # one", "b"), (-5, "copy # one", "b"), (-5, "copy # one", "c"), (9, "copy # one", "c"), (None, "copy # one", "c"), (9, "A B", "")], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source", "part", "_id", "_k").unionByName(more, allowMissingColumns=True)
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], marks)
    assert {w[0] for w in want} == {"", "a", "b", "c"}
    assert rows(filter_audit.audited(docs, labels)) == want
    assert rows(filter_audit.audited(docs, labels.limit(0))) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [])
    assert filter_audit.audited(none, labels).count() == 0


def test_many_parts_of_many_copies(spark):
    docs = [(i, "the same text" if i % 3 else f"text {i} $", f"s{i % 137}") for i in range(1500)]
    got = rows(filter_audit.audited(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == brute(docs, [(7, 1, 1)])
