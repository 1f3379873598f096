import zlib

import numpy as np

from sievework.llm import toxicity


def test_marks_of_a_clause():
    m = toxicity.Model({"idiot": 5.0}, {"gross": 4.0})
    marks = lambda t: [x for x, _ in m.clause(t.split())]
    assert marks("what an idiot") == ["insult"]
    assert marks("you are an idiot") == ["insult+"]
    assert marks("you are not an idiot") == ["insult+-"]
    assert marks("she said he is an idiot") == ['insult+"']
    assert marks("i will kill you") == ["threat"] and marks("they kill") == ["threat+"]
    assert marks("grossly gross grow") == ["insult"]
    assert m.clause(["idiot"])[0][1] == 5.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    test = [r for r in got if r.held_out]
    hit = np.mean([r.predicted for r in test if r.toxic == 1])
    false = np.mean([r.predicted for r in test if r.toxic == 0])
    assert hit > 0.85 and false < 0.01


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, None), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train(odd, labels), toxicity.train(none, labels), toxicity.Model({"one": 3.0}, {"w9": 2.0})):
        got = toxicity.scored(odd, model).collect()
        assert len(got) == odd.count()
        assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
        assert toxicity.scored(none, model).count() == 0
