import datetime
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import fit
from sievework.operators import memo
from sievework.plans import posting_queries, posting_run

DAY = datetime.date(2026, 6, 1)


def test_stable_json():
    assert memo.stable_json({"b": (1, None), "a": {"y", "x"}}) == '{"a":["x","y"],"b":[1,null]}'
    for bad in (float("nan"), object()):
        with pytest.raises((ValueError, TypeError)):
            memo.stable_json({"x": bad})


def test_fingerprints_tell_rows_and_contexts(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), ("a", None)], "x string, y string")
    of = lambda c: [r[0] for r in df.select(memo.fingerprint({"y": F.col("y"), "x": F.col("x")}, c)).collect()]
    a, b = of("1"), of("2")
    assert len(set(a)) == 3 and a[0] == a[3] and not set(a) & set(b)
    assert a == [r[0] for r in df.select(memo.fingerprint({"x": F.col("x"), "y": F.col("y")}, "1")).collect()]


def rows(spark, tmp_path, name, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    path = str(tmp_path / name)
    df.withColumn("fingerprint", memo.fingerprint({"text": F.col("text")})).write.parquet(path)
    return spark.read.parquet(path)


def lengths(seen):
    def compute(df):
        seen.append(sorted(r.text or "" for r in df.collect()))
        return df.select("fingerprint", F.when(F.col("text") != "bad", F.length("text")).alias("n"), F.col("text").isNull().alias("was_null"))

    return compute


def test_hits_misses_and_invalid_ones(spark, tmp_path):
    path, seen, ok = str(tmp_path / "memo"), [], F.col("n").isNotNull() | F.col("was_null")
    run = lambda df, version=1, day=DAY: memo.remembered(df, path, lengths(seen), version, day, keep=["i", "fingerprint"], valid=ok)
    first, s = run(rows(spark, tmp_path, "a", ["x", "yy", "x", None, "bad", "x"]))
    assert sorted((r.i, r.n) for r in first.collect() if r.n) == [(0, 1), (1, 2), (2, 1), (5, 1)] and first.count() == 6
    assert s == memo.Stats(4, 0, 4, 0, 3) and seen == [["", "bad", "x", "yy"]] and s.hit_rate == 0
    second, s = run(rows(spark, tmp_path, "b", ["zzz", "yy", "bad", None]))
    # what isn't valid isn't kept
    assert s == memo.Stats(4, 2, 2, 0, 1) and seen[1] == ["bad", "zzz"] and s.hit_rate == 0.5
    assert sorted((r.i, r.n, r.was_null) for r in second.collect()) == [(0, 3, False), (1, 2, False), (2, None, None), (3, None, True)]
    # another version knows nothing; an empty table asks nothing
    _, s = run(rows(spark, tmp_path, "c", ["yy"]), version=2)
    assert s == memo.Stats(1, 0, 1, 0, 1)
    third, s = run(rows(spark, tmp_path, "d", []))
    assert third.count() == 0 and s == memo.Stats(0, 0, 0, 0, 0) and len(seen) == 3
    # a stored result that is damaged counts as invalid and is computed again
    spark.createDataFrame([(r.fingerprint, None, False, 1, DAY) for r in rows(spark, tmp_path, "e", ["q"]).collect()], "fingerprint string, n int, was_null boolean, version int, stored_on date").write.mode("append").partitionBy("version").parquet(f"{path}/artifacts")
    fourth, s = run(spark.read.parquet(str(tmp_path / "e")))
    assert s == memo.Stats(1, 0, 1, 1, 1) and [r.n for r in fourth.collect()] == [1]


def test_compaction_drops_what_is_old(spark, tmp_path):
    path, into, seen = str(tmp_path / "memo"), str(tmp_path / "next"), []
    assert memo.compacted(spark, path, into, DAY) == 0
    run = lambda name, texts, day: memo.remembered(rows(spark, tmp_path, name, texts), path, lengths(seen), 1, day)
    run("a", ["old", "kept", "new"], DAY - datetime.timedelta(days=40))
    run("b", ["kept"], DAY - datetime.timedelta(days=30))
    run("c", ["new"], DAY)
    assert memo.compacted(spark, path, into, DAY) == 2
    _, s = memo.remembered(rows(spark, tmp_path, "d", ["old", "kept", "new"]), into, lengths(seen), 1, DAY)
    assert (s.hits, s.misses) == (2, 1)


def test_a_warm_run_reads_no_texts(spark, tmp_path):
    today, profile = F.lit("2026-06-09").cast("date"), fit.Profile()
    plain = posting_queries._postings(spark).where("k in (1, 4, 11)").selectExpr("*", "'Boston' location", "'' remote_status", "'$30/hr' compensation", "'2026-06-12' deadline", "'' internship_type")
    posting_run.with_fingerprint(plain, profile).write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    cold, s = posting_run.scored_with_memo(table, str(tmp_path / "memo"), profile, today, DAY)
    assert (s.hits, s.misses, s.writes) == (0, 3, 3)
    warm, s = posting_run.scored_with_memo(table, str(tmp_path / "memo"), profile, today, DAY)
    assert (s.hits, s.misses, s.hit_rate) == (3, 0, 1.0)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", warm._jdf.queryExecution().executedPlan().toString())
    assert scans and not any(re.search(r"description#|requirements#", scan) for scan in scans)
    want = {r.k: r for r in posting_run.scored(plain, profile, today).collect()}
    for r in warm.collect():
        w = want[r.k]
        assert (r.id, r.total, r.fit_score, r.bucket, r.action, r.reasons, r.concerns, r.categories, r.deadline_days_left) == (w.id, w.total, w.fit_score, w.bucket, w.action, w.reasons, w.concerns, w.categories, w.deadline_days_left)
