import datetime
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import alerts as al
from sievework.operators import timelines
from sievework.streaming import alerts as stream

KINDS = ["new_failure", "continued_failure", "minor_degradation", "recovery", "minor_recovery", "direct_source_degraded", "feed_stale"]
START = datetime.datetime(2026, 3, 1)
SCHEMA = "health_key string, detected_at timestamp, seq long, alert_type string, label string, rows_returned long, reason_codes array<string>"


@pytest.fixture(scope="module")
def history():
    rng = random.Random(5)
    rows, at = [], START
    for seq in range(400):
        at += datetime.timedelta(minutes=rng.choice([0, 5, 40, 90, 400]))
        rows.append((rng.choice("abcd"), at, seq, rng.choice(KINDS), f"label {seq}", seq, rng.sample(["x", "y", "z"], rng.randint(0, 2))))
    return rows


def by_hand(rows, seconds, allowed=None):
    """One alert after the other, over a table of (key, kind)."""
    sent_at, resolved, out = {}, {}, {}
    for key, at, seq, kind, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        sent_at.setdefault((key, kind))
        resolved.setdefault((key, kind))
        for k in resolved:
            if k[0] == key and resolved[k] is None and (kind in al.RECOVERIES and k[1] in al.FAILURES or kind in al.OPENING and k[1] in al.RECOVERIES):
                resolved[k] = at
        last = sent_at[key, kind]
        out[seq] = (allowed is None or kind in allowed) and (last is None or resolved[key, kind] is not None or (at - last).total_seconds() >= seconds)
        if out[seq]:
            sent_at[key, kind], resolved[key, kind] = at, None
    return out


@pytest.mark.parametrize("allowed", [None, ("new_failure", "recovery")])
def test_what_is_sent(spark, history, allowed):
    df = spark.createDataFrame(history, SCHEMA).repartition(5)
    got = {r.seq: r.sent for r in al.sent(df, 6 * 3600, allowed).collect()}
    assert got == by_hand(history, 6 * 3600, allowed) and len(set(got.values())) == 2
    assert al.sent(df.limit(0), 5).count() == 0 and al.sent(df.withColumn("detected_at", F.lit(None).cast("timestamp")), 5).count() == 0


def test_resolutions_and_open_incidents(spark, history):
    df = spark.createDataFrame(history, SCHEMA)
    want = {}
    for key, at, seq, kind, *_ in history:
        after = [r[1] for r in history if r[0] == key and r[3] in al.RECOVERIES and (r[1], r[2]) > (at, seq)]
        want[seq] = min(after) if kind in al.FAILURES and after else None
    assert {r.seq: r.resolved_at for r in al.resolved(df).collect()} == want
    for n in range(20, 400, 55):
        some = history[:n]
        open_ = {}
        for key, at, seq, kind, *_ in some:
            if kind in al.RECOVERIES:
                open_[key] = set()
            elif kind in al.DEGRADATIONS:
                open_.setdefault(key, set()).add(kind)
        got = {r.health_key for r in al.open_minor_incidents(spark.createDataFrame(some, SCHEMA)).collect()}
        assert got == {k for k, kinds in open_.items() if kinds == {"minor_degradation"}}


def test_incidents(spark, history):
    states = spark.createDataFrame([("a", "failed"), ("b", "healthy_empty")], "health_key string, status string")
    got = {r.health_key: r for r in al.minor_incidents(spark.createDataFrame(history, SCHEMA), states).collect()}
    for key in "abcd":
        own = [r for r in history if r[0] == key and r[3] == "minor_degradation"]
        back = [r[1] for r in history if r[0] == key and r[3] == "minor_recovery"]
        r = got[key]
        assert (r.occurrences, r.first_at, r.last_at, r.latest.label) == (len(own), own[0][1], own[-1][1], own[-1][4])
        assert r.reasons == sorted({c for o in own for c in o[6]})
        assert r.recovered == ("yes" if max(back) >= own[-1][1] else {"a": "no", "b": "yes"}.get(key, "unknown"))


def test_candidates(spark):
    state = "health_key string, source_kind string, status string, changed boolean, recovery boolean, last_nonzero_at timestamp, incomplete boolean, truncated boolean, malformed_row_count long, schema_error_row_count long, rows_returned long"
    old = START - datetime.timedelta(hours=100)
    rows = [
        ("back", "direct", "healthy_empty", True, True, None, False, False, 0, 0, 0), ("quiet", "direct", "healthy_empty", True, True, None, False, False, 0, 0, 0),
        ("new", "direct", "failed", True, False, None, None, None, None, None, None), ("still", "github_feed", "failing", None, None, None, None, None, None, None, None),
        ("minor", "direct", "degraded", True, False, None, False, False, 2, 0, 100), ("worse", "direct", "degraded", False, False, None, True, False, 2, 0, 100),
        ("dark", "direct", "unknown", False, False, None, None, None, None, None, None), ("stale", "github_feed", "healthy", False, False, old, None, None, None, None, 0), ("fine", "github_feed", "healthy", False, False, START, None, None, None, None, 5),
    ]
    got = al.candidates(spark.createDataFrame(rows, state), spark.createDataFrame([("quiet",)], "health_key string"), F.lit(START))
    assert {r.health_key: (r.alert_type, r.severity) for r in got.collect()} == {
        "back": ("recovery", "info"), "quiet": ("minor_recovery", "info"), "new": ("new_failure", "high"), "still": ("continued_failure", "high"), "minor": ("minor_degradation", "info"),
        "worse": ("direct_source_degraded", "medium"), "dark": ("unknown_diagnostics", "medium"), "stale": ("feed_stale", "medium"),
    }
    now = spark.createDataFrame([("a", "uncovered"), ("b", "backstop_only"), ("c", "direct"), ("d", "backstop_only")], "company string, coverage string")
    before = spark.createDataFrame([("b", "direct"), ("d", "backstop_only")], "company string, coverage string")
    assert {r.company: r.alert_type for r in al.coverage_alerts(now, before).collect()} == {"a": "both_tiers_unavailable", "b": "coverage_regression"}
    assert {r.company for r in al.coverage_alerts(now, before.limit(0)).collect()} == {"a"}


def test_stream_and_batch_agree(spark, history, tmp_path):
    for n in range(0, 400, 100):
        spark.createDataFrame(history[n : n + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stream.alert_stream(files, 6 * 3600).writeStream.format("memory").queryName("alerts_out").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    rows = spark.table("alerts_out").collect()
    assert {r.seq: r.sent for r in rows if r.kind == "alert"} == by_hand(history, 6 * 3600)
    days = {}
    for key, at, seq, kind, *_ in history:
        if kind in al.MINOR:
            day = int(at.replace(tzinfo=datetime.UTC).timestamp()) // 86400 * 86400
            days[key, day] = days.get((key, day), 0) + 1
    told = {(r.health_key, r.day): r.n for r in rows if r.kind == "day"}
    last = max(d for _, d in days)
    assert told and set(told.items()) <= set(days.items()) and {k for k in days if k[1] < last - 86400} <= set(told)


def test_folds_keep_no_history(spark):
    """A key of very many events; nulls are a key; times that are missing pass nothing."""
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id % 50 as string) end k", "timestamp_seconds(id * 7) at", "id")
    got = timelines.cooldown(df, "k", "at", "id", 100).groupBy("k").count().collect()
    assert len(got) == 52 and {r.k: r["count"] for r in got}["hot"] == len(range(0, 60_000, 15))
    batches = timelines.anchored_batches(df.where("k = 'hot'"), "k", "at", "id", 100).collect()
    assert sum(r.n_events for r in batches) == 20_000 and len(batches) == 4_000
    assert timelines.cooldown(df.withColumn("at", F.lit(None).cast("timestamp")), "k", "at", "id", 9).count() == 0
