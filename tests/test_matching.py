import datetime as dt

from pyspark.sql import functions as F

from sievework.functions import posting_rules as rules
from sievework.plans import matching

def now():
    return F.lit("2026-03-01 00:00:00").cast("timestamp")


MATCHES = "user_id string, job_id string, reasons array<struct<code:string,value:string>>, matched_at timestamp, last_matched_at timestamp, no_longer_matches_at timestamp, saved_at timestamp, dismissed_at timestamp"


def test_decisions_and_lifecycle(spark):
    jobs = spark.createDataFrame(
        [("j1", "acme", "swe", "Intern Summer 2026", "Austin, TX", "", True, False), ("j2", "acme", "swe", "Intern", "Remote", "Remote", True, False), ("j3", "acme", "data", "Intern", "Berlin", "", True, True), ("j4", "acme", "swe", "Fall 2026 Intern", "Paris", "", True, True), ("j5", "acme", "swe", "x", "Austin", "", False, False), ("j6", "beta", "swe", "x", "Austin", "", True, False)],
        "job_id string, company_id string, role_id string, title string, location string, remote_status string, is_open boolean, outside_us boolean",
    )
    watches = spark.createDataFrame([("u1", "acme", False), ("u2", "acme", False), ("u3", "acme", True)], "user_id string, company_id string, paused boolean")
    prefs = spark.createDataFrame(
        [("u1", ["swe"], ["austin"], False, "Summer 2026"), ("u2", ["swe", "data"], ["USA", "Berlin"], True, "Any season"), ("u3", ["swe"], [], True, "Any season")],
        "user_id string, role_ids array<string>, preferred_locations array<string>, include_remote boolean, internship_season string",
    )
    d = matching.decide(jobs, watches, prefs)
    got = {(r.user_id, r.job_id): [x.code for x in r.reasons][2:] for r in d.collect()}
    assert got == {("u1", "j1"): ["location_preferred", "season_match"], ("u2", "j1"): ["location_united_states", "season_any"], ("u2", "j2"): ["location_united_states", "season_any"], ("u2", "j3"): ["location_preferred", "season_any"]}
    t = dt.datetime(2026, 1, 1)
    old = spark.createDataFrame([("u1", "j1", [("x", None)], t, t, None, t, None), ("u2", "j1", [], t, t, t, None, None), ("u9", "j9", [], t, t, None, None, t)], MATCHES)
    once = matching.reconciled(old, d, now())
    out = {(r.user_id, r.job_id): r for r in once.collect()}
    assert {k: r.outcome for k, r in out.items()} == {("u1", "j1"): "refreshed", ("u2", "j1"): "reactivated", ("u2", "j2"): "created", ("u2", "j3"): "created", ("u9", "j9"): "deactivated"}
    assert out["u1", "j1"].saved_at == t and out["u1", "j1"].matched_at == t and out["u2", "j1"].no_longer_matches_at is None
    again = matching.reconciled(once.drop("outcome"), d, F.lit("2026-04-01 00:00:00").cast("timestamp"))
    assert {r.outcome for r in again.collect()} == {"unchanged"}
    assert matching.view(once).count() == 4 and matching.view(once, "historical").count() == 1 and matching.view(once, "dismissed").count() == 1
    assert [r.job_id for r in matching.page(once, jobs, "u2", limit=2).collect()] == ["j3", "j2"]


def test_notifications(spark):
    t = dt.datetime(2026, 1, 1)
    created = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a"), ("u3", "a"), ("u4", "a")], "user_id string, job_id string")
    users = spark.createDataFrame([("u1", "as_detected", True), ("u2", "daily", True), ("u3", "every_3_hours", True), ("u4", "daily", False)], "user_id string, frequency string, enabled boolean")
    batches = spark.createDataFrame([("u2", "daily", "old", t, t), ("u2", "daily", "newer", t + dt.timedelta(1), t)], "user_id string, frequency string, batch_id string, created_at timestamp, due_at timestamp")
    sent = spark.createDataFrame([("u1", "b")], "user_id string, job_id string")
    got = {(r.user_id, r.job_id): r for r in matching.notifications(created, users, batches, sent, "run1", now()).collect()}
    assert set(got) == {("u1", "a"), ("u2", "a"), ("u3", "a")}
    assert got["u2", "a"].batch_id == "old" and got["u3", "a"].due_at == dt.datetime(2026, 3, 1, 3) and got["u1", "a"].due_at == dt.datetime(2026, 3, 1)


def test_gates(spark):
    want = {("Software Intern", ""): True, ("New Grad Intern", ""): False, ("Program Summer 2026", ""): True, ("Engineer, class of Summer 2026", ""): False, ("Engineer", "Co-op"): True, ("Engineer", ""): False}
    df = spark.createDataFrame(list(want), "title string, internship_type string").select("*", rules.is_internship().alias("is"))
    assert {(r.title, r.internship_type): r["is"] for r in df.collect()} == want
    df = spark.createDataFrame([(None, None), (False, 3), (True, -1), (True, 0)], "active boolean, deadline_days_left int").select(rules.is_open().alias("o"))
    assert [r.o for r in df.collect()] == [True, False, False, True]


def test_company_class(spark):
    rows = [
        ("Stripe, Inc.", "", "known", ("tech", 0.95)), ("Acme", "8-person team building python apis on aws", "", ("startup", 0.71)), ("Acme", "python, sql and docker", "", ("tech", 0.67)),
        ("Joe's", "a family bakery", "", ("non_tech", 0.6)), ("DataWorks", "python sql", "", ("tech", 0.8)), ("Foo", "seed stage", "", ("startup", 0.55)), ("Foo", "", "", ("unknown", 0.25)),
    ]
    df = spark.createDataFrame([(i, r[0], r[1], "", "") for i, r in enumerate(rows)], "i int, company string, description string, requirements string, title string")
    got = {r.i: r.company_class for r in rules.with_company_class(df, ("stripe",)).collect()}
    for i, r in enumerate(rows):
        assert (got[i].category, got[i].confidence) == r[3], r


def test_score_parts(spark):
    df = spark.createDataFrame(
        [([("a", "critical"), ("grunt_work", "minor")], [("reputable",), ("mentorship",)], "tech", ("paid", 0.9), 4, False, "Cover letter and two references; easy apply")],
        "flags array<struct<id:string,severity:string>>, signals array<struct<id:string>>, category string, pay struct<kind:string,confidence:double>, n int, software boolean, about string",
    )
    r = df.select(rules.legitimacy("flags", "signals", "category", "pay").alias("l"), rules.learning("flags", "signals").alias("e"), rules.technical_depth("n", "software").alias("t"), rules.effort("about").alias("f")).first()
    assert (r.l, r.e, r.t, r.f) == (60, 45, 35, 69)
