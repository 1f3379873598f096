import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievework.functions import dates, pay, urls
from sievework.operators import dedupe, health, joins
from sievework.plans import ask
from sievework.sources import csv_postings
from sievework.streaming import states

CSV = """﻿Company Name;Job Title;location;Pay;Description;Link;Apply By;Remote?;Internal ID;Notes
Acme, Inc.;Backend Intern;New York, NY;$30/hr;Build APIs. Remote friendly;https://jobs.lever.co/acme/abc-1;June 21st, 2026;;7;n/a
ACME;Backend Intern;New York;;;https://jobs.lever.co/acme/abc-1?utm_source=x;;;8;hello
;;;;;;;;;
Beta LLC;Summer Data Intern;;80-90k;"Line one
line two; quoted";;rolling;Remote;9;-
"""


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "postings.csv"
    path.write_text(CSV, encoding="utf-8")
    return csv_postings.read_csv(spark, str(path))


def test_csv(rows):
    df, mapping = rows
    got = {r.pos: r for r in csv_postings.infer_fields(df).collect()}
    assert len(got) == 3 and mapping.fields["Pay"] == "compensation" and mapping.fields["Remote?"] == "remote_status"
    assert "Internal ID" in mapping.unmapped and "Notes" in mapping.unmapped
    a, b, c = (got[k] for k in sorted(got))
    assert a.extra == {"Internal ID": "7"} and b.extra == {"Internal ID": "8", "Notes": "hello"}
    assert a.inferred == ["remote_status"] and a.remote_status == "Remote"
    assert c.location == "Remote" and c.internship_type == "Summer" and c.description == "Line one\nline two; quoted"


def test_headers():
    m = csv_postings.map_headers(["Company", "employer", "Job ID", "Apply by date", "zzz", ""])
    assert m.fields == {"Company": "company", "Apply by date": "deadline"}
    assert m.collisions == [("employer", "company")] and m.unmapped == ["employer", "Job ID", "zzz", ""]


def test_errors(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    for name in ("empty.csv", "twice.csv"):
        with pytest.raises(ValueError):
            csv_postings.read_csv(spark, str(tmp_path / name))


PAY = [
    (None, "unknown", None, None, 0.0), ("", "unknown", None, None, 0.0), ("$25/hr", "paid", "hourly", 25.0, 0.9), ("$80-90k", "paid", "annual", 38.46, 0.55), ("unpaid", "unpaid", None, 0.0, 0.95),
    ("not unpaid, $20 per hour", "paid", "hourly", 20.0, 0.9), ("401(k), 40 hrs/week, $30 hourly", "paid", "hourly", 30.0, 0.9), ("competitive", "unknown_vague", None, None, 0.6),
    ("stipend provided", "stipend_unspecified", None, None, 0.5), ("equity only, 0.5%", "equity_only", None, None, 0.9), ("commission only", "commission_only", None, None, 0.9),
    ("$1,000 total for the summer", "paid", "term", 2.08, 0.9), ("15", "paid", "hourly", 15.0, 0.45), ("12-week program $22", "paid", "hourly", 22.0, 0.55),
]


def test_pay(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAY)], "i int, t string")
    got = {r.i: r.pay for r in pay.with_pay(df, "t").collect()}
    for i, (_, kind, period, low, sure) in enumerate(PAY):
        assert (got[i].kind, got[i].period, got[i].usd_hourly_min, got[i].confidence) == (kind, period, low, sure), PAY[i]


def test_dates_and_seasons(spark):
    day = dt.date(2026, 6, 7)
    shown = {"2026-6-7": day, "06/07/2026": day, "6/7/26": day, "6-7-2026": day, "June 7th, 2026": day, "Jun 7 2026": day, "7 June 2026": day, "rolling": None, "2026-13-01": None, "6/7/75": dt.date(1975, 6, 7), "n/a": None}
    df = spark.createDataFrame([(k,) for k in shown], "t string").select("t", dates.parse_date("t").alias("d"))
    assert {r.t: r.d for r in df.collect()} == shown
    s = {"Summer 2026": "summer:2026", "autumn '26": "fall:2026", "2027 Spring": "spring:2027", "Summer": None}
    df = spark.createDataFrame([(k,) for k in s], "t string").select("t", dates.season_key("t").alias("k"))
    assert {r.t: r.k for r in df.collect()} == s


def test_urls(spark):
    want = {
        "HTTP://Boards.greenhouse.io/acme/jobs/12/?gh_jid=12&utm_source=x&b=2&a=1&a=1#top": ("https://job-boards.greenhouse.io/acme/jobs/12?a=1&b=2", True),
        "example.com/jobs": ("https://example.com/jobs", False), "https://x.com/#/jobs/44": ("https://x.com#posting_id=44", True), "": ("", False), "https://x.com/a/b?q=dev": ("https://x.com/a/b?q=dev", False),
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", urls.posting_url("t").alias("u"), urls.names_one_posting("t").alias("one"))
    assert {r.t: (r.u, r.one) for r in df.collect()} == want


def posting(pos, company="Acme", title="Intern", location="NYC", url="", **more):
    return {"pos": pos, **dict.fromkeys(dedupe.FIELDS, ""), "company": company, "title": title, "location": location, "source_url": url, **more}


def test_dedupe(spark):
    lever = "https://jobs.lever.co/acme/"
    rows = [
        posting(1, url=lever + "a1"), posting(2, url=lever + "a2"), posting(3, company="Acme Inc", url=lever + "a1?ref=z", description="long"),
        posting(4, "Beta", "C++ Dev"), posting(5, "beta llc", "c++ dev", deadline="June 1 2026"), posting(6, "Beta", "C Dev"),
        posting(7, "Gamma", "X", url="https://gamma.com/careers"), posting(8, "Gamma", "Y", url="https://gamma.com/careers"), posting(9, "", "", ""),
        posting(10, "Delta", "実習生"), posting(11, "Delta", "技術者"), posting(12, "Delta", "実習生"),
    ]
    schema = "pos long, " + ", ".join(f"{f} string" for f in dedupe.FIELDS)
    df = spark.createDataFrame([tuple(r[c] for c in ("pos", *dedupe.FIELDS)) for r in rows], schema)
    for frame in (df.orderBy(F.desc("pos")).repartition(3),):
        kept, report = dedupe.deduplicated(frame)
        kept = {r.pos: r for r in kept.collect()}
        assert set(kept) == {1, 2, 4, 6, 7, 8, 9, 10, 11}
        assert kept[1].description == "long" and kept[4].deadline == "June 1 2026"
        assert {(r.pos, r.duplicate_of, r.matched_on, tuple(r.merged_fields)) for r in report.collect()} == {(3, 1, "requisition_id", ("description",)), (5, 4, "company+title+location", ("deadline",)), (12, 10, "company+title+location", ())}


def test_questions():
    p = ask.interpret("Show paid data science internships only")
    assert (p.intent, p.role, p.paid_only, p.unpaid_only) == ("best_for_role", "data_science", True, False)
    assert ask.interpret("Which ones look exploitative?").intent == "exploitative"
    p = ask.interpret("best backend experience")
    assert p.want_backend and p.role == "swe"
    assert ask.interpret("kubernetes terraform").keywords == ("kubernetes", "terraform") and ask.interpret(" ").intent == "help"


JOBS = (
    "pos long, id string, company string, title string, description string, requirements string, location string, remote_status string, role string, role_track string, is_startup boolean, company_evidence array<string>, "
    "total int, role_relevance int, technical_depth int, bucket string, action string, action_label string, deadline_days_left int, compensation struct<kind:string>, red_flags array<struct<severity:string,label:string>>, positive_signals array<struct<id:string>>, reasons array<string>"
)


def test_answers(spark):
    def job(pos, total, kind="paid", flags=(), signals=(), days=None, company="Acme", startup=False, track="backend", remote="Remote", text="python"):
        return (pos, f"j{pos}", company, f"T{pos}", text, "", "NYC", remote, "swe", track, startup, ["Small team of 8"] if startup else [], total, total, 50, "high" if total >= 70 else "low", "apply_now" if total >= 70 else "skip", "Label", days, (kind,), [(s, s) for s in flags], [(s,) for s in signals], ["good pay"])

    jobs = spark.createDataFrame([job(1, 80, days=3), job(2, 60, "unpaid", ("critical", "major"), days=5), job(3, 75, flags=("major",), startup=True), job(4, 75, startup=True, company=" acme "), job(5, 40, track="data", text="rust", signals=("backend_focus",))], JOBS)
    ids = lambda q: [r.id for r in ask.ask(q, jobs).collect()]
    assert ids("avoid scams") == ["j2", "j3"]
    assert ids("apply tonight") == ["j1", "j2", "j3", "j4"]
    assert ids("startups") == ["j3"]
    assert ids("rust") == ["j5"] and ids("") == []
    assert ids("unpaid") == ["j2"] and ids("best backend") == ["j1", "j3", "j4", "j2", "j5"]
    assert [r.id for r in ask.list_jobs(jobs, paid_only=True, min_score=75, q="ACME").orderBy("pos").collect()] == ["j1", "j3", "j4"]


def test_health(spark):
    t = dt.datetime(2026, 1, 1)

    def attempt(seq, key, kind, made, ok, n=None, whole=True):
        figures = (0, 0, 0, 0, False, False, False, True) if whole else (None,) * 8
        return (key, kind, "c", made, ok, n, None if ok else "timeout", t + dt.timedelta(hours=seq), *figures, seq)

    rows = [attempt(i, "feed", "github_feed", True, ok, 5) for i, ok in enumerate([True, False, False, False, True])]
    rows += [attempt(10, "d", "direct", True, True, 0), attempt(11, "d", "direct", True, True, 0), attempt(12, "d", "direct", False, None), attempt(13, "d", "direct", True, False), attempt(14, "d", "direct", True, True, 3), attempt(15, "d", "direct", True, True, 3, whole=False)]
    df = spark.createDataFrame(rows, health.ATTEMPT + ", seq long")
    got = {(r.health_key, r.seq): r for r in health.health_states(df.repartition(3)).collect()}
    assert [got["feed", i].status for i in range(5)] == ["healthy", "degraded", "degraded", "failing", "healthy"]
    assert [got["feed", i].consecutive_failures for i in range(5)] == [0, 1, 2, 3, 0] and got["feed", 4].recovery
    assert [got["d", i].status for i in range(10, 16)] == ["healthy_empty", "healthy_empty", "not_configured", "failed", "healthy_with_listings", "unknown"]
    assert [got["d", i].consecutive_zero_successes for i in range(10, 15)] == [1, 2, 2, 0, 0]
    assert got["d", 12].total_attempts == 2 and got["d", 13].last_rows_returned is None and got["d", 13].last_error_kind == "timeout"
    now = {r.health_key: r.status for r in health.current_states(health.health_states(df)).collect()}
    assert now == {"feed": "healthy", "d": "unknown"}
    who = spark.createDataFrame([("c", "d"), ("e", "none")], "company string, health_key string")
    assert {r.company: r.coverage for r in health.coverage(who, df, health.current_states(health.health_states(df))).collect()} == {"c": "feed_only", "e": "feed_only"}


def test_stream_of_attempts_equals_batch(spark, tmp_path):
    rows = [("a", i, i % 3 != 1) for i in range(6)] + [("b", i, False) for i in range(4)]
    schema = "health_key string, seq long, succeeded boolean"
    for k, part in enumerate((rows[:5], rows[5:], rows[3:7])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = states.attempt_counters(stream).writeStream.outputMode("update").format("memory").queryName("counters").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("counters").collect():
        if r.total_attempts >= got.get(r.health_key, (0,))[0]:
            got[r.health_key] = (r.total_attempts, r.total_successes, r.consecutive_failures)
    assert got["b"] == (4, 0, 4) and got["a"][0] == 6


def test_observe_again_changes_nothing(spark, tmp_path):
    schema = "identity string, title string, first_seen timestamp, last_seen timestamp, season_key string, absence_epoch int"
    batch = "identity string, title string, observed_at timestamp, season_key string"
    d = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    seen = spark.createDataFrame([("a", "A", d(0), d(1), "summer:2026", 0), ("b", "B", d(0), d(0), None, 0), ("c", "C", d(0), d(0), "fall:2026", 1)], schema)
    new = spark.createDataFrame([("a", "A2", d(2), "summer:2027"), ("b", "", d(20), None), ("d", "D", d(20), "")], batch)
    once = states.observe(seen, new)
    assert {r.identity: (r.title, r.season_key, r.absence_epoch, r.event) for r in once.collect()} == {"a": ("A2", "summer:2027", 0, "season_changed"), "b": ("B", None, 1, "absence"), "c": ("C", "fall:2026", 1, None), "d": ("D", None, 0, "new")}
    again = states.observe(once.drop("event"), new)
    assert sorted(map(str, again.drop("event").collect())) == sorted(map(str, once.drop("event").collect())) and again.where("event is not null").count() == 0


def test_upsert_and_tiers(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id int, name string, at int")
    new = spark.createDataFrame([(1, "", 4), (2, "c", 6), (3, "d", 1)], "id int, name string, at int")
    got = {r.id: (r.name, r.at, r.outcome) for r in joins.upsert(old, new, "id", ["name"], ["at"]).collect()}
    assert got == {1: ("a", 5, "unchanged"), 2: ("c", 6, "updated"), 3: ("d", 1, "inserted")}
