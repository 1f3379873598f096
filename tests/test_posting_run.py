import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import decisions, fit, roles
from sievework.plans import posting_queries, posting_run

def today():
    return F.lit("2026-06-09").cast("date")



@pytest.fixture(scope="module")
def classes(spark):
    return {r.k: r.role_class for r in roles.with_role(posting_queries._postings(spark)).collect()}


def test_rows_worked_out_by_hand(spark, classes):
    assert {k: (c.role, c.role_track, c.confidence) for k, c in classes.items()} == {r[0]: r[5:] for r in posting_queries.ROLE_ROWS}
    f = fit.with_fit(roles.with_role(posting_queries._postings(spark)), fit.Profile())
    got = {r.k: (r.fit.score, r.fit.explanation) for r in f.collect()}
    assert all(got[k] == (score, said) for k, score, said in posting_queries.FIT_ROWS)
    at = spark.createDataFrame([r[:3] for r in posting_queries.PLACE_ROWS], "k int, location string, remote_status string")
    assert {r.k: r.score for r in at.select("k", fit.place(posting_queries.PROFILE)["score"].alias("score")).collect()} == {r[0]: r[3] for r in posting_queries.PLACE_ROWS}


def test_evidence_of_roles(classes):
    assert classes[1].evidence == ['title: "Backend"'] and classes[1].software_evidence == ["APIs", "Java with backend/API context"]
    assert classes[1].role_track_label == "Backend software" and classes[1].label == "Software engineering"
    assert classes[2].non_swe_evidence == ["non_technical: Data Entry"]
    assert classes[3].evidence == ['business-strategy title: "Strategy Intern"'] and classes[3].non_swe_evidence == ["non_technical: Strategy Intern"]
    assert classes[9].software_evidence == ["Data & AI Intern - Analyst"]
    assert classes[10].evidence == ['non-SWE title signal "Product Manage" overridden by clear software duties'] or classes[10].evidence[0].startswith("non-SWE title signal")
    assert classes[15].non_swe_evidence == ["mechanical_manufacturing: Mechanical Engineer"]
    assert classes[25].evidence == ["No clear role signals in the title or description."] and classes[25].software_evidence == []


def test_capitals_with_accents(spark):
    titles = ["Ingeniería informática", "INGENIERÍA INFORMÁTICA", "szoftverfejlesztő", "SZOFTVERFEJLESZTŐ", "DÉVELOPPEUR IA ET AUTOMATISATION", "développeur ia et automatisation"]
    df = spark.createDataFrame([(t, "", "", "") for t in titles], "title string, company string, description string, requirements string")
    got = {r.title: r.role_class.role_track for r in roles.with_role(df).collect()}
    assert all(got[t] == got[t.lower()] for t in titles if t.lower() in got) and got["INGENIERÍA INFORMÁTICA"] != "unknown"


def test_scored_postings(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text(
        "Company Name,Job Title,location,Pay,Description,Qualifications,Link,Posted,Apply By,Remote?,Type\n"
        'Acme,Backend Intern,"Boston, MA",$40/hr,"Own a project end-to-end with mentorship. 12-week program. Build APIs.","Python, SQL, Docker",,,2026-06-12,Remote,\n'
        "Helpers,Marketing Intern,Austin,unpaid,Data entry and cold calls. Pay a training fee.,,,,2026-05-01,,\n"
        "Bolts,Mechanical Engineer Intern,Austin,$20/hr,CAD work with a mentor.,,,,,On-site,\n"
    )
    out, report = posting_run.run(spark, str(path), posting_queries.PROFILE, today())
    rows = {r.company: r for r in out.collect()}
    a, h, b = rows["Acme"], rows["Helpers"], rows["Bolts"]
    assert a.categories.compensation == 100 and a.categories.location_convenience == 100 and a.deadline_days_left == 3
    assert a.watcher_eligible and a.bucket == "high" and a.action == "apply_now" and a.watcher_action == "apply_now"
    # 82 for the track and 4 for each of Python, SQL and service work
    assert a.fit_score == 94 and a.reasons[0] == "Role fit: " + a.fit_explanation
    assert not h.watcher_eligible and h.fit_score == 0 and h.total <= 40 and h.bucket == "low" and h.action == "skip" and h.deadline_days_left == -39
    assert h.concerns[0].startswith("Non-technical role outside") and "Deadline has already passed" in h.concerns
    assert b.role_track == "mechanical_manufacturing" and b.total <= 44 and b.action_label == "Skip"
    assert [r.company for r in out.collect()][0] == "Acme" and report.count() == 0


def test_plan_has_no_shuffle_and_no_python(spark):
    rows = spark.range(3).selectExpr(*(f"cast(id as string) {c}" for c in ("title", "company", "location", "remote_status", "compensation", "description", "requirements", "deadline", "internship_type")))
    plan = posting_run.scored(rows, fit.Profile(), today())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|EvalPython|PythonUDF|InArrow|InPandas", plan)


def test_excluded_postings(spark):
    rows = posting_queries._postings(spark).where("k = 1").selectExpr("*", "'' location", "'' remote_status", "'$30/hr' compensation", "'' deadline", "'' internship_type", "'phd_only' why")
    r = posting_run.scored(rows, fit.Profile(), today(), "why").first()
    assert r.fit_score == 0 and r.watcher_ineligible_reason == "phd_only" and r.action == "skip" and r.concerns[0] == "phd_only"


def test_pay_text(spark):
    rows = [("paid", "x", 30.0, 30.0, False), ("paid", "x", 8.5, 12.0, True), ("unpaid", "", 0.0, 0.0, False), ("unknown_vague", "", None, None, False), ("unknown_vague", "competitive", None, None, False), ("unknown", "x", None, None, False)]
    df = spark.createDataFrame(rows, "kind string, raw string, usd_hourly_min double, usd_hourly_max double, period_assumed boolean")
    got = [r[0] for r in df.select(decisions.pay_text(F.struct("*"))).collect()]
    assert got == ["$30/hr", "$8.50–$12/hr (est.)", "Unpaid", "Vague", "competitive", "—"]
