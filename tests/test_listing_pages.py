import hashlib
import json
import random

from sievework.sources import listing_pages

PAGES = "tenant string, page int, payload string, error string, extra string"


def walk(tenant, size, most):
    """Pages read one after another. (used pages, postings, total, anomalies, reason, status)"""
    seen, had, total, marks, anomalies, used = 0, 0, None, set(), 0, []
    def end(reason, failed=False):
        return used, had, total, anomalies, reason, "failed" if failed else "degraded" if reason else "complete"
    for page, payload, error in tenant:
        try:
            body = json.loads(payload) if payload is not None else None
        except ValueError:
            body = None
        records, said = (body.get("jobPostings"), body.get("total")) if isinstance(body, dict) else (None, None)
        if error or not isinstance(records, list) or not (said is None or isinstance(said, int)):
            return end(error or "schema_error", had == 0)
        mark = hashlib.sha256(json.dumps(records, sort_keys=True).encode()).digest()
        if records and mark in marks:
            return end("pagination_repeated_page", had == 0)
        marks.add(mark)
        used.append(page)
        seen += len(records)
        had += sum(isinstance(r, dict) and bool(r.get("title", "").strip()) and bool(r.get("externalPath", "").strip()) for r in records)
        if said is None:
            anomalies += total is not None
        elif said != total:
            anomalies += total is not None or said < seen
            if said >= seen and said >= 0:
                total = max(total or 0, said)
        if len(records) < size:
            return end("pagination_ended_early" if total is not None and seen < total else None)
        if total is not None and seen >= total:
            return end(None)
        if len(used) >= most:
            return end("pagination_safety_limit_reached")
    return end("pagination_recording_ended")


def test_walk_against_reading_in_order(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for t in range(300):
        tenant = []
        for page in range(rng.randrange(1, 8)):
            records = [rng.choice([{"title": rng.choice("abcdef"), "externalPath": "/x"}, {"externalPath": "/x", "title": rng.choice("abcdef")}, {"title": " "}, "text", {"title": "t"}, {"externalPath": "/y"}]) for _ in range(rng.choice([2, 2, 2, 2, 1, 0]))]
            body = {"jobPostings": records, "total": rng.choice([2, 4, 6, 8, 12, 0, -1, None])}
            if rng.random() < 0.2:
                del body["total"]
            payload = rng.choice([json.dumps(body)] * 20 + ["[1]", "{", '{"jobPostings": 3}', json.dumps(body | {"total": "many"}), None])
            tenant.append((page, payload, rng.choice([None] * 20 + ["request_timeout"])))
        name = f"t{t}" if t else None
        want[name] = walk(tenant, 2, 3)
        rows += [(name, *x, "clash") for x in tenant]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, PAGES).withColumnRenamed("extra", "total").repartition(5)
    w = listing_pages.walked(pages, 2, 3)
    used = {}
    for r in w.where("used").collect():
        used.setdefault(r.tenant, []).append(r.page)
    got = {r.tenant: (sorted(used.get(r.tenant, [])), r.postings, r.total, r.anomalies, r.reason, r.status) for r in listing_pages.coverage(w).collect()}
    assert got == want
    assert len({x[4] for x in want.values()}) >= 7 and {x[5] for x in want.values()} == {"complete", "degraded", "failed"}
    records = listing_pages.records_of(pages, w)
    assert records.where("reject is null").count() == sum(x[1] for x in want.values())
    assert {r.reject for r in records.select("reject").distinct().collect()} == {None, "posting_not_object", "missing_title", "missing_external_path", "missing_title_and_external_path"}


def test_no_pages(spark):
    w = listing_pages.walked(spark.createDataFrame([], PAGES), 2)
    assert w.count() == 0 and listing_pages.coverage(w).count() == 0


def test_a_tenant_of_many_pages_is_walked_by_windows(spark):
    """No array of a tenant's pages is made, and payloads are not among what the windows shuffle."""
    pages = spark.range(3000).selectExpr("CASE WHEN id >= 0 THEN 't' END AS tenant", "CAST(id AS int) AS page", """'{"jobPostings":[{"title":"a","externalPath":"/' || id || '"}],"total":5000}' AS payload""", "CAST(NULL AS string) AS error")
    w = listing_pages.walked(pages, 1)
    assert w.where("used").count() == 500 and listing_pages.coverage(w).first().reason == "pagination_safety_limit_reached"
    assert "collect_list" not in w._jdf.queryExecution().optimizedPlan().toString()
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_details(spark):
    rows = [
        ("a", 0, 0, "Software Intern", "/1", "2 Locations", "Posted Today", "R1"), ("a", 0, 1, "Engineer", "/1", "Here", "2024-01-01", "R1"),
        ("a", 0, 2, "Campus Lead", "/2", "", "", ""), ("a", 1, 0, "Co-op", "/3", "x", "y", "R3"), ("a", 1, 1, "Chef", "/4", "x", "y", ""),
        ("a", 1, 2, "Summer 2026 Analyst", "/5", "x", "2024-01-01", ""), ("a", 1, 3, "Student", "/6", "x", "y", ""), ("a", 1, 4, "Interns", "", "x", "y", ""),
        ("b", 0, 0, "Intern", "/1", "x", "y", ""), ("b", 0, 1, "Intern", "/2", "x", "y", ""),
    ]
    listings = spark.createDataFrame(rows, "tenant string, page int, place int, title string, path string, location string, date_posted string, requisition_id string")
    info = lambda **x: json.dumps({"jobPostingInfo": x})
    details = spark.createDataFrame(
        [("a", "/1", 500, None), ("a", "/1", 200, info(jobReqId="R1", jobDescription="<p>Do &amp; learn</p>", location="Oslo", startDate="2024-02-02")), ("a", "/2", 410, None), ("a", "/3", 200, info(jobReqId="R9", jobDescription="no")), ("a", "/5", 200, info(location="Rome")), ("a", "/6", 200, "[]"), ("b", "/1", 503, None), ("b", "/2", 503, None)],
        "tenant string, path string, status int, payload string",
    )
    out = listing_pages.with_details(listings, details)
    got = {(r.tenant, r.page, r.place): r for r in out.collect()}
    assert len(got) == len(rows)
    one, two = got["a", 0, 0], got["a", 0, 1]
    assert (one.detail_status, one.detail_reason, one.location, one.date_posted, one.description) == ("enriched", "internship", "Oslo", "2024-02-02", "Do & learn")
    assert (two.detail_status, two.detail_reason, two.location, two.date_posted) == ("enriched", "internship", "Here", "2024-01-01")
    assert (got["a", 0, 2].detail_status, got["a", 0, 2].active) == ("disappeared", False)
    assert (got["a", 1, 0].detail_error, got["a", 1, 0].description, got["a", 1, 0].active) == ("requisition_id_conflict", "", True)
    assert got["a", 1, 1].detail_status == "not_selected" and got["a", 1, 4].detail_status == "not_selected"
    assert (got["a", 1, 2].detail_status, got["a", 1, 2].detail_reason, got["a", 1, 2].location) == ("success", "season_year", "x")
    assert got["a", 1, 3].detail_error == "schema_error"
    counts = {r.tenant: r[1:] for r in listing_pages.detail_coverage(out).collect()}
    assert counts == {"a": (5, 2, 2, 1, None), "b": (2, 0, 2, 0, "request_failed")}
    refused = listing_pages.with_details(listings, details, most=4).where("tenant = 'a' and detail_reason is not null").select("detail_error").distinct().collect()
    assert [r[0] for r in refused] == ["candidate_limit"]
