import json

from sievework.sources import boards, markdown_tables

PAYLOADS = {
    "greenhouse": {"jobs": [{"id": 7, "title": "Data Intern", "absolute_url": "https://boards.example.com/7", "location": {"name": "NYC"}, "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "first_published": "2026-01-02T03:04:05Z", "metadata": [{"name": "Employment Type", "value": "Intern"}], "other": 1}, {"id": 8, "title": "", "absolute_url": "https://x.example"}, None]},
    "lever": [{"id": "a", "text": "Dev", "hostedUrl": "https://l.example/a", "descriptionPlain": "D", "createdAt": 1700000000000, "categories": {"location": "Rome", "allLocations": ["Rome", "Oslo", "Rome"]}, "lists": [{"text": "Requirements", "content": "<li>SQL</li>"}, {"text": "Perks", "content": "x"}], "salaryRange": {"min": 50000, "max": 70000, "currency": "EUR", "interval": "per-year-salary"}}],
    "ashby": {"jobs": [{"id": "1", "title": "A", "location": "Paris", "secondaryLocations": [{"location": "Lyon"}], "isRemote": True, "jobUrl": "https://a.example/1"}, {"id": "2", "title": "B", "isListed": False, "jobUrl": "https://a.example/2"}]},
    "workable": {"total": 1, "results": [{"shortcode": "S", "title": "W", "location": {"city": "Bern", "country": "CH"}, "remote": True, "published": "2026-05-06"}]},
    "smartrecruiters": {"totalFound": 1, "content": [{"id": "9", "name": "S", "company": {"identifier": "Co"}, "location": {"city": "Ulm", "remote": True}}]},
    "workday": {"total": 1, "jobPostings": [{"title": "K", "externalPath": "/job/K_R1", "locationsText": "2 Locations", "bulletFields": ["R1"]}]},
    "oracle_hcm": {"items": [{"requisitionList": [{"Id": "3", "Title": "O", "PrimaryLocation": "LA", "secondaryLocations": [{"Name": "SF"}, {"Name": "LA"}]}]}, {}]},
    "listings_feed": [{"id": "f", "company_name": "Zed", "title": "F", "locations": ["X", "Y"], "url": "https://z.example", "date_posted": 1700000000, "active": True, "terms": ["Summer 2026"]}, {"id": "g", "company_name": "Zed", "title": "G", "url": "https://z.example/g", "active": False}],
}


def test_boards(spark):
    got = {}
    for name, payload in PAYLOADS.items():
        df = spark.createDataFrame([("Acme", json.dumps(payload))], "company string, payload string")
        good, bad = boards.parse_payloads(df, name)
        got[name] = (good.collect(), [r.reason for r in bad.collect()])
    first = {k: v[0][0] for k, v in got.items()}
    assert all(len(v[0]) == 1 for v in got.values())
    assert first["greenhouse"].description == "Hi & bye" and first["greenhouse"].date_posted == "2026-01-02" and first["greenhouse"].internship_type == "Intern"
    assert sorted(got["greenhouse"][1]) == ["missing_title", "missing_title"]
    lever = first["lever"]
    assert (lever.location, lever.requirements, lever.compensation, lever.date_posted) == ("Rome; Oslo", "SQL", "EUR 50,000 - 70,000 per year", "2023-11-14")
    assert (first["ashby"].location, first["ashby"].remote_status) == ("Paris; Lyon", "Remote")
    assert (first["workable"].location, first["workable"].source_url) == ("Bern, CH", "https://apply.workable.com/j/S")
    assert first["smartrecruiters"].source_url == "https://jobs.smartrecruiters.com/Co/9" and first["workday"].source_id == "R1"
    assert first["oracle_hcm"].location == "LA; SF" and (first["listings_feed"].company, first["listings_feed"].internship_type) == ("Zed", "Summer 2026")
    assert all(r.company == "Acme" for k, r in first.items() if k != "listings_feed")
    _, bad = boards.parse_payloads(spark.createDataFrame([("Acme", "<html>")], "company string, payload string"), "ashby")
    assert [r.reason for r in bad.collect()] == ["malformed"]


def test_details_fill_blanks(spark):
    df = spark.createDataFrame([("Acme", json.dumps(PAYLOADS["workday"]))], "company string, payload string")
    good, _ = boards.parse_payloads(df, "workday")
    details = spark.createDataFrame([("/job/K_R1", "Long text", "Oslo")], "source_url string, description string, location string")
    r = boards.fill_from_details(good, details).first()
    assert (r.description, r.location, r.filled) == ("Long text", "2 Locations", ["description"])


TABLE = r"""intro | not a table

| Role | Company | Location | Apply | Added |
|:-----|---------|----------|-------|-------|
| **Dev** \| Ops 🔒 | [Acme](https://a.example) | NYC<br>LA | [Apply](https://x.example/a_(b)?c=1) | Jan 2 |
| | Acme | NYC | https://x.example/y. | — |
| QA | Beta | | [x](ftp://no) | Jan 3 |
| short |

| A | B |
|---|---|
| 1 | 2 |
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "t.md").write_text(TABLE, encoding="utf-8")
    got = [r.asDict() for r in markdown_tables.read_tables(spark, str(tmp_path)).orderBy("line").collect()]
    assert [r["reason"] for r in got] == [None, "missing_role", "invalid_apply_url", "column_count"]
    r = got[0]
    assert (r["title"], r["company"], r["location"], r["source_url"], r["added"], r["closed"], r["no_sponsorship"]) == ("Dev | Ops", "Acme", "NYC / LA", "https://x.example/a_(b)?c=1", "Jan 2", True, False)
