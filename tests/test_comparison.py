import random

import pytest

from sievework.operators import comparison as cmp

POSTING = "id string, company string, title string, identity string, requisition string, url string, sources array<string>, final_reason string, generic_url boolean, position int"
DUPLICATE = "position int, kept_identity string, company string, title string, reason string"


@pytest.fixture(scope="module")
def run():
    rng = random.Random(8)
    companies, titles = ["Acme Inc", "ACME", "Bolt", None, ""], ["Intern A", "intern a!", "Intern B", None]
    reasons = ["pending", "closed", "outside_us", "phd_only", "already_emailed"]
    postings = [(f"p{i:03}", rng.choice(companies), rng.choice(titles), f"u{rng.randrange(90):02}", rng.choice(["", None, *(f"r{n}" for n in range(40))]), "x", rng.sample(["direct_ats", "f1", "f2"], rng.randint(0, 3)), rng.choice(reasons), rng.choice([None, False, False, True]), i) for i in range(200)]
    duplicates = [(i, rng.choice(["", None, *(f"u{n:02}" for n in range(90))]), rng.choice(companies), rng.choice([*titles, "Other"]), f"why {i}") for i in range(30)]
    return postings, duplicates


def role(row, at=1):
    key = " ".join(w for w in "".join(c if c.isalnum() else " " for c in (row[at] or "").lower()).split() if w != "inc")
    return key, " ".join("".join(c if c.isalnum() else " " for c in (row[at + 1] or "").lower()).split())


def related(p, duplicates):
    return [d for d in duplicates if d[1] and d[1] == p[3] or role(p) == role(d, 2) or len(p[6]) > 1 and role(p)[1] == role(d, 2)[1]]


@pytest.mark.parametrize("most", [25, 4])
def test_similar_requisitions(spark, run, most):
    postings, _ = run
    want = {}
    for p in postings:
        if p[4]:
            first = {}
            for o in postings:
                if o[4] and o[4] != p[4] and role(o) == role(p):
                    first.setdefault(o[4], (o[3], o[4]))
            want[p[0]] = sorted(first.values())[:most]
    got = {r.id: [(s.identity, s.requisition) for s in r.similar] for r in cmp.similar_requisitions(spark.createDataFrame(postings, POSTING), most).collect()}
    assert got == want


def test_related_duplicates_are_counted_and_listed(spark, run):
    postings, duplicates = run
    p, d = spark.createDataFrame(postings, POSTING), spark.createDataFrame(duplicates, DUPLICATE)
    want = {x[0]: [y[0] for y in related(x, duplicates)] for x in postings}
    assert {r.id: r.duplicate_sightings for r in cmp.with_related_counts(p, d).collect()} == {k: len(v) for k, v in want.items()}
    assert {r.id: [x.position for x in r.diagnostics] for r in cmp.related_duplicates(p, d).collect()} == {k: v for k, v in want.items() if v}


def entries(spark, run):
    postings, duplicates = run
    watched = spark.createDataFrame([("Acme", ["ACME LLC"]), ("Bolt", None), ("Nobody", ["None Such"]), ("Quiet", None)], "company string, names array<string>")
    coverage = spark.createDataFrame([("Bolt Inc", 1, "healthy", "direct", True), ("bolt", 2, "failed", "", False), ("Quiet", 1, "", "uncovered", True)], "company string, position int, direct_status string, direct_coverage string, backstop boolean")
    p, d = spark.createDataFrame(postings, POSTING), spark.createDataFrame(duplicates, DUPLICATE)
    return p, d, cmp.summaries(p, d, watched, coverage)


def test_summaries_and_selection(spark, run):
    p, d, e = entries(spark, run)
    rows = e.collect()
    assert len(rows) == 202 and sorted(r.company for r in rows if r.id is None) == ["Nobody", "Quiet"]
    assert {r.direct_status for r in rows if r.company == "Bolt"} == {"failed"}
    counts = {r.category: r.n for r in cmp.category_counts(e).collect()}
    assert set(counts) == set(cmp.CATEGORIES) and sum(counts.values()) == 202 and counts["no_postings"] == 2
    everything = cmp.select_details(e, per_reason=1000, most=1000).collect()
    assert len(everything) == 202 and sorted(r.display for r in everything) == list(range(1, 203))
    routine = lambda r: r.priority == 4
    assert [r for r in everything if r.company == "Bolt" and r.category == "collected_rejected" and r.priority != 1] == []
    few = cmp.select_details(e, per_reason=2, most=1000).collect()
    for reason in {r.final_reason for r in everything if routine(r)}:
        assert sorted(r.sample_key for r in few if routine(r) and r.final_reason == reason) == sorted(r.sample_key for r in everything if routine(r) and r.final_reason == reason)[:2]
    cut = cmp.select_details(e, per_reason=2, most=9).collect()
    assert sorted((r.priority, r.sample_key) for r in cut) == sorted((r.priority, r.sample_key) for r in few)[:9]


def test_details_of_the_selected(spark, run):
    postings, duplicates = run
    p, d, e = entries(spark, run)
    kept = cmp.select_details(e, per_reason=2, most=60)
    got = cmp.details(kept, p, d).collect()
    by_id = {x[0]: x for x in postings}
    assert len(got) == 60
    for r in got:
        if r.id is None:
            assert r.trace is None
            continue
        t = r.trace
        assert [x.position for x in t.deduplication.merge_diagnostics] == [y[0] for y in related(by_id[r.id], duplicates)] and t.deduplication.duplicate_sightings == r.duplicate_sightings
        assert t.sources.direct_found == ("direct_ats" in by_id[r.id][6]) and t.decision.pending == (r.final_reason == "pending")


def test_nothing_at_all(spark, run):
    p, d, _ = entries(spark, run)
    empty = cmp.summaries(p.limit(0), d.limit(0), spark.createDataFrame([], "company string, names array<string>"), spark.createDataFrame([], "company string, position int, direct_status string, direct_coverage string, backstop boolean"))
    assert cmp.details(cmp.select_details(empty), p.limit(0), d.limit(0)).count() == 0 and {r.n for r in cmp.category_counts(empty).collect()} == {0}


def test_source_totals(spark):
    attempts = spark.createDataFrame([("a", "direct", True), ("b", "direct", False), ("c", "github_feed", True), ("d", "github_feed", False), ("e", "direct", None)], "health_key string, source_kind string, succeeded boolean")
    states = spark.createDataFrame([("a", "healthy_empty"), ("b", "failed")], "health_key string, status string")
    r = cmp.source_totals(attempts, states).first()
    assert (r.direct_empty, r.direct_failed, r.direct_unknown, r.github_healthy, r.github_failed, r.direct_healthy) == (1, 1, 1, 1, 1, 0)


@pytest.mark.parametrize("most", [5, 40, 1000])
def test_selection_that_looks_up_few_is_the_selection_of_all(spark, run, most):
    postings, duplicates = run
    # most of 5 is filled by postings that a source kept, the others aren't
    assert 5 < sum(p[7] == "pending" for p in postings) < 1000
    p, d, e = entries(spark, run)
    watched = spark.createDataFrame([("Acme", ["ACME LLC"]), ("Bolt", None), ("Nobody", ["None Such"]), ("Quiet", None)], "company string, names array<string>")
    coverage = spark.createDataFrame([("Bolt Inc", 1, "healthy", "direct", True), ("bolt", 2, "failed", "", False), ("Quiet", 1, "", "uncovered", True)], "company string, position int, direct_status string, direct_coverage string, backstop boolean")
    want = cmp.select_details(e, per_reason=2, most=most)
    got = cmp.selected(p, d, watched, coverage, per_reason=2, most=most)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if most == 5:
        # counts of duplicates meet the few alone: a table of five rows is all that is read of the postings
        assert "/first-" in got._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_trace(spark, run):
    p, d, e = entries(spark, run)
    kept = cmp.select_details(e, per_reason=2, most=30)
    whole = {r.display: r.trace for r in cmp.details(kept, p, d).collect()}
    part = cmp.details(kept, p, d, parts=["deduplication", "decision"])
    assert part.schema["trace"].dataType.names == ["deduplication", "decision"]
    assert {r.display: r.trace and tuple(r.trace) for r in part.collect()} == {k: t and (t.deduplication, t.decision) for k, t in whole.items()}
