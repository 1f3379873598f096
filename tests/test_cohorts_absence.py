import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import absence, cohorts

START = datetime.datetime(2026, 1, 1)
STRATA = {"low": lambda r: r["score"] < 30, "mid": lambda r: 20 <= r["score"] < 70, "even": lambda r: r["score"] % 2 == 0, "rare": lambda r: r["score"] == 99, "x": lambda r: r["track"] == "x"}


def digest(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def table(seed, n=120):
    rng = random.Random(seed)
    return [{"id": f"j{i:03}", "score": rng.randrange(100), "track": rng.choice(["x", "y", "z", "w", None])} for i in range(n)]


def greedy(rows, n, seed):
    queues = [sorted((r["id"] for r in rows if test(r)), key=lambda i: (digest(str(seed), name, i), i)) for name, test in STRATA.items()]
    given, at = [], [0] * len(queues)
    while len(given) < n:
        before = len(given)
        for k, q in enumerate(queues):
            while at[k] < len(q) and q[at[k]] in given:
                at[k] += 1
            if at[k] < len(q) and len(given) < n:
                given.append(q[at[k]])
        if len(given) == before:
            break
    return given


def turns(rows, n, seed, first):
    names = [x for x in first if any(r["track"] == x for r in rows)] + sorted({r["track"] for r in rows if r["track"] and r["track"] not in first})
    queues = {x: sorted((r["id"] for r in rows if r["track"] == x), key=lambda i: digest(f"{seed}:track", i)) for x in names}
    out = [(turn, k, i) for k, x in enumerate(names) for turn, i in enumerate(queues[x])]
    return [i for *_, i in sorted(out)][:n]


def test_cohorts_equal_brute_force(spark):
    """Fifty seeds, drawn as one table each."""
    columns = {"low": F.col("score") < 30, "mid": F.col("score").between(20, 69), "even": F.col("score") % 2 == 0, "rare": F.col("score") == 99, "x": F.col("track") == "x"}
    for seed in range(50):
        rows, n = table(seed), [5, 37, 200][seed % 3]
        df = spark.createDataFrame([(r["id"], r["score"], r["track"]) for r in rows], "id string, score int, track string")
        got = cohorts.overlapping_cohort(df, n, seed, columns).orderBy("place").collect()
        assert [r.id for r in got] == greedy(rows, n, seed)
        if seed % 5 == 0:
            drawn = cohorts.stratified_cohort(df, n, seed, "track", ["z", "none", "x"]).orderBy("place").collect()
            assert [r.id for r in drawn] == turns(rows, n, seed, ["z", "none", "x"])


def test_union_of_cohorts(spark):
    rows = table(1)
    df = spark.createDataFrame([(r["id"], r["score"], r["track"]) for r in rows], "id string, score int, track string")
    drawn = {"random": cohorts.random_cohort(df, 30, 7), "top": cohorts.top_cohort(df, 30, [F.desc("score")]), "mixed": cohorts.stratified_cohort(df, 30, 7, "track")}
    lists = {k: [r.id for r in c.orderBy("place").collect()] for k, c in drawn.items()}
    assert lists["random"] == sorted((r["id"] for r in rows), key=lambda i: digest("7:random", i))[:30]
    assert lists["top"] == [r["id"] for r in sorted(rows, key=lambda r: (-r["score"], r["id"]))][:30]
    want = list(dict.fromkeys(i for ids in lists.values() for i in ids))
    got = cohorts.union_of(drawn).orderBy("position").collect()
    assert [r.id for r in got] == want and all(r.groups == [k for k in drawn if r.id in lists[k]] for r in got)
    short = {r.cohort: (r.available, r.drawn, r.short) for r in cohorts.shortfalls({"random": cohorts.random_cohort(df, 500, 7)}, {"random": 500}, {"random": df}).collect()}
    assert short == {"random": (120, 120, 380)}
    assert cohorts.overlapping_cohort(df.limit(0), 5, 1, {"a": F.lit(True)}).count() == 0 and cohorts.random_cohort(df, 0, 1).count() == 0
    one = cohorts.first_of_each(df.unionByName(df.withColumn("score", F.lit(-1))), "id", ["score"])
    assert one.count() == 120 and {r.score for r in one.collect()} == {-1}
    with pytest.raises(Exception, match="without id"):
        cohorts.first_of_each(df.withColumn("id", F.lit("")), "id", ["score"]).collect()
    label = cohorts.first_label([("rare", F.col("score") > 90), ("tracked", F.col("track") == "x")])
    assert {r.id: r.label for r in df.select("id", label.alias("label")).collect()} == {r["id"]: "rare" if r["score"] > 90 else "tracked" if r["track"] == "x" else None for r in rows}


def test_absence_needs_an_unbroken_clean_streak(spark):
    rng = random.Random(2)
    day = lambda n: START + datetime.timedelta(days=n)
    runs = [(c, day(n), rng.random() < 0.85) for c in "ab" for n in range(0, 200)]
    sightings = [(f"{c}{i}", c, day(n), rng.choice([None, "", "s1", "s1", "s1", "s2"]), n) for c in "abc" for i in range(6) for n in sorted(rng.sample(range(200), 25))]
    want = {}
    for ident in {s[0] for s in sightings}:
        own = sorted((s for s in sightings if s[0] == ident), key=lambda s: s[2])
        season = own[0][3] or None
        for last, now in zip(own, own[1:], strict=False):
            clean = {r[1]: r[2] for r in runs if r[0] == now[1]}
            streak = clean.get(now[2]) and all(clean[d] for d in clean if last[2] <= d <= now[2])
            gap = (now[2] - last[2]).days
            if now[3] and season and now[3] != season:
                want[ident, now[2]] = ("season_change", None)
            elif streak and gap >= 5:
                want[ident, now[2]] = ("sustained_absence", float(gap))
            season = now[3] or season
    s = spark.createDataFrame(sightings, "identity string, company string, observed_at timestamp, season string, seq long").repartition(3)
    r = spark.createDataFrame(runs, "company string, observed_at timestamp, clean boolean")
    events = absence.generation_events(s, r, 5)
    got = events.collect()
    assert {(e.identity, e.observed_at): (e.trigger, e.absence_days) for e in got} == want and {v[0] for v in want.values()} == {"season_change", "sustained_absence"}
    assert {e.event_id for e in absence.generation_events(s.repartition(7), r, 5).collect()} == {e.event_id for e in got}
    assert absence.latest_events(events, 0).count() == 1 and absence.generation_events(s.limit(0), r, 5).count() == 0
    assert absence.generation_events(s, r.limit(0), 5).where("trigger <> 'season_change'").count() == 0


def test_clean_runs(spark):
    c = spark.createDataFrame([("a", START, "healthy_empty"), ("b", START, "degraded"), ("c", START, None), ("", START, "healthy_empty")], "company string, observed_at timestamp, direct_status string")
    assert {r.company: r.clean for r in absence.clean_runs(c).collect()} == {"a": True, "b": False, "c": False}
