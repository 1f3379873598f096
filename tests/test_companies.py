import random
from difflib import SequenceMatcher

import pytest

from sievework.functions.companies import label_key
from sievework.operators import companies as co
from sievework.sources import rosters


def test_label_keys(spark):
    want = {
        "Acme, Inc.": "acme", "ACME Corp": "acme", "acmeCloud GmbH": "acme cloud", "AcmeGmbH": "acme gmb h", "IBMResearch": "ibm research", "Café & Co. Ltd": "cafe",
        "Smith and Sons LLC": "smith and sons", "Smith and Co": "smith", "Ørsted Æther Œuvre": "orsted aether oeuvre", "Þór ł": "thor l", "Inc": "", "  ": "", None: "", "A Co and Inc": "a co",
        "Company of Heroes": "company of heroes", "ﬁne ½ Straße": "fine 1 2 strasse", "x2Y": "x2 y", "N.V. Trading": "n v trading", "NV": "", "GMBH Holding": "gmbh holding", "名前 株式会社": "名前 株式会社",
    }
    df = spark.createDataFrame([(k,) for k in want], "label string")
    assert {r.label: r.key for r in df.select("label", label_key("label").alias("key")).collect()} == want


def test_watched_companies(spark):
    watched = spark.createDataFrame([("Acme Inc", ["ACME Labs", "AcmeLabs", None]), ("Bolt", ["The Bolt Company", "Labs"]), ("Labs LLC", None), ("Inc", ["Ltd"])], "company string, aliases array<string>")
    labels = ["acme", "Acme Labs Ltd.", "bolt", "the bolt", "labs", "nobody", "", None, "Inc", "acme"]
    rows = spark.createDataFrame([(i, x, "c") for i, x in enumerate(labels)], "i int, label string, n_claims_ string")
    got = {r.i: (r.matched_company, r.matched_label, r.n_claims) for r in co.match_companies(rows, watched, "label").collect()}
    none = (None, None, 0)
    assert got == {0: ("Acme Inc", "Acme Inc", 1), 1: ("Acme Inc", "ACME Labs", 1), 2: ("Bolt", "Bolt", 1), 3: ("Bolt", "The Bolt Company", 1), 4: (None, None, 2), 5: none, 6: none, 7: none, 8: none, 9: ("Acme Inc", "Acme Inc", 1)}
    assert co.match_companies(rows.limit(0), watched, "label").count() == 0
    assert co.match_companies(rows, watched.limit(0), "label").where("n_claims > 0").count() == 0


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.mark.parametrize("ratio", [0.88, 0.8, 0.97])
def test_similar_names_are_all_found(spark, ratio):
    rng = random.Random(int(ratio * 100))
    word = lambda n: "".join(rng.choice("abcdehinorst ") for _ in range(n)).strip() or "a"

    def spoilt(s):
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(s) + 1)
            s = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice("xyz") + s[at:], s[:at] + rng.choice("ab") + s[at + 1 :], s[at:] + s[:at]])
        return s or "a"

    right = [word(rng.randint(1, 30)) for _ in range(150)] + ["a" * n for n in range(1, 12)] + ["x y"]
    left = [spoilt(rng.choice(right)) for _ in range(300)] + ["a" * n for n in range(1, 12)]
    want = {(a, b, round(r, 12)) for a in set(left) for b in set(right) if (r := SequenceMatcher(None, a, b).ratio()) >= ratio}
    got = co.similar_names(names(spark, [*left, *left, None, ""]), names(spark, [*right, None, ""]), ratio)
    assert {(r.left_name, r.right_name, round(r.ratio, 12)) for r in got.collect()} == want and len(want) > 50 and got.count() == len(want)


def test_similar_names_refuse_low_ratios(spark):
    with pytest.raises(ValueError):
        co.similar_names(names(spark, ["a"]), names(spark, ["b"]), 0.5)


def by_hand(name, employers, aliases):
    """The tiers, one name at a time."""
    others = lambda t: sorted(a for a, x in aliases.items() if x == t and a in employers)
    if name in employers:
        return "exact", list(dict.fromkeys([name, *others(name)]))
    if name in aliases:
        t = aliases[name]
        if found := [t] if t in employers else others(t):
            return "alias", found
    if others(name):
        return "reverse", others(name)
    near = sorted((-r, e) for e in employers if (r := SequenceMatcher(None, name, e).ratio()) >= co.SIMILAR)
    return ("similar", [near[0][1]]) if near else (None, [])


def test_tiers_in_turn(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    employers, aliases = set(pool[:60]), {a: rng.choice(pool[20:100]) for a in pool[40:110]}
    want = {(n, e, t, p) for n in set(pool) for t, found in [by_hand(n, employers, aliases)] for p, e in enumerate(found)}
    table = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = co.employer_links(names(spark, [*pool, None, ""]), table([(e,) for e in employers], "employer string"), table(list(aliases.items()), "alias string, target string")).collect()
    assert {t for *_, t, _ in want} == {"exact", "alias", "reverse", "similar"}
    order = sorted(got, key=lambda r: (r.name, r.place))
    place = {}
    for r in order:
        place[r.name, r.employer] = sum(1 for x in place if x[0] == r.name)
    assert {(r.name, r.employer, r.tier, place[r.name, r.employer]) for r in got} == want and len(got) == len(want)


def test_roster_arrays(spark, tmp_path):
    path = tmp_path / "roster.csv"
    path.write_text('﻿First Name,Last Name,Occupation,Employer,LinkedIn URL\nAda,L,"Engineer, lead",Bosch,u1\n Bo ,,Analyst,Robert Bosch,u2\nCy,X,,Acme Cloud,u3\nNo,One,,,u4\nAda,L,"Engineer, lead",Bosch,u1\nDi,Y,Ops,Acme Cluod,u5\n', encoding="utf-8")
    roster = rosters.read_csv(spark, str(path))
    assert roster.count() == 5 and co.roster_size(roster).first() == (5, 4)
    watched = spark.createDataFrame([("Acme", ["Acme Holding"], ["Acme Cloud"], 1), ("Other", ["acme"], ["Bosch"], 2)], "company string, aliases array<string>, roster_names array<string>, position int")
    rows = spark.createDataFrame([(0, "Bosch GmbH"), (1, "Robert Bosch"), (2, "Acme"), (3, "acme clouds"), (4, "Nobody"), (5, None), (0, "Bosch GmbH"), (6, "Bosch Group")], "i int, company string")
    got = co.attach_roster(rows, roster, co.alias_table(spark, co.KNOWN_ALIASES), "company", watched).collect()
    assert sorted((r.i, [a.linkedin_url for a in r.alumni]) for r in got) == [(0, ["u1", "u2"]), (0, ["u1", "u2"]), (1, ["u2"]), (2, ["u3"]), (3, ["u3"]), (4, []), (5, []), (6, ["u1"])]
    assert got[0].alumni == [] or got[0].alumni[0].asDict().keys() == {"name", "occupation", "linkedin_url", "employer"}
    with pytest.raises(ValueError, match="LinkedIn"):
        bad = tmp_path / "bad.csv"
        bad.write_text("First Name,Last Name,Occupation,Employer\na,b,c,d\n")
        rosters.read_csv(spark, str(bad))


def test_roster_of_json(spark):
    texts = spark.createDataFrame([('{"Acme": [{"name": " A ", "occupation": null}, {"name": "B", "employer": "Bolt"}], "": [{"name": "C"}], "Empty": []}',)], "value string")
    assert [(r.name, r.occupation, r.employer) for r in rosters.parse_json(texts).orderBy("position").collect()] == [("A", "", "Acme"), ("B", "", "Bolt")]
    with pytest.raises(Exception, match="(?i)malformed|cast"):
        rosters.parse_json(spark.createDataFrame([("[1]",)], "value string")).collect()
