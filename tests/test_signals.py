import pytest

from sievework.functions import pay, posting_signals as s

ROWS = [
    dict(title="Backend Intern", description="Mentorship and end-to-end projects. 12-week program. Return offer possible.", requirements="python, sql, c++ and kubernetes; REST apis", compensation="$32/hr", role="swe", role_track="backend", company="Acme"),
    dict(title="Helper", description="Data entry and cold calls. Wear many hats, hustle! No interview. Pay a fee of $50 deposit. Reach us on WhatsApp.", requirements="5+ years experience; restaurants, mango, ago", compensation="unpaid", role="non_technical", role_track="other", company="Foo"),
    dict(title="Clerk", description="Sort mail.", requirements="", compensation="$5/hr", role="unknown", role_track=None, company="Bar"),
]


@pytest.fixture(scope="module")
def rows(spark):
    names = list(ROWS[0])
    df = spark.createDataFrame([(i, *(r[n] for n in names), i == 0) for i, r in enumerate(ROWS)], "i int, " + ", ".join(f"{n} string" for n in names) + ", start boolean")
    df = s.with_signals(s.with_flags(pay.with_pay(df, "compensation")), ("Python", "SQL", "machine learning"), ("acme",), startup="start")
    df = df.withColumn("tools", s.tools("requirements")).withColumn("top", s.top_labels("positive_signals", "strength"))
    return {r.i: r for r in df.collect()}


def test_flags(rows):
    ids = lambda i: [(f.id, f.severity) for f in rows[i].red_flags]
    assert ids(0) == []
    assert ids(1) == [("scam_fee", "critical"), ("no_interview", "major"), ("offplatform_recruiting", "major"), ("unpaid", "major"), ("unrealistic_experience", "major"), ("founder_responsibilities", "major"), ("grunt_work", "major")]
    assert ids(2) == [("very_low_pay", "minor"), ("no_learning_mention", "minor")]
    assert rows[1].red_flags[4].label == "Asks for 5+ years of experience from an intern" and rows[1].red_flags[5].evidence == "Wear many hats; hustle"


def test_signals(rows):
    assert [(x.id, x.strength) for x in rows[0].positive_signals] == [("paid_well", 3), ("stack_match", 3), ("ownership", 2), ("mentorship", 2), ("conversion", 2), ("structured_program", 1), ("reputable", 2), ("specific_tech", 2), ("backend_focus", 2), ("startup_env", 1)]
    assert rows[0].positive_signals[1].evidence == "Python, SQL" and rows[2].positive_signals == []
    assert rows[0].top == ["Strong pay (~$32/hr equivalent)", "Tech stack overlaps your experience", "Clear project ownership"]


def test_tools(rows):
    assert rows[0].tools == ["c++", "kubernetes", "python", "rest", "sql"] and rows[1].tools == []
