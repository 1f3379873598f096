import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import eligibility
from sievework.plans import posting_queries


@pytest.fixture(scope="module")
def decided(spark):
    def run(*rows):
        names = ("company", "title", "requirements", "description", "extra")
        made = [(k, *(r.get(n) for n in names)) for k, r in enumerate(rows)]
        df = spark.createDataFrame(made, "k int, " + ", ".join(f"{n} string" for n in names))
        out = eligibility.with_eligibility(df, "extra").orderBy("k").collect()
        return [r.student_eligibility for r in out]

    return run


def test_segments(spark):
    lines = "Minimum qualifications:\nPython. Bachelor's degree\n<li>- Go; Rust</li>\nPreferred qualifications:\nPh. D. in physics\nMore of it\nRequired skills: SQL! Java a plus"
    df = spark.createDataFrame([(lines,), (None,), ("",), ("Basics first.\nKnow Go. Preferred: Rust",)], "t string")
    got = [[(s.text, s.preferred) for s in r.s] for r in df.select(eligibility.segments("t").alias("s")).collect()]
    assert got[0] == [("Python", False), ("Bachelor's degree", False), ("Go", False), ("Rust", False), ("PhD in physics", True), ("More of it", True), ("SQL", False), ("Java a plus", True)]
    assert got[1] == got[2] == []
    assert got[3] == [("s first", False), ("Know Go", False), ("Rust", True)]  # a heading needs no end of a word


def test_fields_come_first_and_lift_what_others_say(decided):
    fields = [
        {"extra": {"eligibility": {"academic_level": "doctoral program only"}}},
        {"extra": {"eligibility": {"eligible_degrees": ["Bachelor's", "Master's", "PhD"]}}},
        {"extra": {"minimum_qualifications": "Experience collaborating with PhD researchers."}},
        {"extra": {"metadata": {"deeper": {"returning_intern_only": True}}}},
        {"extra": {"preferred_degree": "PhD", "unknown": {"degree": "PhD"}}},
        {"degree": ["PhD"]},
    ]
    rows = [{"title": "Software Engineer PhD Intern" if k == 1 else "Software Engineer Intern", "extra": json.dumps(f)} for k, f in enumerate(fields)]
    a, b, c, d, e, f = decided(*rows)
    assert (a.exclusion_reason, a.evidence_source, a.degree_level) == ("phd_only", "extra.eligibility", "phd")
    assert b.eligible and b.mixed_eligibility_detected
    assert c.eligible and c.evidence is None
    assert (d.exclusion_reason, d.evidence_source) == ("returning_intern_only", "extra.metadata.deeper.returning_intern_only")
    assert e.exclusion_reason == "phd_only" and e.evidence_source == "extra.unknown.degree"
    assert f.evidence == "degree: PhD" and f.explanation == 'Clear mandatory phd_only restriction found in degree: "degree: PhD"'


def test_nulls_long_texts_and_odd_characters(decided):
    long = "We build things with care. " * 20_000
    none, wide, last, bad, dots = decided(
        {}, {"requirements": "ＰｈＤ students only."}, {"description": long + "Graduate students only."}, {"extra": "[1", "company": "A+B (x)", "requirements": "Must have previously interned at A+B (x) before."}, {"title": "Ph.D. Research Intern"}
    )
    assert none.eligible and none.degree_level == "unspecified" and not none.negation_detected
    assert wide.exclusion_reason == "phd_only" and last.exclusion_reason == "graduate_only"
    assert bad.eligible  # a bracket is no end of a word
    assert dots.exclusion_reason == "phd_only" and dots.evidence_source == "title"


def test_columns_of_others_stay(spark):
    df = spark.createDataFrame([("Acme", "MBA Intern", None, None, 7)], "company string, title string, requirements string, description string, score int")
    out = eligibility.with_eligibility(df)
    assert out.columns == [*df.columns, "student_eligibility"] and out.first().student_eligibility.degree_level == "mba" and out.first().score == 7
    assert eligibility.with_eligibility(df.where("score < 0")).count() == 0


def test_rows_worked_out_by_hand(spark):
    df = spark.createDataFrame([r[:5] for r in posting_queries.ELIGIBILITY_ROWS], "k int, company string, title string, requirements string, description string")
    got = {r.k: (e.exclusion_reason, e.degree_level, e.negation_detected, e.mixed_eligibility_detected) for r in eligibility.with_eligibility(df).collect() for e in [r.student_eligibility]}
    assert got == {r[0]: r[5:] for r in posting_queries.ELIGIBILITY_ROWS}
