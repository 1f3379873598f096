import time

from pyspark.sql import functions as F

from sievework.plans import posting_queries, posting_run, watch


def test_students_count_only_where_asked(spark, sf):
    df = posting_queries._gated(spark, sf).where("k % 5 = 0 and k % 3 <> 0").withColumn("watcher_ineligible_reason", F.lit("phd_only"))
    first = watch.with_gate(df).first().gate
    assert not first.watcher_eligible and first.ineligible_reason == first.exclusion_reason == "phd_only" and first.categorical_evaluation_applied
    rows = [r.gate for r in watch.with_gate(df, students=False).collect()]
    assert rows and all(g.exclusion_reason is None and g.ineligible_reason != "phd_only" and g.explanation == watch.NOT_EVALUATED for g in rows)
    assert any(g.watcher_eligible and g.eligible_reason == "data_engineering matches watcher target roles." for g in rows)


def test_degrees_come_after_places(spark, sf):
    df = posting_queries._gated(spark, sf).where("k % 5 <> 0").withColumns({"fits": F.lit(False), "why": F.when(F.col("k") % 2 == 0, "Not for you.")})
    got = {(r.k % 3 == 0, r.k % 2 == 0): r.gate.ineligible_reason for r in watch.with_gate(df, degree=("fits", "why")).collect()}
    assert got == {(True, True): "outside_us", (True, False): "outside_us", (False, True): "Not for you.", (False, False): watch.OTHER_DEGREE}


def test_plan_has_no_shuffle(spark, sf):
    plan = watch.matches(posting_queries._gated(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_from_files_to_matches(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text(
        "Company Name,Job Title,location,Description,Qualifications\n"
        'Acme,Backend Intern,"Boston, MA",Build REST APIs.,"Python, SQL"\n'
        'Brick,Backend Intern,"Boston, MA",Build REST APIs.,PhD students only.\n'
        'Cube,Backend Intern,"Toronto, Canada",Build REST APIs.,"Python, SQL"\n'
        'Dome,Backend Engineer,"Boston, MA",Build REST APIs.,"Python, SQL"\n'
    )
    out, _ = posting_run.run(spark, str(path), posting_queries.PROFILE, F.lit("2026-06-09").cast("date"))
    began = time.perf_counter()
    kept = watch.matches(out, write=True).select("company")
    kept._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 60 and [r.company for r in kept.collect()] == ["Acme"]
    out.write.parquet(str(tmp_path / "scored"))
    out = spark.read.parquet(str(tmp_path / "scored"))
    gates = {r.company: r.gate for r in watch.with_gate(out).collect()}
    assert gates["Acme"].watcher_eligible and gates["Acme"].fit_score > 0
    assert gates["Brick"].ineligible_reason == "phd_only" and gates["Brick"].evidence == "PhD students only"
    assert gates["Cube"].ineligible_reason == "outside_us" and gates["Dome"].watcher_eligible
    assert [r.company for r in watch.matches(out).select("company").collect()] == ["Acme"]
