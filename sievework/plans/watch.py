"""Which scored postings a watcher wants: open internships of its roles that are open to its students, in the United States or in a place that isn't told."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import STUDENT_REASONS
from ..functions.posting_rules import is_internship, is_open
from ..functions.text import C, col, text
from ..operators.storage import written

# Tracks that the role swe takes in, and texts of decisions.
SWE_TRACKS = (
    "backend", "full_stack", "frontend", "general_swe", "platform_infra", "data_engineering", "ml_ai", "quant_dev", "cloud", "devops",
    "embedded_software", "firmware", "sdet_qa_automation", "technical_product", "it_support", "solutions_engineering",
)
NOT_EVALUATED = "Categorical student restrictions were not evaluated because the posting is not an open internship or student program."
OTHER_DEGREE = "Graduate/PhD-level internship outside undergraduate target."
OUTSIDE = "Role is outside the watcher target profile."


def _track() -> Column:
    given = lambda c: F.nullif(text(c), F.lit(""))
    return F.coalesce(given("role_track"), given("role"), F.lit("unknown"))


def is_wanted_role(targets: Collection[str] = ("swe",)) -> Column:
    """The role is a target; so are software-adjacent tracks where swe is one."""
    named = F.coalesce(F.col("role").isin(*sorted(targets)), F.lit(False))
    return named | _track().isin(*SWE_TRACKS) if "swe" in targets else named


def with_gate(scored: DataFrame, targets: Collection[str] = ("swe",), students: bool = True, degree: tuple[C, C] | None = None, name: str = "gate") -> DataFrame:
    """scored and a struct `name`: watcher_eligible, fit_score, eligible_reason, ineligible_reason, location_status, location_explanation and what was found about students.

    scored: role, role_track, fit_score, fit_explanation, watcher_eligible, watcher_ineligible_reason, student_eligibility,
    location_decision. students: whether restrictions to students count; where they don't, they are no reason either.
    degree: columns of whether the degree fits and why not. The first reason that holds decides: students, place, degree,
    then role and fit. A missing decision closes nothing. A projection without a shuffle; other columns stay.
    """
    student, fit = F.col("student_eligibility"), F.coalesce(F.col("fit_score"), F.lit(0)).cast("int")
    closed = F.when(student["exclusion_reason"].isin(*STUDENT_REASONS), student["exclusion_reason"])
    reason = closed if students else F.lit(None).cast("string")
    abroad = F.when(F.col("location_decision.reason") == "outside_us", "outside_us")
    other_degree = F.when(~col(degree[0]), F.coalesce(F.nullif(text(degree[1]), F.lit("")), F.lit(OTHER_DEGREE))) if degree and students else F.lit(None).cast("string")
    wanted = is_wanted_role(targets)
    fits = F.coalesce(F.col("watcher_eligible"), fit > 0) & wanted & (fit > 0)
    told = F.nullif(text("watcher_ineligible_reason"), F.lit(""))
    if not students:
        told = F.when(closed.isNull() & ~told.isin(*STUDENT_REASONS), told)
    mismatch = F.coalesce(told, F.when(~wanted, F.concat(_track(), F.lit(" does not match watcher target roles."))), F.lit(OUTSIDE))
    why = F.coalesce(reason, abroad, other_degree, F.when(~fits, mismatch))
    found = lambda field, none: student[field] if students else none
    no, nothing = F.lit(False), F.lit(None).cast("string")
    return scored.withColumn(name, F.struct(
        why.isNull().alias("watcher_eligible"), F.when(why.isNull(), fit).otherwise(0).alias("fit_score"),
        F.when(why.isNull(), F.coalesce(F.nullif(text("fit_explanation"), F.lit("")), F.concat(_track(), F.lit(" matches watcher target roles.")))).alias("eligible_reason"), why.alias("ineligible_reason"),
        F.col("location_decision.status").alias("location_status"), F.col("location_decision.explanation").alias("location_explanation"),
        F.lit(students).alias("categorical_evaluation_applied"), reason.alias("exclusion_reason"),
        found("evidence_source", nothing).alias("evidence_source"), found("evidence", nothing).alias("evidence"), found("explanation", F.lit(NOT_EVALUATED)).alias("explanation"),
        *(F.coalesce(found(f, no), no).alias(f) for f in ("mandatory_language_detected", "negation_detected", "mixed_eligibility_detected")),
    ))


def matches(scored: DataFrame, targets: Collection[str] = ("swe",), least: int | None = None, active: C | None = None, write: bool = False) -> DataFrame:
    """The rows of scored, with their gate, that are open internships, pass it and fit by `least` or more. scored: title, internship_type, deadline_days_left too.

    write: scored is the plan of a run, not a table. It is written to the shared folder first: a filter on the gate would be
    pushed into the run's projections and copy the whole derivation of each column into every use of it.
    """
    gated = with_gate(written(scored, "scored") if write else scored, targets)
    kept = is_internship() & is_open(F.lit(None).cast("boolean") if active is None else active) & F.col("gate.watcher_eligible")
    return gated.where(kept if least is None else kept & (F.col("gate.fit_score") >= least))
