"""From canonical rows to scored postings in one plan, and from CSV files to them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import country, dates, eligibility, fit, pay, posting_rules, posting_signals, roles, scores
from ..functions.text import posting_id, posting_key, text
from ..operators import memo
from ..operators.dedupe import deduplicated
from ..sources.csv_postings import infer_fields, read_csv

# Labels of actions.
ACTION_LABELS = {"apply_now": "Apply now", "apply_later": "Apply later", "research_more": "Research more", "skip": "Skip"}


def _label(action: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ACTION_LABELS.items() for x in kv)), F.col(action))


def analysed(rows: DataFrame, profile: fit.Profile) -> DataFrame:
    """rows with what doesn't change from day to day: pay, role, company, flags, signals, technology, profile match, fit, place and scores.

    All of it is projections of built-in functions: one stage, no shuffle.
    """
    df = pay.with_pay(rows, "compensation", "pay")
    df = roles.with_role(df, "role_class")
    df = df.withColumns({"role": F.col("role_class.role"), "role_track": F.col("role_class.role_track")})
    technical = F.col("role").isin(*roles.TECHNICAL_ROLES)
    df = posting_rules.with_company_class(df, profile.known_tech, profile.known_other, technical)
    df = posting_signals.with_flags(df, "pay", "role")
    df = posting_signals.with_signals(df, profile.skills, profile.reputable, profile.least_pay)
    df = df.withColumns({"_about": F.concat_ws(" ", text("description"), text("requirements")), "_named": posting_signals.padded(F.concat_ws(" ", text("requirements"), text("description")))})
    df = df.withColumns({"_about_low": F.lower("_about"), "technology": posting_signals.tools("_named", "_named"), "place": fit.place(profile)})
    df = fit.with_fit(fit.with_matched(df, profile), profile)
    return df.withColumn("static_scores", F.struct(
        F.col("fit.score").alias("role_relevance"), pay.pay_score("pay").alias("compensation"),
        posting_rules.legitimacy("red_flags", "positive_signals", "company_class.category", "pay").alias("legitimacy"), posting_rules.learning("red_flags", "positive_signals").alias("learning_value"),
        posting_rules.technical_depth(F.size("technology"), F.col("role_track").isin(*posting_signals.SOFTWARE_TRACKS)).alias("technical_depth"), posting_rules.effort("_about", "_about_low").alias("effort_vs_value"),
        F.col("place.score").alias("location_convenience"),
    )).drop("_about", "_about_low", "_named")


#: What analysed() adds, and what it reads.
ANALYSIS = ("pay", "role_class", "role", "role_track", "company_class", "red_flags", "positive_signals", "technology", "profile_match", "place", "fit", "static_scores")
ANALYSED_FIELDS = ("company", "title", "description", "requirements", "compensation", "location", "remote_status")


def decided(df: DataFrame, profile: fit.Profile, today: Column, excluded: str | None = None) -> DataFrame:
    """analysed rows with what a day decides: days left, category scores, total, bucket, actions, reasons and concerns. No long text is read."""
    df = df.withColumn("deadline_days_left", dates.days_left(dates.parse_date("deadline"), today))
    df = df.withColumn("categories", F.struct("static_scores.*", dates.urgency("deadline_days_left").alias("deadline_urgency")))
    reason = F.col(excluded) if excluded else F.lit(None).cast("string")
    count = lambda severity: F.size(F.filter("red_flags", lambda f: f["severity"] == severity))
    df = df.withColumns({"_open": reason.isNull(), "_critical": count("critical"), "_major": count("major"), "_raw": scores.weighted_total({k: F.col(f"categories.{k}").cast("double") for k in scores.WEIGHTS})})
    df = df.withColumn("watcher_eligible", F.col("_open") & (F.col("fit.score") > 0))
    out, critical, major, days = ~F.col("watcher_eligible"), F.col("_critical"), F.col("_major"), F.col("deadline_days_left")
    df = df.withColumn("total", scores.capped(F.col("_raw"), out, critical, major))
    total, expired = F.col("total"), F.coalesce(days < 0, F.lit(False))
    fit_score = F.when(F.col("watcher_eligible"), F.col("fit.score")).otherwise(0)
    df = df.withColumns({
        "id": posting_id(posting_key("company", "title", "location")), "fit_score": fit_score, "fit_explanation": F.col("fit.explanation"),
        "watcher_ineligible_reason": F.when(out, F.coalesce(reason, fit.ineligible_reason("role_class", profile), F.col("fit.explanation"))),
        "bucket": scores.bucket(total, out | (critical > 0) | (major >= 3)), "action": scores.action(total, days, F.col("role_class.confidence"), out, critical, major),
        "watcher_action": scores.fit_action(fit_score, F.col("watcher_eligible"), expired),
    })
    df = df.withColumns({"action_label": _label("action"), "watcher_action_label": _label("watcher_action"), "reasons": _reasons(), "concerns": _concerns(expired, F.coalesce(reason, F.col("watcher_ineligible_reason")))})
    return df.drop("_open", "_critical", "_major", "_raw", "fit", "place", "static_scores")


def scored(rows: DataFrame, profile: fit.Profile, today: Column, excluded: str | None = None) -> DataFrame:
    """rows with pay, role, company, flags, signals, profile match, category scores, total, bucket and actions.

    rows: company, title, location, remote_status, compensation, description, requirements, deadline,
    internship_type. excluded: a column with the reason why a posting is closed to the reader, null if it isn't.
    """
    return decided(analysed(rows, profile), profile, today, excluded)


def context(profile: fit.Profile) -> str:
    """What an analysis depends on besides its row."""
    return memo.stable_json(dataclasses.asdict(profile))


def with_fingerprint(rows: DataFrame, profile: fit.Profile) -> DataFrame:
    """rows with the fingerprint of what their analysis reads; to be written where postings are taken in, so that later runs needn't read texts."""
    return rows.withColumn("fingerprint", memo.fingerprint({c: text(c) for c in ANALYSED_FIELDS}, context(profile)))


def scored_with_memo(rows: DataFrame, path: str, profile: fit.Profile, today: Column, now, version: int = 1) -> tuple[DataFrame, memo.Stats]:
    """scored(), analysing only rows whose fingerprint the memo at path has no analysis of. rows: with_fingerprint(), read from a table.

    The result's plan reads neither descriptions nor requirements.
    """

    def analyse(missing: DataFrame) -> DataFrame:
        return analysed(missing, profile).select("fingerprint", *ANALYSIS)

    keep = rows.drop("description", "requirements")
    found, stats = memo.remembered(rows, path, analyse, version, now, keep=keep.columns, valid=F.col("fit").isNotNull() & F.col("role_class").isNotNull())
    return decided(found, profile, today), stats


def _reasons() -> Column:
    """Up to three: the fit, then strengths by weight."""
    told = F.when(F.col("watcher_eligible"), F.array(F.concat(F.lit("Role fit: "), F.col("fit.explanation")))).otherwise(F.array().cast("array<string>"))
    found = F.slice(F.array_distinct(F.concat(told, posting_signals.top_labels("positive_signals", "strength", 3))), 1, 3)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No standout strengths found.")))


def _concerns(expired: Column, excluded: Column) -> Column:
    """Up to three: why it is closed to the reader, a past deadline, then warnings by severity."""
    of = lambda severity: F.transform(F.filter("red_flags", lambda f: f["severity"] == severity), lambda f: f["label"])
    late = F.when(expired, F.array(F.lit("Deadline has already passed"))).otherwise(F.array().cast("array<string>"))
    closed = F.when(excluded.isNotNull(), F.array(excluded)).otherwise(F.array().cast("array<string>"))
    found = F.slice(F.array_distinct(F.concat(closed, late, of("critical"), of("major"), of("minor"))), 1, 3)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No major concerns detected.")))


def run(spark: SparkSession, path: str, profile: fit.Profile, today: Column) -> tuple[DataFrame, DataFrame]:
    """(scored postings, report of merged rows) of CSV files, best first by total, then in the files' order."""
    rows, _ = read_csv(spark, path)
    kept, report = deduplicated(infer_fields(rows))
    told = country.with_country(eligibility.with_eligibility(kept)).withColumn("excluded", F.col("student_eligibility.exclusion_reason"))
    return scored(told, profile, today, "excluded").drop("excluded").orderBy(F.desc("total"), "pos"), report
