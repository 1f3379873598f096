"""Small decisions about postings, sources, mail and display: each a CASE over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col, text

# Reasons that close a posting to students, and those that keep it.
STUDENT_REASONS = ("phd_only", "graduate_only", "freshman_only", "returning_intern_only")
KEPT_REASONS = ("pending", "already_emailed", "explicitly_primed")
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
IMMEDIATE_ALERTS = ("new_failure", "recovery", "direct_source_silence", "direct_source_degraded", "unknown_diagnostics", "coverage_regression", "both_tiers_unavailable")


def season_status(terms: C, today: Column) -> Column:
    """Of an array of terms: unknown without a year, stale if the newest is past, rollover_due from July of it on, else ok."""
    years = F.flatten(F.transform(col(terms), lambda t: F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1))))
    newest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    return F.when(newest.isNull(), "unknown").when(newest < F.year(today), "stale").when((newest == F.year(today)) & (F.month(today) >= 7), "rollover_due").otherwise("ok")


def deadline_text(days: C, deadline: C) -> Column:
    d = col(days)
    plain = F.when(text(deadline) != "", text(deadline)).otherwise("rolling")
    return F.when(d.isNull(), plain).when(d < 0, F.concat(F.lit("expired "), -d, F.lit("d ago"))).when(d == 0, "due today").when(d == 1, "1 day left").otherwise(F.concat(d, F.lit(" days left")))


def deadline_tone(days: C) -> Column:
    d = col(days)
    return F.when(d < 0, "low").when(d <= 3, "mid").otherwise("neutral")


def confidence_dots(confidence: C) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.coalesce(col(confidence), F.lit(0.0)) * 4 + 0.5))).cast("int")


def pay_text(pay: C) -> Column:
    """A pay struct for display; an en dash between bounds, "(est.)" where the period was assumed."""
    p = col(pay)
    amount = lambda n: F.concat(F.lit("$"), F.when(n < 10, F.format_string("%.2f", F.round(n, 2))).otherwise(F.format_string("%.0f", F.round(F.round(n, 2), 0))))
    low, high = p["usd_hourly_min"], p["usd_hourly_max"]
    span = F.when(low == high, amount(low)).otherwise(F.concat(amount(low), F.lit("–"), amount(high)))
    raw = lambda missing: F.when(p["raw"] != "", p["raw"]).otherwise(missing)
    return (
        F.when(p.isNull() | (p["kind"] == "unknown"), "—")
        .when(p["kind"] == "unpaid", "Unpaid")
        .when(p["kind"] == "equity_only", "Equity only")
        .when(p["kind"] == "commission_only", "Commission only")
        .when(p["kind"] == "stipend_unspecified", "Stipend (unspecified)")
        .when(p["kind"] == "unknown_vague", raw("Vague"))
        .when(low.isNull(), raw("—"))
        .otherwise(F.concat(span, F.lit("/hr"), F.when(p["period_assumed"], " (est.)").otherwise("")))
    )


def final_reason(collected: C, watched: C, in_season: C, internship: C, is_open: C, judged: C, exclusion: C, location_status: C, eligible: C, role: C, fit: C, least: C, emailed: C, primed: C) -> Column:
    """Why a posting is or isn't sent: the first of the gates that stops it, null while its eligibility isn't judged."""
    no = lambda c: ~F.coalesce(col(c), F.lit(False))
    return (
        F.when(no(collected), "not_collected").when(no(watched), "not_on_watchlist").when(no(in_season), "wrong_season").when(no(internship), "not_internship").when(no(is_open), "closed")
        .when(no(judged), None)
        .when(col(exclusion).isin(*STUDENT_REASONS), col(exclusion))
        .when(col(location_status) == "outside_us", "outside_us")
        .when(no(eligible), F.when(text(role).isin("nontechnical", "non_technical", "unknown", ""), "nontechnical_role").otherwise("watcher_role_ineligible"))
        .when(col(fit) < col(least), "below_min_score")
        .when(col(emailed), "already_emailed").when(col(primed), "explicitly_primed").otherwise("pending")
    )


def comparison_category(sources: C, reason: C) -> Column:
    """collected_rejected unless the final reason keeps the posting; else whether boards, feeds or both have it."""
    s = col(sources)
    direct, feed = F.array_contains(s, "direct_ats"), F.exists(s, lambda x: x != "direct_ats")
    return F.when(~F.coalesce(col(reason).isin(*KEPT_REASONS), F.lit(False)), "collected_rejected").when(direct & feed, "both").when(direct, "direct_only").otherwise("github_only")


def send_mode(event: C, raw: C) -> Column:
    """struct(send_email, config_status, scheduled_email_enabled) of a run's event and its setting's text."""
    said = F.lower(F.trim(text(raw)))
    on = said.isin(*TRUE_WORDS)
    status = F.when(on, "recognized_true").when(said.isin(*FALSE_WORDS), "recognized_false").when(said == "", "missing_or_blank").otherwise("invalid")
    scheduled = col(event) == "schedule"
    return F.struct(on.alias("send_email"), F.when(scheduled, status).otherwise("not_applicable").alias("config_status"), F.when(scheduled, F.when(on, "yes").otherwise("no")).otherwise("not_applicable").alias("scheduled_email_enabled"))


def user_cancellation(user: C, preferences: C, frequency: C) -> Column:
    """Why a batch isn't sent to its user: user(is_active, email_verified_at), preferences(globally_paused, alert_frequency); null if it is."""
    u, p = col(user), col(preferences)
    return (
        F.when(u.isNull() | ~u["is_active"], "user_inactive").when(u["email_verified_at"].isNull(), "email_unverified").when(p.isNull() | p["globally_paused"], "globally_paused")
        .when(p["alert_frequency"] == "paused", "frequency_paused").when(p["alert_frequency"] != col(frequency), "frequency_changed")
    )


def item_cancellation(match: C, job: C) -> Column:
    """Why an item leaves a batch: match(dismissed_at, no_longer_matches_at), job(is_open); null if it stays."""
    m, j = col(match), col(job)
    return (
        F.when(m.isNull(), "match_missing").when(j.isNull(), "job_missing").when(m["dismissed_at"].isNotNull(), "match_dismissed")
        .when(m["no_longer_matches_at"].isNotNull(), "match_inactive").when(~j["is_open"], "job_closed")
    )


def allowed_by_mode(kind: C, mode: C, minor: tuple[str, ...] = ()) -> Column:
    """Whether a mode sends an alert at once: minor ones wait for the digest."""
    k, m = col(kind), col(mode)
    return F.when(k.isin(*minor) if minor else F.lit(False), False).when(m == "transitions_only", k.isin(*IMMEDIATE_ALERTS)).when(m == "failure_only", k != "recovery").otherwise(False)


def ratio(part: C, whole: C) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(col(part), col(whole))
