"""Postings to users: who watches whose postings, which of them suit, what changes in the table of matches, what is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrases_overlap, squash, text

# How a country is named in a preference, seasons, and the delays of digests in hours.
UNITED_STATES = ("united states", "united states of america", "usa", "u s a", "us", "u s")
SEASONS = ("spring", "summer", "fall", "autumn", "winter")
DELAYS = {"every_3_hours": 3, "daily": 24}


def is_remote() -> Column:
    has = lambda c: F.array_contains(F.split(squash(c), " "), "remote")
    return has("remote_status") | has("location")


def _seasons(c: Column) -> Column:
    words = F.filter(F.split(squash(c), " "), lambda w: w.isin(*SEASONS))
    return F.array_distinct(F.transform(words, lambda w: F.when(w == "autumn", "fall").otherwise(w)))


def _years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)))


def location_reason(outside_us: Column) -> Column:
    """The code of the first preferred place that suits, or null: a user who excludes remote work gets none, one without places any."""
    place = squash("location")

    def code(p: Column) -> Column:
        key = squash(p)
        return F.when(key.isin(*UNITED_STATES), F.when(~outside_us, "location_united_states")).when((key != "") & (place != "") & phrases_overlap(key, place), "location_preferred")

    first = F.try_element_at(F.filter(F.transform("preferred_locations", code), lambda x: x.isNotNull()), F.lit(1))
    none = F.size("preferred_locations") <= 0
    return F.when(is_remote() & ~F.col("include_remote"), None).when(none, "location_any").otherwise(F.coalesce(first, F.when(is_remote(), "remote_included")))


def season_reason() -> Column:
    """The code of how seasons agree, or null where both name seasons, or years, and share none."""
    want, years = _seasons(F.col("internship_season")), _years(F.col("internship_season"))
    have, own = _seasons(F.col("title")), _years(F.col("title"))
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    return F.when((F.size(want) == 0) & (F.size(years) == 0), "season_any").when((F.size(have) == 0) & (F.size(own) == 0), "season_unspecified").when(apart(want, have) | apart(years, own), None).otherwise("season_match")


def decide(jobs: DataFrame, watches: DataFrame, preferences: DataFrame) -> DataFrame:
    """user_id, job_id and reasons of every posting that suits a user who watches its company.

    jobs (job_id, company_id, role_id, title, location, remote_status, is_open, outside_us) meet watches (user_id,
    company_id, paused) by company: never all users and all postings. preferences: user_id, role_ids,
    preferred_locations, include_remote, internship_season.
    """
    met = jobs.where("is_open").join(watches.where("not paused").select("user_id", "company_id").distinct(), "company_id").join(preferences, "user_id")
    met = met.where(F.array_contains("role_ids", F.col("role_id")))
    met = met.withColumns({"_place": location_reason(F.coalesce("outside_us", F.lit(False))), "_season": season_reason()}).where("_place is not null and _season is not null")
    reason = lambda code, value=None: F.struct(code.alias("code"), (F.substring(value, 1, 120) if value is not None else F.lit(None).cast("string")).alias("value"))
    reasons = F.array(reason(F.lit("company_watched"), F.col("company_id")), reason(F.lit("role_selected"), F.col("role_id")), reason(F.col("_place")), reason(F.col("_season")))
    return met.select("user_id", "job_id", reasons.alias("reasons"))


def reconciled(matches: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The table of matches after decisions, with outcome: created, reactivated, refreshed, deactivated or unchanged.

    matches: user_id, job_id, reasons, matched_at, last_matched_at, no_longer_matches_at, saved_at, dismissed_at. What the
    user saved or dismissed stays. The same decisions again leave all rows unchanged.
    """
    new = decisions.withColumnRenamed("reasons", "_reasons").withColumn("_is", F.lit(True))
    both = matches.withColumn("_was", F.lit(True)).join(new, ["user_id", "job_id"], "full_outer")
    was, wanted = F.coalesce("_was", F.lit(False)), F.coalesce("_is", F.lit(False))
    ended = F.col("no_longer_matches_at").isNotNull()
    outcome = (
        F.when(wanted & ~was, "created")
        .when(wanted & ended, "reactivated")
        .when(wanted & ~F.col("reasons").eqNullSafe(F.col("_reasons")), "refreshed")
        .when(~wanted & ~ended, "deactivated")
        .otherwise("unchanged")
    )
    both = both.withColumn("outcome", outcome)
    touched = F.col("outcome").isin("created", "reactivated", "refreshed")
    return both.select(
        "user_id",
        "job_id",
        F.when(touched, F.col("_reasons")).otherwise(F.col("reasons")).alias("reasons"),
        F.coalesce("matched_at", now).alias("matched_at"),
        F.when(touched, now).otherwise(F.col("last_matched_at")).alias("last_matched_at"),
        F.when(touched, None).when(F.col("outcome") == "deactivated", now).otherwise(F.col("no_longer_matches_at")).alias("no_longer_matches_at"),
        "saved_at",
        "dismissed_at",
        "outcome",
    )


def view(matches: DataFrame, name: str = "active") -> DataFrame:
    """Rows of a view: saved, dismissed, historical, all, or (active) those that match and aren't dismissed."""
    has = lambda c: F.col(c).isNotNull()
    rule = {"saved": has("saved_at"), "dismissed": has("dismissed_at"), "historical": has("no_longer_matches_at"), "all": F.lit(True), "active": ~has("no_longer_matches_at") & ~has("dismissed_at")}
    return matches.where(rule[name])


def page(matches: DataFrame, jobs: DataFrame, user: str, name: str = "active", limit: int = 50, offset: int = 0) -> DataFrame:
    """A user's page of a view, newest first. The page is cut before the postings are joined."""
    own = view(matches.where(F.col("user_id") == user), name).orderBy(F.desc("matched_at"), F.desc("job_id")).offset(offset).limit(limit)
    return own.join(jobs, "job_id").orderBy(F.desc("matched_at"), F.desc("job_id"))


def notifications(created: DataFrame, users: DataFrame, open_batches: DataFrame, sent: DataFrame, run: str, now: Column) -> DataFrame:
    """user_id, job_id, batch_id and due_at of created matches that aren't among sent items (user_id, job_id).

    users: user_id, frequency (as_detected, every_3_hours or daily), enabled. Those notified as detected have a batch
    for each run, due now; others join their oldest open batch (user_id, frequency, batch_id, created_at, due_at), or open one due
    after their delay.
    """
    items = created.select("user_id", "job_id").distinct().join(sent.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti").join(users.where("enabled"), "user_id")
    first = open_batches.groupBy(F.col("user_id").alias("_u"), F.col("frequency").alias("_f")).agg(F.min_by(F.struct("batch_id", "due_at"), F.struct("created_at", "batch_id")).alias("_b"))
    items = items.join(first, (F.col("user_id") == F.col("_u")) & (F.col("frequency") == F.col("_f")), "left")
    at_once = F.col("frequency") == "as_detected"
    name = lambda *parts: F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32)
    fresh = name(F.col("user_id").cast("string"), F.col("frequency"), F.lit(run))
    hours = F.coalesce(*(F.when(F.col("frequency") == k, F.lit(v)) for k, v in DELAYS.items()), F.lit(0))
    due = F.timestamp_seconds(F.unix_timestamp(now) + hours * 3600)
    return items.select("user_id", "job_id", F.when(at_once, fresh).otherwise(F.coalesce(F.col("_b.batch_id"), fresh)).alias("batch_id"), F.when(at_once, now).otherwise(F.coalesce(F.col("_b.due_at"), due)).alias("due_at"))
