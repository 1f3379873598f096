"""Postings that come back after having been away, where their company's source was healthy all the while: another generation of them may be open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timelines import epoch

# Statuses of a direct source under which a missing posting is really away; what an event was caused by.
CLEAN = ("healthy_with_listings", "healthy_empty")
SEASON_CHANGE, SUSTAINED_ABSENCE = "season_change", "sustained_absence"


def clean_runs(coverage: DataFrame) -> DataFrame:
    """company, observed_at, clean of coverage (company, observed_at, direct_status): only a direct source that was wholly healthy counts, feeds never do."""
    return coverage.where("company <> ''").select("company", "observed_at", F.coalesce(F.col("direct_status").isin(*CLEAN), F.lit(False)).alias("clean"))


def with_streak(runs: DataFrame) -> DataFrame:
    """runs (company, observed_at, clean) with clean_since: when the unbroken run of clean ones up to each began; null where it isn't clean."""
    upto = Window.partitionBy("company").orderBy("observed_at", F.col("clean").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = runs.withColumn("_break", F.sum((~F.col("clean")).cast("int")).over(upto))
    inside = Window.partitionBy("company", "_break").orderBy("observed_at").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("clean_since", F.when(F.col("clean"), F.min(F.when(F.col("clean"), F.col("observed_at"))).over(inside))).drop("_break")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, take: str) -> DataFrame:
    """left with the `take` of the key's last row of right that isn't later; null where there is none. Both sides meet in one sorted window, not in a join of ranges."""
    kind, fields = "_right", [c for c in left.columns if c not in (key, time)]
    rows = left.select(key, time, F.lit(False).alias(kind), F.struct(*fields).alias("_left") if fields else F.struct(F.lit(0)).alias("_left"))
    held = right.select(key, time, F.lit(True).alias(kind), F.struct(F.col(take).alias("v")).alias("_v"))
    both = rows.unionByName(held, allowMissingColumns=True)
    # at one time right comes first
    upto = Window.partitionBy(key).orderBy(F.col(time), F.col(kind).desc()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_told", F.last("_v", ignorenulls=True).over(upto)).where(~F.col(kind))
    return told.select(key, time, *(F.col("_left")[f].alias(f) for f in fields), F.col("_told.v").alias(take))


def generation_events(sightings: DataFrame, runs: DataFrame, least_days: int) -> DataFrame:
    """event_id, identity, company, observed_at, trigger, absence_days, last_seen, stored_season, season: one event at most of each sighting.

    sightings: identity, company, observed_at, season (null or blank: not told), seq; runs: company, observed_at, clean. A season
    that differs from the last one told wins over absence. Absence is told where the sighting's own run is clean, the clean streak
    began no later than the posting was last seen, and that was least_days ago or more. The first sighting is no event.
    Equal input gives equal ids, so events that are stored already are left out by them.
    """
    own = Window.partitionBy("identity").orderBy("observed_at", "seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    told = F.nullif(F.trim(F.coalesce("season", F.lit(""))), F.lit(""))
    seen = sightings.withColumns({"last_seen": F.lag("observed_at").over(own), "season": told})
    seen = seen.withColumn("stored_season", F.last("season", ignorenulls=True).over(before)).where("last_seen is not null")
    met = as_of(seen, with_streak(runs), "company", "observed_at", "clean_since")
    changed = F.col("season").isNotNull() & F.col("stored_season").isNotNull() & (F.col("season") != F.col("stored_season"))
    days = (epoch("observed_at") - epoch("last_seen")) / F.lit(86400.0)
    away = F.coalesce((F.col("clean_since") <= F.col("last_seen")) & (days >= least_days), F.lit(False))
    out = met.withColumn("trigger", F.when(changed, SEASON_CHANGE).when(away, SUSTAINED_ABSENCE)).where("trigger is not null")
    out = out.withColumn("absence_days", F.when(F.col("trigger") == SUSTAINED_ABSENCE, F.round(days, 2)))
    parts: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("identity", "trigger", "last_seen", "stored_season", "season")]
    return out.withColumn("event_id", F.sha2(F.concat_ws("\x1f", *parts), 256)).select("event_id", "identity", "company", "observed_at", "trigger", "absence_days", "last_seen", "stored_season", "season")


def latest_events(events: DataFrame, most: int = 100) -> DataFrame:
    """The newest events, 1 to 1,000 of them."""
    return events.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(max(1, min(most, 1000)))
