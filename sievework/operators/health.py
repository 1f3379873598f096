"""The health of sources: each attempt's state, given all attempts of its key before, as windows over time; transitions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attempts in a row after which a feed fails, and statuses between which a change is a recovery.
FAILING_AFTER = 3
BAD = ("degraded", "failing", "failed", "unknown")
GOOD = ("healthy", "empty", "healthy_with_listings", "healthy_empty")

ATTEMPT = (
    "health_key string, source_kind string, company string, attempted boolean, succeeded boolean, rows_returned long, error_kind string, observed_at timestamp, "
    "malformed_row_count long, schema_error_row_count long, duplicate_row_count long, failed_request_count long, incomplete boolean, truncated boolean, degraded boolean, complete boolean"
)


def direct_status() -> Column:
    """The status of a successful attempt at a direct source: unknown where a figure is missing."""
    counts = ("malformed_row_count", "schema_error_row_count", "duplicate_row_count", "failed_request_count")
    missing = F.lit(False)
    for c in (*counts, "incomplete", "truncated", "degraded", "complete"):
        missing = missing | F.col(c).isNull()
    worse = F.col("degraded") | F.col("incomplete") | F.col("truncated") | ~F.col("complete") | (F.col("malformed_row_count") > 0) | (F.col("schema_error_row_count") > 0)
    return F.when(missing, "unknown").when(worse, "degraded").when(F.col("rows_returned") > 0, "healthy_with_listings").otherwise("healthy_empty")


def health_states(attempts: DataFrame) -> DataFrame:
    """attempts (ATTEMPT) with the state after each: totals, streaks, last known figures, status, previous status and recovery.

    An attempt that wasn't made changes no figure. Ties of time are settled by seq, which is unique.
    """
    order = Window.partitionBy("health_key").orderBy("observed_at", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    made, won = F.col("attempted"), F.col("attempted") & F.coalesce("succeeded", F.lit(False))
    lost = made & ~F.coalesce("succeeded", F.lit(False))
    rows = F.greatest(F.coalesce("rows_returned", F.lit(0)), F.lit(0))
    direct = F.col("source_kind") == "direct"
    zero = won & (rows == 0) & direct
    df = attempts.withColumns({"made": made, "won": won, "lost": lost, "zero": zero})
    # a streak restarts after the last attempt that breaks it
    df = df.withColumns({"_w": F.sum(F.col("won").cast("int")).over(upto), "_nz": F.sum((F.col("made") & ~F.col("zero")).cast("int")).over(upto)})
    inside = lambda island: Window.partitionBy("health_key", island).orderBy("observed_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, cond: F.last(F.when(cond, c), ignorenulls=True).over(upto)
    df = df.withColumns(
        {
            "total_attempts": F.sum(F.col("made").cast("int")).over(upto),
            "total_successes": F.col("_w"),
            "consecutive_failures": F.sum(F.col("lost").cast("int")).over(inside("_w")),
            "consecutive_zero_successes": F.sum(F.col("zero").cast("int")).over(inside("_nz")),
            "last_attempt_at": last(F.col("observed_at"), F.col("made")),
            "last_success_at": last(F.col("observed_at"), F.col("won")),
            "last_nonzero_at": last(F.col("observed_at"), F.col("won") & (rows > 0)),
            "_last": F.last(F.when(F.col("made"), F.struct(F.when(F.col("won"), rows).alias("n"), F.when(F.col("lost"), F.col("error_kind")).alias("e"))), ignorenulls=True).over(upto),
        }
    )
    status = (
        F.when(~F.col("made"), F.when(direct, "not_configured").otherwise("unknown"))
        .when(F.col("won") & direct, direct_status())
        .when(F.col("won"), "healthy")
        .when(direct, "failed")
        .when(F.col("consecutive_failures") >= FAILING_AFTER, "failing")
        .otherwise("degraded")
    )
    df = df.withColumn("status", status).withColumn("previous_status", F.lag("status").over(order))
    df = df.withColumn("changed", F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col("status")))
    df = df.withColumn("recovery", F.col("changed") & F.col("previous_status").isin(*BAD) & F.col("status").isin(*GOOD))
    return df.withColumns({"last_rows_returned": F.col("_last.n"), "last_error_kind": F.col("_last.e")}).drop("_w", "_nz", "_last", "made", "won", "lost", "zero")


def current_states(states: DataFrame) -> DataFrame:
    """The latest state of each key."""
    rest = [c for c in states.columns if c != "health_key"]
    top = states.groupBy("health_key").agg(F.max_by(F.struct(*rest), F.struct("observed_at", "seq")).alias("s"))
    return top.select("health_key", "s.*")


def coverage(companies: DataFrame, attempts: DataFrame, states: DataFrame) -> DataFrame:
    """company and coverage of each company (company, health_key): its direct source's state, else what the feeds can say.

    The one figure of all feeds is a single row, so it is broadcast.
    """
    feeds = states.where("source_kind <> 'direct'").agg(F.coalesce(F.bool_or(F.col("status") == "healthy"), F.lit(False)).alias("feed_ok"))
    tried = attempts.where("attempted").select(F.col("health_key").alias("_k")).distinct().withColumn("_tried", F.lit(True))
    now = states.select(F.col("health_key").alias("_h"), "status")
    out = companies.join(tried, F.col("health_key") == F.col("_k"), "left").join(now, F.col("health_key") == F.col("_h"), "left").crossJoin(F.broadcast(feeds))
    ok = F.coalesce(F.col("status").isin(*GOOD), F.lit(False))
    kind = F.when(F.col("_tried") & ok, "direct").when(F.col("_tried") & F.col("feed_ok"), "feed_only").when(F.col("_tried"), "failed").when(F.col("feed_ok"), "feed_only").otherwise("none")
    return out.select("company", kind.alias("coverage"))


def minor_degradation() -> Column:
    """Whether a degraded state is minor: at most 5 skipped rows, 20 kept for each, nothing else wrong."""
    skipped = F.coalesce("malformed_row_count", F.lit(0)) + F.coalesce("schema_error_row_count", F.lit(0))
    return (F.col("status") == "degraded") & ~F.coalesce("incomplete", F.lit(True)) & ~F.coalesce("truncated", F.lit(True)) & skipped.between(1, 5) & (F.col("rows_returned") >= 20 * skipped)
