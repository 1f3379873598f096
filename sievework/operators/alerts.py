"""Alerts on the health of sources: what a run's states call for, which of them are sent, and the incidents they add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold
from .health import GOOD, minor_degradation
from .timelines import epoch

# Kinds of alerts that end with a recovery, those that a digest waits for, those that end a recovery, and how grave each is.
FAILURES = ("new_failure", "continued_failure", "direct_source_silence", "direct_source_degraded", "unknown_diagnostics", "feed_stale", "minor_degradation")
RECOVERIES = ("recovery", "minor_recovery")
DEGRADATIONS = ("new_failure", "continued_failure", "direct_source_degraded", "unknown_diagnostics", "minor_degradation")
OPENING = ("new_failure", "minor_degradation")
MINOR = ("minor_degradation", "minor_recovery")
SEVERITY = {"new_failure": "high", "continued_failure": "high", "direct_source_degraded": "medium", "unknown_diagnostics": "medium", "feed_stale": "medium", "minor_degradation": "info", "recovery": "info", "minor_recovery": "info"}


def candidates(states: DataFrame, open_minor: DataFrame, observed_at: Column, stale_hours: int = 72) -> DataFrame:
    """health_key, alert_type, severity of what each state calls for at observed_at: one alert by status, and one more for a feed that is stale.

    states: a row each key (health.health_states, current) with status, changed, recovery, source_kind, last_nonzero_at and the
    figures of minor_degradation; open_minor: health_key of open minor incidents, whose recovery is as quiet as they were.
    """
    known = open_minor.select("health_key").distinct().withColumn("_minor", F.lit(True))
    df = states.join(known, "health_key", "left")
    status, feed = F.col("status"), F.col("source_kind") == "github_feed"
    bad = status.isin("failing", "failed")
    by_status = (
        F.when(F.coalesce("recovery", F.lit(False)), F.when(F.coalesce("_minor", F.lit(False)), "minor_recovery").otherwise("recovery"))
        .when(bad, F.when(F.coalesce("changed", F.lit(False)), "new_failure").otherwise("continued_failure"))
        .when(~feed & (status == "degraded"), F.when(F.coalesce(minor_degradation(), F.lit(False)), "minor_degradation").otherwise("direct_source_degraded"))
        .when(~feed & (status == "unknown"), "unknown_diagnostics")
    )
    stale = feed & (status == "healthy") & ~F.coalesce("recovery", F.lit(False)) & (epoch(observed_at) - epoch("last_nonzero_at") >= stale_hours * 3600)
    kinds = F.array_compact(F.array(by_status, F.when(stale, F.lit("feed_stale"))))
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("alert_type"))
    return df.select("health_key", F.explode(kinds).alias("alert_type")).withColumn("severity", severity)


def coverage_alerts(now: DataFrame, before: DataFrame) -> DataFrame:
    """company, alert_type, severity of companies without any source now, and of those that only feeds cover now but not before.

    now, before: company, coverage (uncovered, backstop_only or another). No regression is told where before is empty.
    """
    old = before.select("company", F.col("coverage").alias("_old"))
    known = before.agg((F.count(F.lit(1)) > 0).alias("_known"))
    both = now.join(old, "company", "left").crossJoin(F.broadcast(known))
    lost = (F.col("coverage") == "backstop_only") & F.col("_known") & ~F.coalesce(F.col("_old") == "backstop_only", F.lit(False))
    kind = F.when(F.col("coverage") == "uncovered", "both_tiers_unavailable").when(lost, "coverage_regression")
    return both.select("company", kind.alias("alert_type")).where("alert_type is not null").withColumn("severity", F.when(F.col("alert_type") == "coverage_regression", "high").otherwise("critical"))


class Cooldown:
    """What one key's alerts have led to so far. An alert is sent unless one of its kind was sent less than `seconds` ago and hasn't been resolved since."""

    def __init__(self, seconds: int, allowed: tuple[str, ...] | None = None):
        self.seconds, self.allowed = seconds, allowed

    def step(self, state: dict, t: int, kind: str) -> bool:
        """state: for each kind [last sent, resolved]. A recovery resolves failures, a new failure recoveries; a kind that is sent again is open again."""
        own = state.setdefault(kind, [None, None])
        ended = FAILURES if kind in RECOVERIES else RECOVERIES if kind in OPENING else ()
        for other in ended:
            if other in state and state[other][1] is None:
                state[other][1] = t
        if self.allowed is not None and kind not in self.allowed:
            return False
        sends = own[0] is None or own[1] is not None or t - own[0] >= self.seconds
        if sends:
            own[:] = [t, None]
        return sends


def sent(alerts: DataFrame, seconds: int, allowed: tuple[str, ...] | None = None, key: str = "health_key", time: str = "detected_at") -> DataFrame:
    """key, seq, alert_type, sent: whether each alert (key, time, seq, alert_type) is sent, the key's alerts in the order of time and seq.

    allowed: the kinds that a mode sends at once; others are recorded, end what they end, but aren't sent. Alerts without time are left out.
    """
    rule = Cooldown(seconds, allowed)

    def step(state: dict, t: int, seq: object, kind: str):
        yield seq, kind, rule.step(state, t, kind)

    fields = {"t": epoch(time), "seq": F.col("seq"), "alert_type": F.col("alert_type")}
    return ordered_fold(alerts.where(F.col(time).isNotNull()), key, fields, {"seq": alerts.schema["seq"].dataType, "alert_type": "string", "sent": "boolean"}, step)


def resolved(alerts: DataFrame, key: str = "health_key", time: str = "detected_at") -> DataFrame:
    """alerts with resolved_at: for a failure the time of the key's next recovery, null while there is none; null for others."""
    after = Window.partitionBy(key).orderBy(F.desc(time), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    next_one = F.last(F.when(F.col("alert_type").isin(*RECOVERIES), F.col(time)), ignorenulls=True).over(after)
    return alerts.withColumn("resolved_at", F.when(F.col("alert_type").isin(*FAILURES), next_one))


def open_minor_incidents(alerts: DataFrame, key: str = "health_key", time: str = "detected_at") -> DataFrame:
    """The keys whose open degradations are all minor: of each kind the last one counts, open where no recovery came after it."""
    last = lambda kinds: F.max(F.when(F.col("alert_type").isin(*kinds), F.struct(time, "seq")))
    ends = alerts.groupBy(key).agg(last(RECOVERIES).alias("end"), *(last([k]).alias(k) for k in DEGRADATIONS))
    is_open = lambda k: F.col(k).isNotNull() & F.coalesce(F.col(k) > F.col("end"), F.lit(True))
    grave = reduce(lambda a, b: a | b, (is_open(k) for k in DEGRADATIONS if k != "minor_degradation"))
    return ends.where(is_open("minor_degradation") & ~grave).select(key)


def minor_incidents(alerts: DataFrame, states: DataFrame | None = None, since: Column | None = None, key: str = "health_key", time: str = "detected_at") -> DataFrame:
    """key, occurrences, first_at, last_at, latest (label and rows), reasons (distinct, sorted), recovered (yes, no, unknown) of keys with minor degradations.

    alerts: label, rows_returned, reason_codes too; states: key and status now, for keys whose recovery wasn't told.
    """
    minor = alerts.where(F.col("alert_type").isin(*MINOR))
    minor = minor if since is None else minor.where(F.col(time) >= since)
    hit = F.col("alert_type") == "minor_degradation"
    at = F.when(hit, F.col(time))
    out = minor.groupBy(key).agg(
        F.count_if(hit).alias("occurrences"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max(F.when(~hit, F.col(time))).alias("_back"),
        F.max_by(F.struct("label", "rows_returned"), F.when(hit, F.struct(time, "seq"))).alias("latest"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("reason_codes")))))).alias("reasons"),
    ).where("occurrences > 0")
    now = F.lit(None).cast("string")
    if states is not None:
        out, now = out.join(states.select(key, F.col("status").alias("_now")), key, "left"), F.col("_now")
    recovered = F.when(F.col("_back") >= F.col("last_at"), "yes").when(now.isNull(), "unknown").when(now.isin(*GOOD), "yes").otherwise("no")
    return out.select(key, "occurrences", "first_at", "last_at", "latest", "reasons", recovered.alias("recovered"))
