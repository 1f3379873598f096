"""Weighted totals, caps, buckets and actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Weights, in the order in which they are added; thresholds of buckets.
WEIGHTS = {
    "role_relevance": 0.40,
    "compensation": 0.14,
    "legitimacy": 0.08,
    "learning_value": 0.14,
    "technical_depth": 0.14,
    "effort_vs_value": 0.04,
    "location_convenience": 0.03,
    "deadline_urgency": 0.03,
}
HIGH, MAYBE = 70, 45


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100 * F.try_divide(part, whole)), F.lit(0)).cast("int")


def weighted_total(scores: dict[str, Column]) -> Column:
    """The rounded weighted sum (halves to even), added in the order of WEIGHTS."""
    return F.bround(reduce(lambda x, y: x + y, (scores[k] * F.lit(w) for k, w in WEIGHTS.items())), 0).cast("int")


def capped(total: Column, ineligible: Column, critical: Column, major: Column) -> Column:
    """A total after the caps: 44 if ineligible, 40 with a critical flag, else 44 with three major ones."""
    out = F.when(ineligible, F.least(total, F.lit(44))).otherwise(total)
    return F.when(critical > 0, F.least(out, F.lit(40))).when(major >= 3, F.least(out, F.lit(44))).otherwise(out)


def bucket(total: Column, forced_low: Column) -> Column:
    return F.when(forced_low, "low").when(total >= HIGH, "high").when(total >= MAYBE, "maybe").otherwise("low")


def action(total: Column, days: Column, confidence: Column, ineligible: Column, critical: Column, major: Column) -> Column:
    return (
        F.when(ineligible | (critical > 0) | (major >= 3) | F.coalesce(days < 0, F.lit(False)), "skip")
        .when((total >= HIGH) & (major == 0), "apply_now")
        .when(total >= HIGH, "research_more")
        .when((total >= 60) & F.coalesce(days.between(0, 7), F.lit(False)) & (major == 0), "apply_now")
        .when(confidence < 0.6, "research_more")
        .when(total >= 55, "apply_later")
        .when(total >= MAYBE, "research_more")
        .otherwise("skip")
    )


def fit_action(fit: Column, eligible: Column, expired: Column) -> Column:
    return F.when(~eligible | expired, "skip").when(fit >= 75, "apply_now").when(fit >= MAYBE, "apply_later").otherwise("research_more")


def extreme(scores: dict[str, Column], best: bool = True) -> Column:
    """The name of the best (or worst) score; the first of equal ones."""
    pick = F.greatest if best else F.least
    top = pick(*(col(c) for c in scores.values()))
    return F.coalesce(*(F.when(c == top, name) for name, c in scores.items()))
