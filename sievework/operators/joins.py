"""Joins that a plain equality join doesn't spell: unique matches, arrays of matches, any of several keys, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_match_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, take: str) -> DataFrame:
    """left with `take` of right where exactly one distinct `take` has the key, else null; ambiguous keys are settled before the join."""
    one = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_key")).agg(F.min(take).alias(take), F.max(take).alias("_max"))
    one = one.where(F.col(take) == F.col("_max")).drop("_max")
    return left.join(one, F.col(left_key) == F.col("_key"), "left").drop("_key")


def lookup_array_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fields: Sequence[str], name: str) -> DataFrame:
    """left, one row each, with the sorted array of its matches' fields; empty where there is none."""
    many = right.groupBy(F.col(right_key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = left.join(many, F.col(left_key) == F.col("_key"), "left").drop("_key")
    return out.withColumn(name, F.coalesce(name, F.array().cast(many.schema[name].dataType)))


def any_key_flags(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """left with a flag hit_<left key> for each pair of keys that some row of right has equal.

    One equality join for each key: an OR of equalities would become a nested loop.
    """
    for a, b in keys:
        known = right.select(F.col(b).alias("_known")).where("_known is not null").distinct().withColumn("_hit", F.lit(True))
        left = left.join(known, F.col(a) == F.col("_known"), "left").withColumn(f"hit_{a}", F.coalesce("_hit", F.lit(False))).drop("_known", "_hit")
    return left


def any_key_anti_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of left that agree with no row of right on any of the pairs of keys."""
    out = any_key_flags(left, right, keys)
    hit = reduce(lambda x, y: x | y, (F.col(f"hit_{a}") for a, _ in keys))
    return out.where(~hit).select(*left.columns)


def tiered_join(left: DataFrame, right: DataFrame, tiers: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, tier) of the best tier for each left row: equal keys of an earlier pair win, ties go to the smaller right_id, null last.

    Of the right rows of a key only the smallest can win, so it alone meets the left rows: a key that many rows of both
    tables have is as many rows as the left table has.
    """
    found = left.select(F.col(left_id), *(F.col(a).alias(f"_a{n}") for n, (a, _) in enumerate(tiers)))
    arms = []
    for n, (_, b) in enumerate(tiers):
        least = right.where(F.col(b) != "").groupBy(F.col(b).alias(f"_b{n}")).agg(F.min(right_id).alias("_least"))
        least = least.select(f"_b{n}", F.struct(F.lit(n).alias("tier"), F.col("_least").isNull().alias("_none"), F.col("_least").alias(right_id)).alias(f"_t{n}"))
        found = found.join(least, F.col(f"_a{n}") == F.col(f"_b{n}"), "left")
        arms.append(F.col(f"_t{n}"))
    best = found.select(F.col(left_id), F.coalesce(*arms).alias("_best")).where("_best is not null").groupBy(left_id).agg(F.min("_best").alias("_best"))
    return best.select(left_id, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.tier").alias("tier"))


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def upsert(old: DataFrame, new: DataFrame, key: str, fill: Sequence[str] = (), latest: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """Both tables by key: `fill` takes new text unless blank, `latest` the greater value, `first` the old value unless null; outcome says what happened."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    out = {c: F.coalesce(blank_to_null(F.col(f"n.{c}")), F.col(f"o.{c}")) for c in fill}
    out |= {c: F.greatest(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in latest}
    out |= {c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in first}
    changed = reduce(lambda x, y: x | y, (~out[c].eqNullSafe(F.col(f"o.{c}")) for c in out), F.lit(False))
    outcome = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").when(changed, "updated").otherwise("unchanged")
    return both.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *(c.alias(k) for k, c in out.items()), outcome.alias("outcome"))


def reconcile(old: DataFrame, new: DataFrame, keys: Sequence[str], was_active: str, is_wanted: str) -> DataFrame:
    """keys and action of rows that a state table (old) and a decision (new) have between them: create, reactivate, refresh, deactivate or none."""
    both = old.select(*keys, F.col(was_active).alias("_was")).join(new.select(*keys, F.col(is_wanted).alias("_is")), list(keys), "full_outer")
    was, wanted = F.col("_was"), F.coalesce("_is", F.lit(False))
    action = F.when(was.isNull() & wanted, "create").when(was.isNull(), "none").when(~was & wanted, "reactivate").when(was & wanted, "refresh").when(was & ~wanted, "deactivate").otherwise("none")
    return both.select(*keys, action.alias("action"))
