"""Operators over each key's events in order of time: transitions, streaks, gaps, cooldowns and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold


def transitions(df: DataFrame, key: str, order: Sequence[str], state: Column) -> DataFrame:
    """df with state, previous (of the key), changed and recovered (from true to false)."""
    out = df.withColumn("state", state)
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    out = out.withColumn("previous", before)
    return out.withColumn("changed", ~F.col("state").eqNullSafe(F.col("previous"))).withColumn("recovered", F.coalesce(F.col("previous") & ~F.col("state"), F.lit(False)))


def streaks(df: DataFrame, key: str, order: Sequence[str], hit: Column, name: str = "streak") -> DataFrame:
    """df with the number of consecutive hits up to each row; a row that isn't a hit has 0."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_hit", hit.cast("int"))
    out = out.withColumn("_island", F.sum(1 - F.col("_hit")).over(run))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.sum("_hit").over(inside)).drop("_hit", "_island")


def gaps(df: DataFrame, key: str, time: str, order: Sequence[str], seconds: int) -> DataFrame:
    """Rows that come `seconds` or more after the key's row before, with gap_seconds."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(*order))
    out = df.withColumn("gap_seconds", epoch(time) - epoch(before))
    return out.where(F.col("gap_seconds") >= seconds)


def epoch(c: str | Column) -> Column:
    """Whole seconds of a time stamp, as long."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_timestamp(c.cast("timestamp"))


def trailing_count(df: DataFrame, key: str, time: str, seconds: int, name: str = "n_recent") -> DataFrame:
    """df with the number of the key's rows in the `seconds` up to each row, itself included."""
    return df.withColumn("_t", epoch(time)).withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds, 0))).drop("_t")


def cooldown(df: DataFrame, key: str, time: str, order: str, seconds: int) -> DataFrame:
    """(key, order) of the events that are let through: the first of a key, then each that comes `seconds` or more after the last let through."""

    def step(state: dict, t: int | None, e: object):
        if t is not None and ("last" not in state or t - state["last"] >= seconds):
            state["last"] = t
            yield (e,)

    return ordered_fold(df, key, {"t": epoch(time), order: F.col(order)}, [order], step)


def anchored_batches(df: DataFrame, key: str, time: str, order: str, seconds: int) -> DataFrame:
    """(key, batch_start, n_events): a batch is opened by the first event after the one before has closed, and closes `seconds` later."""

    def step(state: dict, t: int | None, _: object):
        if t is None:
            return
        if "open" in state and t - state["open"] < seconds:
            state["n"] += 1
            return
        yield from end(state)
        state.update(open=t, n=1)

    def end(state: dict):
        if "open" in state:
            yield state["open"], state["n"]

    return ordered_fold(df, key, {"t": epoch(time), order: F.col(order)}, {"batch_start": "long", "n_events": "long"}, step, end)


def sessions(df: DataFrame, key: str, time: str, order: Sequence[str], seconds: int) -> DataFrame:
    """(key, session, started, n_events): a session ends where `seconds` or more pass without an event."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = F.coalesce((epoch(time) - epoch(F.lag(time).over(w)) >= seconds).cast("int"), F.lit(1))
    out = df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(key, "session").agg(F.min(time).alias("started"), F.count(F.lit(1)).alias("n_events"))


def daily_digest(df: DataFrame, key: str, time: str, kind: str) -> DataFrame:
    """(day, key, n, first_at, last_at, kinds) of each UTC day and key; kinds are distinct and sorted."""
    day = F.date_format(time, "yyyy-MM-dd").alias("day")
    return df.groupBy(day, key).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


def retain(df: DataFrame, time: str, order: Sequence[Column], newest: int, since: Column | None = None) -> DataFrame:
    """The newest rows, not older than `since`. limit() after a sort keeps `newest` rows of each task, not all rows of one."""
    out = df.where(F.col(time) >= since) if since is not None else df
    return out.orderBy(*order).limit(newest)
