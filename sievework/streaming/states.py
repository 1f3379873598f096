"""Streams of attempts and postings: micro-batches over state tables, and the same state kept by the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import blank_to_null


def attempt_counters(attempts: DataFrame) -> DataFrame:
    """A stream of (health_key, seq, succeeded) to each key's latest counters, as an update stream kept in the state store.

    Within a batch a key's attempts are taken by seq; one that isn't later than the last taken is a repeat and changes nothing.
    """
    out = "health_key string, seq long, total_attempts long, total_successes long, consecutive_failures long"

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, total, won, lost = state.get if state.exists else (-1, 0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("seq").drop_duplicates("seq")
        for s, ok in zip(rows["seq"].tolist(), rows["succeeded"].tolist(), strict=True):
            if s > seq:
                seq, total, won, lost = s, total + 1, won + bool(ok), 0 if ok else lost + 1
        state.update((seq, total, won, lost))
        yield pd.DataFrame([(key[0], seq, total, won, lost)], columns=["health_key", "seq", "total_attempts", "total_successes", "consecutive_failures"])

    return attempts.groupBy("health_key").applyInPandasWithState(step, out, "seq long, total long, won long, lost long", "update", GroupStateTimeout.NoTimeout)


def observe(seen: DataFrame, batch: DataFrame, absence_days: int = 14) -> DataFrame:
    """The seen table after a batch of postings (identity, title, observed_at, season_key), and what the batch says of each.

    New identities enter; known ones take the later last_seen and the new season unless it is blank. event is
    season_changed where both seasons are known and differ, absence where the posting was away absence_days or
    more (its epoch then counts up). The same batch again changes nothing: it isn't later than what is stored.
    """
    now = batch.groupBy("identity").agg(F.max("observed_at").alias("at"), F.max_by("season_key", "observed_at").alias("season"), F.max_by("title", "observed_at").alias("now_title"))
    both = seen.join(now.withColumnRenamed("identity", "_i"), F.col("identity") == F.col("_i"), "full_outer")
    new, seen_now = F.col("identity").isNull(), F.col("_i").isNotNull()
    later = seen_now & (F.col("at") > F.col("last_seen"))
    changed = later & (F.coalesce("season", F.lit("")) != "") & (F.coalesce("season_key", F.lit("")) != "") & (F.col("season") != F.col("season_key"))
    away = later & (F.unix_timestamp("at") - F.unix_timestamp("last_seen") >= absence_days * 86400)
    event = F.when(new, "new").when(changed, "season_changed").when(away, "absence")
    return both.select(
        F.coalesce("identity", "_i").alias("identity"),
        F.coalesce(blank_to_null("now_title"), "title").alias("title"),
        F.coalesce("first_seen", "at").alias("first_seen"),
        F.greatest("last_seen", "at").alias("last_seen"),
        F.when(later | new, F.coalesce(blank_to_null("season"), "season_key")).otherwise(F.col("season_key")).alias("season_key"),
        (F.coalesce("absence_epoch", F.lit(0)) + F.coalesce((away & ~changed).cast("int"), F.lit(0))).alias("absence_epoch"),
        event.alias("event"),
    )


def state_batches(stream: DataFrame, path: str, empty: Callable[[SparkSession], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """A query whose state is a table: each micro-batch reads version n of it and writes version n + 1.

    A batch that runs again after a failure reads the same version and writes the same one over, so its
    effect is exactly once.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = empty(spark) if n == 0 else spark.read.parquet(f"{path}/{n - 1:09d}")
        step(old, batch).write.mode("overwrite").parquet(f"{path}/{n:09d}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def emitted_once(candidates: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """Candidates whose key isn't among stored events, one of each key."""
    return candidates.dropDuplicates([key]).join(events.select(key), key, "left_anti")


def partition_postings(postings: DataFrame, state: DataFrame) -> DataFrame:
    """postings with bucket: emailed or primed where the state table (identity, emailed_at, primed_at) says so, else pending."""
    out = postings.join(state.select(F.col("identity").alias("_i"), "emailed_at", "primed_at"), F.col("identity") == F.col("_i"), "left")
    return out.withColumn("bucket", F.when(F.col("emailed_at").isNotNull(), "emailed").when(F.col("primed_at").isNotNull(), "primed").otherwise("pending")).drop("_i", "emailed_at", "primed_at")


# Minutes until a delivery is tried again, by the attempts so far; the fifth failure is the last.
RETRY_MINUTES = {1: 1, 2: 5, 3: 15, 4: 60}


def delivery_state(result: str = "result", attempts: str = "attempts", now: str = "now") -> dict[str, object]:
    """status and next_at after an attempt's result: sent, rejected, uncertain or failed."""
    n, r = F.col(attempts), F.col(result)
    wait = F.coalesce(*(F.when(n == k, F.lit(v)) for k, v in RETRY_MINUTES.items()))
    status = F.when(r == "sent", "sent").when(r.isin("rejected", "uncertain"), r).when(wait.isNotNull(), "pending").otherwise("failed")
    return {"status": status, "next_at": F.when(status == "pending", F.timestamp_seconds(F.unix_timestamp(now) + wait * 60))}
