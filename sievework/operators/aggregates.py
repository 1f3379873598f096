"""Aggregates over whole tables and groups: histograms, conditional counts, evaluation figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import percent


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: a count for each condition, in one pass."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, specificity, accuracy and f1, null where a denominator is 0; rows where either is null don't count."""
    p, a = predicted, actual
    counts = conditional_counts(df, tp=p & a, fp=p & ~a, fn=~p & a, tn=~p & ~a)
    n = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    ratios = {
        "precision": F.try_divide(n["tp"], n["tp"] + n["fp"]),
        "recall": F.try_divide(n["tp"], n["tp"] + n["fn"]),
        "specificity": F.try_divide(n["tn"], n["tn"] + n["fp"]),
        "accuracy": F.try_divide(n["tp"] + n["tn"], n["tp"] + n["fp"] + n["fn"] + n["tn"]),
        "f1": F.try_divide(2 * n["tp"], 2 * n["tp"] + n["fp"] + n["fn"]),
    }
    return counts.select("*", *(c.alias(k) for k, c in ratios.items()))


def precision_at(df: DataFrame, order: Sequence[Column], hit: Column, k: int) -> DataFrame:
    """One row: hits among the first k and their share. The first k are a top-k, not a sort of all."""
    return df.withColumn("_hit", hit).orderBy(*order).limit(k).agg(F.count_if("_hit").alias("hits"), F.try_divide(F.count_if("_hit").cast("double"), F.count(F.lit(1))).alias("precision"))


def bands(df: DataFrame, value: Column, edges: Sequence[int], **conditions: Column) -> DataFrame:
    """A row for each band [edge, next edge), the last one open, also for those without rows; n and a count for each condition."""
    band = F.lit(None).cast("int")
    for e in edges:
        band = F.when(value >= e, e).otherwise(band)
    counts = df.groupBy(band.alias("_band")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))
    every = df.sparkSession.createDataFrame([(e,) for e in edges], "band int")
    out = every.join(counts, F.col("band") == F.col("_band"), "left")
    return out.select("band", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", *conditions)))


def combinations(df: DataFrame, memberships: dict[str, Column]) -> DataFrame:
    """How many rows are in exactly each set of groups: their names in order joined by +."""
    names = F.array_join(F.array_compact(F.array(*(F.when(c, k) for k, c in memberships.items()))), "+")
    return df.groupBy(names.alias("groups")).agg(F.count(F.lit(1)).alias("n"))


def shared_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value, by the smallest and greatest alone: no set of a key's values is kept."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low <> _high").select(key)


def summary(df: DataFrame, total: str, bucket: str, paid: Column) -> DataFrame:
    """One row: count, average total to one decimal, rows of the buckets high, maybe and low, paid rows and their percent."""
    b = F.col(bucket)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(total), 1).alias("avg_total"), *(F.count_if(b == x).alias(x) for x in ("high", "maybe", "low")), F.count_if(paid).alias("n_paid"))
    return out.withColumn("paid_pct", percent(F.col("n_paid"), F.col("n")))
