"""Ranking, sampling and ordering of rows within groups.

All orders given by callers should be total: Spark's sort isn't stable over partitions, so a last key that is
unique decides ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_group(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; rank names a column for the place from 1. Spark keeps n rows of a group in each task before the shuffle (WindowGroupLimit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest order columns of each key, by one aggregation that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col("_top")[c].alias(c) for c in rest))


def round_robin(df: DataFrame, by: Sequence[str], order: Sequence[Column], turn: str = "turn") -> DataFrame:
    """Adds each row's turn in its group from 1: sorted by turn and group, groups take turns."""
    return df.withColumn(turn, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, strata taking turns in the order of their names, rows of a stratum in the order of a seeded hash of their key.

    No stratum needs more than n rows, so only so many of each are ranked against all others.
    """
    mixed = F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), F.col(key).cast("string")), 256)
    turns = first_n_per_group(df.withColumn("_mixed", mixed), [stratum], [F.col("_mixed"), F.col(key)], n, "_turn")
    return turns.orderBy("_turn", stratum).limit(n).drop("_mixed", "_turn")


def sample_per_group(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows of each group of the lowest SHA-256 of their key: the same rows whatever the input's order."""
    return first_n_per_group(df, [by], [F.sha2(F.col(key).cast("string"), 256), F.col(key)], n)


def top_k(df: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(k)


def dominant(df: DataFrame, by: Sequence[str], value: str, share: float = 0.6, least: int = 5) -> DataFrame:
    """The most frequent value of each group (ties to the smaller), its count, the group's and whether it dominates: `share` of `least` rows or more."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    out = counts.groupBy(*by).agg(top.alias("_top"), F.sum("n").alias("total"))
    n = -F.col("_top.m")
    return out.select(*by, F.col("_top.v").alias(value), n.alias("n"), "total", ((F.col("total") >= least) & (n >= F.lit(share) * F.col("total"))).alias("dominates"))
