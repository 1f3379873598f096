"""Samples for evaluation: cohorts drawn independently of each other, and their union with what each row was drawn for.

Draws are by a seeded hash of the id, so they don't depend on partitions or order, and each task keeps no more rows
of a stratum than can be drawn.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_n_per_group


def seeded(id_col: str, seed: int, of: str = "") -> Column:
    """A fixed random order of ids, another one for each seed and cohort."""
    return F.sha2(F.concat_ws("\x1f", F.lit(f"{seed}:{of}"), F.col(id_col).cast("string")), 256)


def first_of_each(df: DataFrame, id_col: str, order: Sequence[str | Column]) -> DataFrame:
    """One row of each id: the first by order. Rows without id are refused."""
    checked = df.withColumn(id_col, F.when(F.col(id_col).isNull() | (F.col(id_col).cast("string") == ""), F.raise_error(F.lit("a candidate without id"))).otherwise(F.col(id_col)))
    return first_n_per_group(checked, [id_col], [c if isinstance(c, Column) else F.col(c) for c in order])


def random_cohort(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows (all, if fewer) and their place."""
    return _placed(df.orderBy(seeded(id_col, seed, "random"), id_col).limit(n), [seeded(id_col, seed, "random"), F.col(id_col)])


def top_cohort(df: DataFrame, n: int, order: Sequence[Column], id_col: str = "id") -> DataFrame:
    """The first n rows by order, ties by id, and their place."""
    every = [*order, F.col(id_col)]
    return _placed(df.orderBy(*every).limit(n), every)


def stratified_cohort(df: DataFrame, n: int, seed: int, stratum: str, first: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """n rows, strata taking turns, those of `first` in their order before others by name; a stratum that is used up leaves its turns to the others. Rows without stratum aren't drawn."""
    mixed = seeded(id_col, seed, stratum)
    some = first_n_per_group(df.where(F.col(stratum).isNotNull()), [stratum], [mixed, F.col(id_col)], n, "_turn")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in first)).cast("array<string>"), F.col(stratum)), F.lit(0)), F.lit(len(first) + 1))
    order = [F.col("_turn"), rank, F.col(stratum)]
    return _placed(some.orderBy(*order).limit(n), order).drop("_turn")


def overlapping_cohort(df: DataFrame, n: int, seed: int, strata: Mapping[str, Column], id_col: str = "id") -> DataFrame:
    """n rows of strata that may share rows: in turn each gives its next row that none has given yet.

    A stratum passes over rows that were given already, n at most, so its first n rows are all that it can need: what
    meets in one task is n rows a stratum, whatever the table's size.
    """
    in_strata = F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, c) in enumerate(strata.items()))), lambda x: x.isNotNull())
    each = df.select(id_col, F.explode(in_strata).alias("s")).select(id_col, "s.k", "s.name")
    mixed = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), "name", F.col(id_col).cast("string")), 256)
    few = first_n_per_group(each, ["k"], [mixed, F.col(id_col)], n, "turn").select(F.lit(0).alias("one"), id_col, "k", "turn")

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        queues = [iter(own.sort_values("turn")[id_col].tolist()) for _, own in rows.groupby("k")]
        given: dict = {}
        while queues and len(given) < n:
            left = []
            for q in queues:
                i = next((i for i in q if i not in given), None)
                if i is not None and len(given) < n:
                    given[i] = len(given) + 1
                if i is not None:
                    left.append(q)
            queues = left
        return pd.DataFrame({id_col: list(given), "place": list(given.values())})

    chosen = few.groupBy("one").applyInPandas(deal, f"{id_col} {df.schema[id_col].dataType.simpleString()}, place int")
    return df.join(F.broadcast(chosen), id_col)


def _placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Numbers the few rows of a cohort from 1."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def union_of(cohorts: Mapping[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Each drawn row once, with groups (the cohorts that drew it, in their order) and position (from 1: the first cohort's rows in their order, then what the next adds)."""
    tagged = [df.select(id_col, F.lit(k).alias("_k"), F.lit(name).alias("_name"), "place") for k, (name, df) in enumerate(cohorts.items())]
    every = reduce(DataFrame.unionByName, tagged)
    one = every.groupBy(id_col).agg(F.min(F.struct("_k", "place")).alias("_first"), F.transform(F.array_sort(F.collect_set(F.struct("_k", "_name"))), lambda x: x["_name"]).alias("groups"))
    return one.withColumn("position", F.row_number().over(Window.orderBy("_first"))).select(id_col, "groups", "position")


def shortfalls(cohorts: Mapping[str, DataFrame], wanted: Mapping[str, int], available: Mapping[str, DataFrame]) -> DataFrame:
    """cohort, wanted, available, drawn, short for each cohort: short is what the quota lacks."""
    arms = []
    for name, df in cohorts.items():
        n, have = df.agg(F.count(F.lit(1)).alias("drawn")), available[name].agg(F.count(F.lit(1)).alias("available"))
        arms.append(n.join(have).select(F.lit(name).alias("cohort"), F.lit(wanted[name]).cast("long").alias("wanted"), "available", "drawn"))
    return reduce(DataFrame.unionByName, arms).withColumn("short", F.col("wanted") - F.col("drawn"))


def first_label(rules: Sequence[tuple[str, Column]]) -> Column:
    """The label of the first condition that holds; null if none does, a null condition doesn't."""
    return F.coalesce(*(F.when(c, F.lit(label)) for label, c in rules))
