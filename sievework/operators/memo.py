"""Results kept from run to run: rows whose inputs are known by their fingerprint aren't computed again.

A memo is a folder of two Parquet tables that runs only append to: `artifacts` (fingerprint and results, by version) and
`touches` (fingerprint, day of an access). A fingerprint determines its result, so of several copies any one does,
and runs that write at once do no harm.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import forget, written

RETENTION_DAYS = 30


def stable_json(value: object) -> str:
    """One text for equal values: compact, keys and sets sorted; NaN and what JSON doesn't have are refused."""

    def plain(v):
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, set | frozenset):
            return sorted((plain(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if v is None or isinstance(v, str | int | float | bool):
            return v
        raise TypeError(f"no stable JSON for {type(v).__name__}")

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def fingerprint(fields: Mapping[str, Column], context: str = "null") -> Column:
    """SHA-256 of the context and of the fields as canonical JSON: by name, nulls told from empty texts."""
    row = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit('{"context":' + context + ',"row":'), row, F.lit("}")), 256)


@dataclass(frozen=True)
class Stats:
    """Distinct fingerprints: rows, found in the memo, missing, found but not valid, written."""

    fingerprints: int
    hits: int
    misses: int
    invalid: int
    writes: int

    @property
    def hit_rate(self) -> float:
        return self.hits / self.fingerprints if self.fingerprints else 0.0


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None where nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(at) and files.listStatus(at) else None


def known(spark: SparkSession, path: str, version: int, valid: Column | None = None) -> DataFrame | None:
    """One row a fingerprint: the memo's results of this version that are valid."""
    table = _read(spark, f"{path}/artifacts")
    if table is None:
        return None
    table = table.where(F.col("version") == version).drop("version", "stored_on")
    return (table if valid is None else table.where(valid)).dropDuplicates(["fingerprint"])


def remembered(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], version: int, now: datetime.date, keep: Sequence[str] | None = None, valid: Column | None = None) -> tuple[DataFrame, Stats]:
    """(rows' columns of `keep` with their results, stats): results come from the memo, missing ones are computed, once for equal rows, and stored.

    rows: a table with a column fingerprint; compute: from some of its rows to fingerprint and result columns; valid: what
    a stored or computed result must fulfil to count; others are computed again, and nulls where they fail again. Rows
    stay one for one. Only fingerprints are read to see what is missing; other columns of rows are read for missing
    ones alone, and in the result only those of `keep`. A computation that dies stores nothing that counts as done.
    """
    spark = rows.sparkSession
    asked = written(rows.select("fingerprint").distinct(), "asked", tidy=False)
    have = known(spark, path, version, valid)
    missing = asked if have is None else written(asked.join(have.select("fingerprint"), "fingerprint", "left_anti"), "missing", tidy=False)
    total, misses = asked.count(), missing.count()
    every = _read(spark, f"{path}/artifacts")
    stored = 0 if every is None or not misses else missing.join(every.where(F.col("version") == version).select("fingerprint").distinct(), "fingerprint", "left_semi").count()
    writes = 0
    if misses:
        # written before it is tested: a filter on it would be pushed into the computation, which then runs twice
        fresh = written(compute(rows.join(missing, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])), "fresh", tidy=False)
        good = fresh if valid is None else fresh.where(valid)
        writes = good.count()
        good.withColumns({"version": F.lit(version), "stored_on": F.lit(now)}).write.mode("append").partitionBy("version").parquet(f"{path}/artifacts")
        forget(fresh)
    asked.withColumn("touched_on", F.lit(now)).write.mode("append").parquet(f"{path}/touches")
    out = rows.select(*(keep or rows.columns))
    results = known(spark, path, version, valid)
    if results is not None:
        out = out.join(results, "fingerprint", "left")
    if missing is not asked:
        forget(missing)
    forget(asked)
    return out, Stats(total, total - misses, misses, stored, writes)


def compacted(spark: SparkSession, path: str, into: str, now: datetime.date, days: int = RETENTION_DAYS, valid: Column | None = None) -> int:
    """Writes the memo at path to the folder `into`, without results last used more than `days` ago, invalid ones and copies; returns the rows kept.

    The old folder stays as it is, so readers and a failed run lose nothing; the caller goes over to the new one.
    """
    table, touches = _read(spark, f"{path}/artifacts"), _read(spark, f"{path}/touches")
    if table is None or touches is None:
        return 0
    last = touches.groupBy("fingerprint").agg(F.max("touched_on").alias("touched_on")).where(F.col("touched_on") >= F.lit(now - datetime.timedelta(days=days)))
    kept = (table if valid is None else table.where(valid)).dropDuplicates(["fingerprint", "version"]).join(last.select("fingerprint"), "fingerprint", "left_semi")
    kept.write.mode("errorifexists").partitionBy("version").parquet(f"{into}/artifacts")
    last.write.mode("errorifexists").parquet(f"{into}/touches")
    copied = _read(spark, f"{into}/artifacts")
    return 0 if copied is None else copied.count()
