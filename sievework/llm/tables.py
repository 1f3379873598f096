"""Where the operators read their tables, and in what batches Python sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.storage import forget, shared_dir, written

__all__ = ["forget", "fresh", "shared_dir", "small_batches", "table", "written"]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts reach Python in batches of few rows: a worker's memory follows the longest texts, not the default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that df has no column of, in any case of letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
