"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the cluster names none, as in tests, one is set here."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = "/tmp/checkpoints/sievework"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, what: str, tidy: bool = True) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends here and it outlives any executor. tidy: what it shuffled goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    # a writer holds a row group in memory
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    # what the write shuffled is of no more use; else it stays until the driver happens to collect its garbage
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote for df, once all that came from it is written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
