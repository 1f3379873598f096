"""JSON of any depth as rows, one a node, by built-in functions: a frontier of variants is opened level by level until nothing nested is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import forget, written

#: What stands for a value under a hidden name.
HIDDEN = "[redacted]"
#: A level below which nothing reasonable nests.
MOST_DEPTH = 200


def _step(key: Column, pos: Column) -> Column:
    """A key that is a word, another key in brackets and quotes, or a place in an array."""
    quoted = F.concat(F.lit("['"), F.replace(key, F.lit("'"), F.lit("\\'")), F.lit("']"))
    return F.when(key.isNull(), F.concat(F.lit("["), pos, F.lit("]"))).when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(quoted)


def _kind(v: Column) -> Column:
    """object, array, or the type of a scalar."""
    shape = F.schema_of_variant(v)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null").otherwise(F.lower(shape))


def nodes(df: DataFrame, id_col: str, json_col: str, hide: str | None = None) -> DataFrame:
    """id, path, depth, key, kind, value of every node of each row's JSON text, the text itself ($, depth 0) included.

    value is a scalar's text, null for objects, arrays and nulls. hide: a regular expression of names; a scalar beneath one is
    HIDDEN, at any depth. A null or malformed text has no nodes; repeated rows have theirs each; a key that a text
    has twice makes it malformed. Levels are tables in the shared folder, so a plan stays small at any depth and a
    lost executor costs a level; what is nested deeper than MOST_DEPTH is refused.
    """
    spark = df.sparkSession
    v = F.try_parse_json(F.col(json_col).cast("string"))
    now = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("hidden"), v.alias("v")).where("v is not null")
    levels: list[DataFrame] = []
    for _ in range(MOST_DEPTH + 1):
        level = now.withColumn("kind", _kind(F.col("v")))
        text = F.when(F.col("kind").isin("object", "array", "null"), None).otherwise(F.when(F.col("hidden"), HIDDEN).otherwise(F.try_variant_get("v", "$", "string")))
        # a variant's bytes are kept as they are for the next level
        level = written(level.withColumn("value", text), "level", tidy=False)
        levels.append(level)
        nested = level.where("kind in ('object', 'array')")
        if nested.isEmpty():
            break
        opened = spark.sql("SELECT n.id, n.path, n.depth, n.hidden, x.pos, x.key AS step, x.value AS v FROM {nested} n, LATERAL variant_explode(n.v) x", nested=nested)
        hidden = F.col("hidden") if hide is None else F.col("hidden") | F.coalesce(F.col("step").rlike(hide), F.lit(False))
        now = opened.select("id", F.concat("path", _step(F.col("step"), F.col("pos"))).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("step").alias("key"), hidden.alias("hidden"), "v")
    else:
        raise ValueError(f"JSON nested deeper than {MOST_DEPTH}")
    out = written(reduce(DataFrame.unionByName, (x.select("id", "path", "depth", "key", "kind", "value") for x in levels)), "nodes", tidy=False)
    for level in levels:
        forget(level)
    return out


def leaves(found: DataFrame) -> DataFrame:
    """Of nodes() those that hold no others: scalars, nulls, empty objects and arrays."""
    parents = found.where("depth > 0").select("id", F.regexp_replace("path", r"(\.[A-Za-z_][A-Za-z0-9_]*|\[[0-9]+\]|\['(?:[^'\\]|\\.)*'\])$", "").alias("path")).distinct()
    return found.join(parents, ["id", "path"], "left_anti")


def stable_digest(found: DataFrame) -> DataFrame:
    """id, digest: a SHA-256 that is equal for equal values, whatever the order of their keys."""
    said = F.concat_ws("\x1f", "path", "kind", F.coalesce("value", F.lit("")))
    return leaves(found).groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(said)), "\x1e"), 256).alias("digest"))


def texts_under(found: DataFrame, names: str) -> DataFrame:
    """id, path, value of the texts that stand at or beneath a key of these names (a regular expression of whole names, case ignored), in any depth."""
    beneath = F.col("path").rlike(rf"(?i)(\.|\[')({names})('\]|\.|\[|$)")
    return found.where((F.col("kind") == "string") & beneath).select("id", "path", "value")
