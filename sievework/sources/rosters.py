"""Rosters: who works where, from a CSV file or from a JSON map of companies to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text
from ..operators.companies import RECORD

# The columns of a roster file.
COLUMNS = ("First Name", "Last Name", "Occupation", "Employer", "LinkedIn URL")


def _given(c: str):
    return F.regexp_replace(text(c), r"^\s+|\s+$", "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, occupation, linkedin_url, employer, position of the rows with an employer; refused where a column is missing.

    position: by the files' bytes and rows, so it only orders rows.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    if missing := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"roster without column(s): {', '.join(missing)}; found: {', '.join(raw.columns) or '(none)'}")
    name = F.concat_ws(" ", *(F.nullif(_given(f"`{c}`"), F.lit("")) for c in COLUMNS[:2]))
    rows = raw.select(name.alias("name"), _given("Occupation").alias("occupation"), _given("`LinkedIn URL`").alias("linkedin_url"), _given("Employer").alias("employer"), F.monotonically_increasing_id().alias("position"))
    return rows.where("employer <> ''")


def parse_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same columns from texts of JSON maps of companies to arrays of records; a record without employer has its company's.

    A text that is no such map fails, as does a record that is no object.
    """
    whole = "map<string, array<struct<name:string, occupation:string, linkedin_url:string, employer:string>>>"
    maps = texts.select(F.from_json(column, whole, {"mode": "FAILFAST"}).alias("m"))
    each = maps.select(F.posexplode(F.map_entries("m")).alias("k", "e")).select("k", "e.key", F.posexplode("e.value").alias("n", "r"))
    given = {c: F.regexp_replace(text(f"r.{c}"), r"^\s+|\s+$", "") for c in RECORD}
    given["employer"] = F.when(given["employer"] == "", F.regexp_replace(text("key"), r"^\s+|\s+$", "")).otherwise(given["employer"])
    position = F.col("k").cast("long") * (1 << 32) + F.col("n")
    return each.select(*(c.alias(k) for k, c in given.items()), position.alias("position")).where("employer <> ''")
