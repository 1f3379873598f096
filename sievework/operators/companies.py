"""Company matching: labels to watched companies, company names to the employers of a roster.

Matching works on distinct keys, of which there are far fewer than rows; rows get the outcome by one join on
their key. Each tier runs on what the tiers before left, so the dear one, similar names, sees the rest only.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.companies import label_key
from ..functions.text import C, col, company_key

#: A name is similar from this ratio of matching characters on.
SIMILAR = 0.88
#: Below this ratio a short name would need more segments than it has characters.
LEAST_RATIO = 0.75


# -- watched companies ------------------------------------------------------------------------------


def labels_of(companies: DataFrame, company: str = "company", aliases: str = "aliases", key=label_key) -> DataFrame:
    """key, company, label: every label that a company claims, its name before its aliases; of labels of one key its first."""
    every = companies.select(company, F.posexplode(F.concat(F.array(company), F.coalesce(aliases, F.array().cast("array<string>")))).alias("place", "label"))
    keyed = every.select(F.col(company).alias("company"), "label", "place", key("label").alias("key")).where("key <> ''")
    return keyed.groupBy("key", "company").agg(F.min_by("label", "place").alias("label"))


def match_companies(rows: DataFrame, companies: DataFrame, label: C, company: str = "company", aliases: str = "aliases") -> DataFrame:
    """rows with matched_company, matched_label and n_claims: the one company that claims the label's key; null where none or several do.

    A blank or null label is claimed by none. Companies of one name are one company. Repeated rows stay. Claims
    are settled before the join, so it adds no rows; Spark broadcasts them where they are small.
    """
    claims = labels_of(companies, company, aliases).groupBy("key").agg(F.count(F.lit(1)).alias("n_claims"), F.min("company").alias("company"), F.min("label").alias("label"))
    one = F.col("n_claims") == 1
    claims = claims.select(F.col("key").alias("_key"), "n_claims", F.when(one, F.col("company")).alias("matched_company"), F.when(one, F.col("label")).alias("matched_label"))
    keyed = rows.withColumn("_label_key", F.nullif(label_key(label), F.lit("")))
    out = keyed.join(claims, F.col("_label_key") == F.col("_key"), "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))
    return out.select(*rows.columns, "matched_company", "matched_label", "n_claims")


# -- similar names ----------------------------------------------------------------------------------


def _budget(a: Column, b: Column, ratio: float) -> Column:
    """Characters of both names that may stay unmatched."""
    return F.floor((a + b) * F.lit(1 - ratio) + F.lit(1e-6)).cast("int")


def _longest(n: Column, ratio: float) -> Column:
    """The longest name that can be similar to one of n characters."""
    return F.floor(n * F.lit((2 - ratio) / ratio) + F.lit(1e-6)).cast("int")


def _segments(n: Column, ratio: float) -> Column:
    """One more segment than characters can stay unmatched, so that one segment is whole in any similar name."""
    return _budget(n, _longest(n, ratio), ratio) + 1


def _edge(i: Column, n: Column, k: Column) -> Column:
    return F.floor(i * n / k).cast("int")


def _indexed(names: DataFrame, ratio: float) -> DataFrame:
    """Segments of each name: name, n (its length), i, part."""
    n, k, i = F.col("n"), F.col("k"), F.col("i")
    out = names.withColumn("n", F.length("name")).withColumn("k", _segments(n, ratio)).withColumn("i", F.explode(F.sequence(F.lit(0), k - 1)))
    start = _edge(i, n, k)
    return out.select("name", "n", "i", F.substring(F.col("name"), start + 1, _edge(i + 1, n, k) - start).alias("part"))


def _probes(names: DataFrame, lengths: DataFrame, ratio: float) -> DataFrame:
    """What _indexed has of any name similar to name: for each of the lengths (n) that there are, each segment and shift, the characters of name there."""
    m, n, k, i, at = (F.col(c) for c in ("m", "n", "k", "i", "at"))
    least = F.greatest(F.ceil(m * F.lit(ratio / (2 - ratio)) - F.lit(1e-6)).cast("int"), F.lit(1))
    out = names.withColumn("m", F.length("name")).withColumn("n", F.explode(F.sequence(least, _longest(m, ratio)))).join(F.broadcast(lengths), "n")
    out = out.withColumn("k", _segments(n, ratio)).withColumn("i", F.explode(F.sequence(F.lit(0), k - 1)))
    budget, start, size = _budget(m, n, ratio), _edge(i, n, k), _edge(i + 1, n, k) - _edge(i, n, k)
    # of the unmatched characters (budget + m - n) / 2 at most are name's, the others the similar name's
    low, high = F.greatest(start - F.floor((budget - m + n) / 2).cast("int"), F.lit(0)), F.least(start + F.floor((budget + m - n) / 2).cast("int"), m - size)
    out = out.withColumn("size", size).withColumn("at", F.explode(F.when(low <= high, F.sequence(low, high))))
    return out.select("name", "n", "i", F.substring(F.col("name"), at + 1, F.col("size")).alias("part"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_names(left: DataFrame, right: DataFrame, ratio: float = SIMILAR) -> DataFrame:
    """left_name, right_name, ratio of all pairs of distinct names whose ratio of matching characters is `ratio` or more.

    left, right: a column `name`; null and empty names are similar to nothing. 2 * matches / characters of both, matches
    as of difflib's blocks, left's name first. No pair is missed: similar names leave so few characters unmatched that one of the
    segments of the right name stands whole in the left one, near its place. Lengths, shared characters and the edit
    distance, all bounds of the ratio, are tested before it.
    """
    if ratio < LEAST_RATIO:
        raise ValueError(f"ratio below {LEAST_RATIO}")
    clean = lambda df: df.select("name").where("name <> ''").distinct()
    known = clean(right)
    # a row for each length, so no more than the longest name has characters
    lengths = known.select(F.length("name").alias("n")).distinct()
    a, b = _probes(clean(left), lengths, ratio).withColumnRenamed("name", "left_name"), _indexed(known, ratio).withColumnRenamed("name", "right_name")
    near = F.expr(f"levenshtein(left_name, right_name) <= floor((length(left_name) + length(right_name)) * {1 - ratio!r} + 1e-6)")
    pairs = a.join(b, ["n", "i", "part"]).where(near).select("left_name", "right_name").distinct()
    return pairs.withColumn("ratio", _ratio("left_name", "right_name")).where(F.col("ratio") >= ratio)


# -- employers of a roster --------------------------------------------------------------------------


def employer_links(names: DataFrame, employers: DataFrame, aliases: DataFrame, ratio: float | None = SIMILAR) -> DataFrame:
    """name, employer, tier, place: the employers that a name stands for, by the first tier that finds any.

    names: name; employers: employer; aliases: alias, target; all of them keys, an alias of several targets counts for the
    smallest. Tiers: `exact` (the employer itself, then those that are aliases of it), `alias` (the name's target or, where
    that is no employer, other aliases of it), `reverse` (employers that are aliases of the name), `similar` (the most
    similar employer, the smaller of equals; not where ratio is None). place: the order within the tier. Null and empty
    names have no links.
    """
    name = names.select("name").where("name <> ''").distinct()
    known = employers.select("employer").where("employer <> ''").distinct()
    to = aliases.where("alias <> '' and target <> ''").groupBy("alias").agg(F.min("target").alias("target"))
    # employers that are aliases, by what they are aliases of, in the order of their keys
    of = to.join(known, F.col("alias") == F.col("employer")).select("target", "employer").withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("employer")))

    def tier(df: DataFrame, n: int, what: str, place) -> DataFrame:
        return df.select("name", "employer", F.lit(n).alias("n"), F.lit(what).alias("tier"), place.cast("int").alias("place"))

    own = name.join(known, F.col("name") == F.col("employer"))
    back = name.join(of, F.col("name") == F.col("target"))
    target = name.join(to, F.col("name") == F.col("alias")).select("name", "target")
    found = tier(own, 0, "exact", F.lit(0))
    found = found.unionByName(tier(target.join(known, F.col("target") == F.col("employer")), 1, "alias", F.lit(0)))
    found = found.unionByName(tier(target.join(of, "target"), 2, "alias", F.col("place"))).unionByName(tier(back, 3, "reverse", F.col("place")))
    first = F.min("n").over(Window.partitionBy("name"))
    # an exact name has its aliases' employers too
    kept = found.withColumn("first", first).where((F.col("n") == F.col("first")) | (F.col("first") == 0) & (F.col("n") == 3))
    kept = kept.groupBy("name", "employer").agg(F.min("place").alias("place"), F.min(F.struct("first", F.when(F.col("first") == 0, "exact").otherwise(F.col("tier")).alias("tier")))["tier"].alias("tier"))
    kept = kept.select("name", "employer", "tier", "place")
    if ratio is None:
        return kept
    rest = name.join(kept.select("name").distinct(), "name", "left_anti")
    best = similar_names(rest, known.select(F.col("employer").alias("name")), ratio).groupBy("left_name").agg(F.min(F.struct(-F.col("ratio"), "right_name"))["right_name"].alias("employer"))
    return kept.unionByName(best.select(F.col("left_name").alias("name"), "employer", F.lit("similar").alias("tier"), F.lit(0).alias("place")))


RECORD = ("name", "occupation", "linkedin_url", "employer")


def attach_roster(rows: DataFrame, roster: DataFrame, aliases: DataFrame, company: C, companies: DataFrame | None = None, ratio: float | None = SIMILAR, into: str = "alumni") -> DataFrame:
    """rows, one for one, with the array `into` of the roster's records whose employer the company stands for; empty where there are none.

    roster: name, occupation, linkedin_url, employer, position (its order); aliases: alias, target (labels);
    companies: company, aliases, roster_names (arrays), position: watched companies; all names of the one that claims a
    row's company are looked up as well, in order, and similar names only where none of them finds anything. A
    record stands once. Arrays are made once for each distinct company, not for each row.
    """
    records = roster.select(*RECORD, "position", company_key("employer").alias("_employer")).where("_employer <> ''")
    keyed = rows.withColumn("_company", company_key(company))
    own = keyed.select(F.col("_company").alias("key")).where("key <> ''").distinct()
    asked = own.select("key", F.lit(0).alias("turn"), F.col("key").alias("name"))
    if companies is not None:
        several = F.concat(F.array("company"), *(F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "roster_names")))
        every = companies.select("position", F.posexplode(several).alias("turn", "label")).select("position", (F.col("turn") + 1).alias("turn"), company_key("label").alias("name")).where("name <> ''")
        claimed = every.groupBy("name").agg(F.min("position").alias("position")).withColumnRenamed("name", "key")
        asked = asked.unionByName(own.join(claimed, "key").join(every, "position").select("key", "turn", "name"))
    to = aliases.select(company_key("alias").alias("alias"), company_key("target").alias("target"))
    employers = records.select(F.col("_employer").alias("employer"))
    links = asked.join(employer_links(asked, employers, to, None), "name").select("key", "turn", "place", F.col("employer").alias("_employer"))
    if ratio is not None:
        rest = own.join(links.select("key").distinct(), "key", "left_anti").select(F.col("key").alias("name"))
        last = employer_links(rest, employers, to, ratio).select(F.col("name").alias("key"), F.lit(0).alias("turn"), "place", F.col("employer").alias("_employer"))
        links = links.unionByName(last)
    found = links.join(records, "_employer").groupBy("key", *RECORD).agg(F.min(F.struct("turn", "place", "position")).alias("order"))
    arrays = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("order", F.struct(*RECORD).alias("record")))).alias("all"))
    arrays = arrays.select(F.col("key").alias("_key"), F.transform("all", lambda x: x["record"]).alias(into))
    out = keyed.join(arrays, F.col("_company") == F.col("_key"), "left").drop("_company", "_key")
    return out.withColumn(into, F.coalesce(into, F.array().cast(arrays.schema[into].dataType)))


def alias_table(spark, pairs) -> DataFrame:
    """(alias, target) labels as the table that the operators take."""
    return spark.createDataFrame(list(pairs), "alias string, target string")


# Other names of employers, each with the name that a roster has.
KNOWN_ALIASES = (
    ("Bosch Group", "Bosch"), ("Robert Bosch", "Bosch"), ("BoschGroup", "Bosch"), ("Tesla Motors", "Tesla"), ("Google LLC", "Google"),
    ("Capital One Financial", "Capital One"), ("Capitol One", "Capital One"), ("J.P. Morgan", "JPMorgan Chase"), ("JP Morgan", "JPMorgan Chase"),
    ("JPMorgan", "JPMorgan Chase"), ("JPMC", "JPMorgan Chase"), ("HP Inc", "HP"), ("Hewlett Packard", "HP"), ("Hewlett-Packard", "HP"),
    ("Intuitive", "Intuitive Surgical"), ("ASML US", "ASML"), ("WhatNot", "Whatnot"), ("KPMG US", "KPMG"), ("Ernst & Young", "EY"), ("Ernst and Young", "EY"),
)


def roster_size(roster: DataFrame) -> DataFrame:
    """records, employers: rows of a roster with a usable employer, and distinct employers among them."""
    key = company_key(col("employer"))
    return roster.where(key != "").agg(F.count(F.lit(1)).alias("records"), F.countDistinct(key).alias("employers"))
