"""Messy CSV files to canonical postings: delimiter, headers, cells and blanks are settled before anything else sees a row."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell
from ..operators.dedupe import FIELDS

# What headers call each field.
ALIASES = {
    "company": ("company", "company name", "employer", "org", "organization", "firm", "hiring company"),
    "title": ("title", "job title", "role", "position", "job", "posting title", "role title"),
    "location": ("location", "city", "loc", "job location", "office", "where"),
    "compensation": ("compensation", "comp", "pay", "salary", "stipend", "wage", "rate", "pay rate", "hourly rate", "pay range"),
    "description": ("description", "desc", "summary", "about", "job description", "details", "overview", "about the role"),
    "requirements": ("requirements", "qualifications", "quals", "skills", "required skills", "must have", "preferred qualifications", "requirements qualifications"),
    "source_url": ("source url", "url", "link", "apply link", "posting url", "application link", "href", "source", "job url"),
    "date_posted": ("date posted", "posted", "posting date", "posted on", "listed", "date listed"),
    "deadline": ("deadline", "apply by", "due", "due date", "closing date", "applications close", "apply before", "close date"),
    "remote_status": ("remote status", "remote", "work mode", "location type", "onsite remote", "workplace", "arrangement", "work arrangement"),
    "internship_type": ("internship type", "type", "term", "season", "duration", "program", "internship term"),
}
ONE_LINE = ("company", "title", "location", "remote_status", "internship_type", "date_posted", "deadline")
_FIELD = {a: f for f, names in ALIASES.items() for a in names}


@dataclass
class Mapping:
    """field of each header that has one; what was left out, and why."""

    fields: dict[str, str] = field(default_factory=dict)
    unmapped: list[str] = field(default_factory=list)
    collisions: list[tuple[str, str]] = field(default_factory=list)


def norm_header(h: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", " ", (h or "").strip().lower()).strip()


def map_headers(headers: list[str]) -> Mapping:
    """Headers to fields: by name, else by the longest name within a header that isn't an id; the first claim of a field wins."""
    out = Mapping()
    for h in headers:
        n = norm_header(h)
        f = _FIELD.get(n)
        if f is None and n and not {"id", "identifier"} & set(n.split()):
            f = max(((len(a), x) for a, x in _FIELD.items() if len(a) >= 3 and a in n), default=(0, None))[1]
        if f is None or f in out.fields.values():
            out.unmapped.append(h)
            if f:
                out.collisions.append((h, f))
        else:
            out.fields[h] = f
    return out


def sniff(head: str) -> str:
    """The delimiter of a file's first characters: comma, semicolon, tab or bar; comma if unclear."""
    try:
        return csv.Sniffer().sniff(head[:4096], ",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, Mapping]:
    """(rows, mapping) of CSV files: pos, FIELDS and extra, a map of other cells that aren't blank.

    Only the head of the first file comes to the driver. Rows without any text are dropped; an empty file and
    a repeated header are errors. pos follows files' order and that of rows in them.
    """
    head = spark.read.option("wholetext", False).text(path).where(F.trim("value") != "").limit(1).collect()
    if not head:
        raise ValueError("the file is empty")
    first = head[0][0].lstrip("﻿")
    sep = sniff(first)
    headers = next(csv.reader([first], delimiter=sep))
    if len({h.strip() for h in headers}) < len(headers):
        raise ValueError("a header is repeated")
    names = [f"c{i}" for i in range(len(headers))]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)
    raw = raw.where(F.exists(F.array(*names), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    mapping = map_headers(headers)
    of = {f: n for n, h in zip(names, headers, strict=True) if (f := mapping.fields.get(h))}
    cells = [clean_cell(of[f], f in ONE_LINE).alias(f) if f in of else F.lit("").alias(f) for f in FIELDS]
    rest = [x for n, h in zip(names, headers, strict=True) if h not in mapping.fields for x in (F.lit(h.strip()), clean_cell(n))]
    extra = F.map_filter(F.create_map(*rest), lambda k, v: v != "") if rest else F.create_map().cast("map<string,string>")
    return raw.select(F.monotonically_increasing_id().alias("pos"), *cells, extra.alias("extra")), mapping


def infer_fields(rows: DataFrame) -> DataFrame:
    """rows with blanks that their own text settles filled: remote_status, then location, then internship_type; inferred lists which."""
    blob = F.lower(F.concat_ws(" ", "location", "title", "description"))
    about = F.lower(F.concat_ws(" ", "title", "description"))
    remote = F.when(blob.rlike("\\bhybrid\\b"), "Hybrid").when(blob.rlike("\\bremote\\b"), "Remote").when(blob.rlike("\\bon[- ]?site\\b"), "On-site").otherwise("")
    season = F.regexp_extract(about, "\\b(summer|fall|spring|winter)\\b", 1)
    term = F.when(season != "", F.initcap(season)).when(blob.rlike("\\bco[- ]?op\\b"), "Co-op").otherwise("")
    out = rows.withColumns({"_r": F.when(F.col("remote_status") == "", remote).otherwise(F.col("remote_status")), "_t": F.when(F.col("internship_type") == "", term).otherwise(F.col("internship_type"))})
    out = out.withColumn("_l", F.when((F.col("location") == "") & (F.lower("_r") == "remote"), "Remote").otherwise(F.col("location")))
    pairs = (("remote_status", "_r"), ("location", "_l"), ("internship_type", "_t"))
    inferred = F.array_compact(F.array(*(F.when((F.col(a) == "") & (F.col(b) != ""), a) for a, b in pairs)))
    return out.withColumn("inferred", inferred).withColumns({a: F.col(b) for a, b in pairs}).drop("_r", "_l", "_t")
