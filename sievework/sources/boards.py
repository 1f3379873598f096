"""Payloads of job boards to canonical postings: one declared schema and one projection for each board.

A payload file is a JSON document; from_json reads it in permissive mode with the fields that are used, so that
columns of the payload that aren't asked for cost nothing. Records without title or URL are rejects, with a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_day
from ..functions.text import html_text, text
from ..operators.dedupe import FIELDS


@dataclass(frozen=True)
class Board:
    """schema of a payload, the array of its records and the fields of one record r."""

    name: str
    schema: str
    records: Callable[[Column], Column]
    fields: Callable[[Column], dict[str, Column]]
    keep: Callable[[Column], Column] = lambda r: F.lit(True)


def _list(*parts: Column) -> Column:
    """Distinct parts that aren't blank, in order."""
    given = F.filter(F.array(*(F.trim(text(p)) for p in parts)), lambda x: x != "")
    return F.array_join(F.array_distinct(given), ", ")


def _names(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_join(F.array_distinct(F.filter(F.transform(values, of), lambda x: x.isNotNull() & (x != ""))), "; "), F.lit(""))


def _metadata(r: Column, name: str) -> Column:
    return F.try_element_at(F.filter(r["metadata"], lambda m: F.lower(m["name"]) == name), F.lit(1))["value"]


def _range(s: Column) -> Column:
    money = lambda c: F.regexp_replace(F.format_number(c, 0), "\\.0$", "")
    both = F.concat_ws(" - ", F.when(s["min"].isNotNull(), money(s["min"])), F.when(s["max"].isNotNull(), money(s["max"])))
    return F.when(both != "", F.concat_ws(" ", text(s["currency"]), both, F.when(s["interval"] != "", F.concat(F.lit("per "), F.regexp_replace(s["interval"], "^per-|-salary$|-wage$", ""))))).otherwise("")


BOARDS = {
    b.name: b
    for b in (
        Board(
            "greenhouse",
            "jobs array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,content:string,first_published:string,updated_at:string,metadata:array<struct<name:string,value:string>>>>",
            lambda p: p["jobs"],
            lambda r: {
                "title": r["title"],
                "location": r["location"]["name"],
                "description": html_text(html_text(r["content"])),
                "source_url": r["absolute_url"],
                "date_posted": iso_day(F.coalesce(r["first_published"], r["updated_at"])),
                "compensation": _metadata(r, "salary range"),
                "internship_type": _metadata(r, "employment type"),
                "source_id": r["id"],
            },
        ),
        Board(
            "lever",
            "postings array<struct<id:string,text:string,hostedUrl:string,descriptionPlain:string,createdAt:long,workplaceType:string,categories:struct<location:string,commitment:string,allLocations:array<string>>,lists:array<struct<text:string,content:string>>,salaryRange:struct<min:double,max:double,currency:string,interval:string>>>",
            lambda p: p["postings"],
            lambda r: {
                "title": r["text"],
                "location": F.when(F.size(r["categories"]["allLocations"]) > 0, _names(r["categories"]["allLocations"], lambda x: x)).otherwise(r["categories"]["location"]),
                "description": r["descriptionPlain"],
                "requirements": F.array_join(F.transform(F.filter(r["lists"], lambda s: F.lower(s["text"]).rlike("requirement|qualification|skill|looking for|need")), lambda s: html_text(s["content"])), "\n"),
                "source_url": r["hostedUrl"],
                "date_posted": iso_day(r["createdAt"]),
                "remote_status": r["workplaceType"],
                "internship_type": r["categories"]["commitment"],
                "compensation": _range(r["salaryRange"]),
                "source_id": r["id"],
            },
        ),
        Board(
            "ashby",
            "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,isListed:boolean,isRemote:boolean,employmentType:string,publishedAt:string,jobUrl:string,descriptionPlain:string,compensation:struct<compensationTierSummary:string>>>",
            lambda p: p["jobs"],
            lambda r: {
                "title": r["title"],
                "location": _names(F.concat(F.array(r["location"]), F.coalesce(F.transform(r["secondaryLocations"], lambda x: x["location"]), F.array())), lambda x: x),
                "description": r["descriptionPlain"],
                "source_url": r["jobUrl"],
                "date_posted": iso_day(r["publishedAt"]),
                "remote_status": F.when(r["isRemote"], "Remote"),
                "internship_type": r["employmentType"],
                "compensation": r["compensation"]["compensationTierSummary"],
                "source_id": r["id"],
            },
            lambda r: F.coalesce(r["isListed"], F.lit(True)),
        ),
        Board(
            "workable",
            "total long, results array<struct<id:string,shortcode:string,title:string,remote:boolean,workplace:string,type:string,published:string,description:string,requirements:string,url:string,location:struct<city:string,region:string,country:string>,locations:array<struct<city:string,region:string,country:string>>>>",
            lambda p: p["results"],
            lambda r: {
                "title": r["title"],
                "location": F.when(F.size(r["locations"]) > 0, _names(r["locations"], lambda x: _list(x["city"], x["region"], x["country"]))).otherwise(_list(r["location"]["city"], r["location"]["region"], r["location"]["country"])),
                "description": html_text(r["description"]),
                "requirements": html_text(r["requirements"]),
                "source_url": F.coalesce(r["url"], F.concat(F.lit("https://apply.workable.com/j/"), r["shortcode"])),
                "date_posted": iso_day(r["published"]),
                "remote_status": F.coalesce(r["workplace"], F.when(r["remote"], "Remote")),
                "internship_type": r["type"],
                "source_id": r["shortcode"],
            },
        ),
        Board(
            "smartrecruiters",
            "totalFound long, offset long, content array<struct<id:string,name:string,releasedDate:string,company:struct<identifier:string,name:string>,location:struct<city:string,region:string,country:string,remote:boolean>,customField:array<struct<fieldLabel:string,valueLabel:string>>,typeOfEmployment:struct<label:string>>>",
            lambda p: p["content"],
            lambda r: {
                "title": r["name"],
                "location": _list(r["location"]["city"], r["location"]["region"], r["location"]["country"]),
                "source_url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), r["company"]["identifier"], F.lit("/"), r["id"]),
                "date_posted": iso_day(r["releasedDate"]),
                "remote_status": F.when(r["location"]["remote"], "Remote"),
                "internship_type": F.coalesce(r["typeOfEmployment"]["label"], F.try_element_at(F.filter(r["customField"], lambda c: F.lower(c["fieldLabel"]).rlike("employment|contract")), F.lit(1))["valueLabel"]),
                "source_id": r["id"],
            },
        ),
        Board(
            "workday",
            "total long, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>",
            lambda p: p["jobPostings"],
            lambda r: {"title": r["title"], "location": r["locationsText"], "source_url": r["externalPath"], "date_posted": r["postedOn"], "source_id": F.try_element_at(r["bulletFields"], F.lit(1))},
        ),
        Board(
            "oracle_hcm",
            "items array<struct<TotalJobsCount:long,requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,ShortDescriptionStr:string,WorkplaceType:string,secondaryLocations:array<struct<Name:string>>>>>>",
            lambda p: F.flatten(F.transform(p["items"], lambda i: F.coalesce(i["requisitionList"], F.array()))),
            lambda r: {
                "title": r["Title"],
                "location": _names(F.concat(F.array(r["PrimaryLocation"]), F.coalesce(F.transform(r["secondaryLocations"], lambda x: x["Name"]), F.array())), lambda x: x),
                "description": r["ShortDescriptionStr"],
                "source_url": r["Id"],
                "date_posted": iso_day(r["PostedDate"]),
                "remote_status": r["WorkplaceType"],
                "source_id": r["Id"],
            },
        ),
        Board(
            "listings_feed",
            "listings array<struct<id:string,company_name:string,title:string,locations:array<string>,url:string,date_posted:long,active:boolean,terms:array<string>,category:string,source:string>>",
            lambda p: p["listings"],
            lambda r: {
                "company": r["company_name"],
                "title": r["title"],
                "location": _names(r["locations"], lambda x: x),
                "source_url": r["url"],
                "date_posted": iso_day(r["date_posted"]),
                "internship_type": F.array_join(r["terms"], ", "),
                "source_id": r["id"],
            },
            lambda r: F.coalesce(r["active"], F.lit(False)),
        ),
    )
}


def parse_payloads(payloads: DataFrame, board: str) -> tuple[DataFrame, DataFrame]:
    """(postings, rejects) of payloads (company, payload): postings have FIELDS, source_id and source_adapter; rejects company, reason and record.

    A payload that is an array stands for its board's one array field. A payload that isn't JSON is one reject.
    """
    b = BOARDS[board]
    wrap = b.schema.split(" ", 1)[0]
    body = F.when(F.ltrim("payload").startswith("["), F.concat(F.lit(f'{{"{wrap}":'), F.col("payload"), F.lit("}"))).otherwise(F.col("payload"))
    read = payloads.select("company", F.from_json(body, b.schema).alias("p"))
    records = b.records(F.col("p"))
    broken = read.where(records.isNull()).select("company", F.lit("malformed").alias("reason"), F.lit(None).cast("string").alias("record"))
    each = read.select("company", F.explode(records).alias("r"))
    r = F.col("r")
    fields = b.fields(r)
    values = {f: F.trim(text(fields.get(f, F.lit("")))) for f in FIELDS}
    if "company" not in fields:
        values["company"] = F.trim(text("company"))
    out = each.where(r.isNull() | b.keep(r)).select(F.col("company").alias("_company"), "r", *(c.alias(f"f_{f}") for f, c in values.items()), F.trim(text(fields["source_id"])).alias("source_id"))
    reason = F.when(F.col("f_title") == "", "missing_title").when(F.col("f_source_url") == "", "missing_url")
    out = out.withColumn("reason", reason)
    good = out.where("reason is null").select(*(F.col(f"f_{f}").alias(f) for f in FIELDS), "source_id", F.lit(board).alias("source_adapter"))
    bad = out.where("reason is not null").select(F.col("_company").alias("company"), "reason", F.to_json("r").alias("record"))
    return good, bad.unionByName(broken)


def read_payloads(spark: SparkSession, path: str, company: str) -> DataFrame:
    """(company, payload) of payload files, a file a row."""
    return spark.read.option("wholetext", True).text(path).select(F.lit(company).alias("company"), F.col("value").alias("payload"))


def fill_from_details(postings: DataFrame, details: DataFrame, key: str = "source_url") -> DataFrame:
    """postings with blank fields filled from details (one row of each key is taken); filled lists which."""
    one = details.groupBy(F.col(key).alias("_k")).agg(*(F.max(text(f)).alias(f"d_{f}") for f in FIELDS if f != key and f in details.columns))
    out = postings.join(one, F.col(key) == F.col("_k"), "left").drop("_k")
    have = [f for f in FIELDS if f"d_{f}" in one.columns]
    fills = {f: (F.col(f) == "") & (F.coalesce(f"d_{f}", F.lit("")) != "") for f in have}
    out = out.withColumn("filled", F.array_compact(F.array(*(F.when(c, f) for f, c in fills.items()))))
    return out.withColumns({f: F.when(F.array_contains("filled", f), F.col(f"d_{f}")).otherwise(F.col(f)) for f in have}).drop(*(f"d_{f}" for f in have))
