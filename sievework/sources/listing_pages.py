"""Recorded listing pages of boards that page by offset: which pages count, the total that can be trusted, rows, details.

A page is a row (tenant, page, payload, error). What a reader that walks a tenant's pages in order would do is told by
running windows over narrow rows (a count, a digest, a total a page), so a tenant of any number of pages is walked in
bounded memory; payloads are joined to the pages that count by (tenant, page) and never gathered by tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_text

# Reasons and names of anomalies, the limit of pages, and the signals of titles that are worth a detail.
MOST_PAGES = 500
SIGNALS = {
    "internship": r"(?iu)\bintern(?:ship)?s?\b",
    "co_op": r"(?iu)\bco[-‐‑‒–— ]?op\b",
    "season_year": r"(?iu)(?:\b(?:spring|summer|fall|autumn|winter)[\s-]+(?:20\d{2}|['’]\d{2})\b|\b20\d{2}[\s-]+(?:spring|summer|fall|autumn|winter)\b)",
    "student": r"(?iu)\bstudents?\b",
    "university": r"(?iu)\buniversity\b",
    "campus": r"(?iu)\bcampus\b",
    "early_career": r"(?iu)\bearly[- ]career\b",
    "apprenticeship": r"(?iu)\bapprentic(?:e|eship)\b",
}
GONE = (404, 410)


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _reject(record: Column) -> Column:
    """Why a record isn't a posting, or null."""
    title, path = _text(record, "$.title"), _text(record, "$.externalPath")
    return (
        F.when(~_is(record, "OBJECT"), "posting_not_object")
        .when((title == "") & (path == ""), "missing_title_and_external_path")
        .when(title == "", "missing_title")
        .when(path == "", "missing_external_path")
    )


def _read(pages: DataFrame) -> DataFrame:
    """tenant, page, records, reported and broken (why a page can't be used, or null). A total that isn't a whole number breaks its page."""
    body, total = F.try_parse_json("payload"), F.col("_total")
    out = pages.select("tenant", "page", "error", body.alias("_body")).select("*", F.try_variant_get("_body", "$.jobPostings", "array<variant>").alias("records"), F.try_variant_get("_body", "$.total", "variant").alias("_total"))
    bad_total = total.isNotNull() & ~_is(total, "BIGINT") & ~_is(total, "VOID")
    broken = F.coalesce("error", F.when(F.col("records").isNull() | bad_total, F.lit("schema_error")))
    return out.select("tenant", "page", "records", F.try_variant_get("_body", "$.total", "long").alias("reported"), broken.alias("broken"))


def walked(pages: DataFrame, page_size: int, most_pages: int = MOST_PAGES) -> DataFrame:
    """Of pages (tenant, page, payload, error; a page once): tenant, page, n_records, n_postings, total, anomaly, used, stop, reason, failed.

    used: a reader that walks on while pages are full and the total isn't reached gets here and can use the page.
    stop: it ends here; reason: why what it has is incomplete, null if it isn't. failed: it ends before it has any posting.
    total: the largest reported total so far that isn't below the rows seen by its page; anomaly: what is odd about
    this page's. A page is a repeat if its records equal an earlier page's, keys in any order. Rows behind the end
    are returned too, not used. A null tenant is a tenant; a null payload without an error is a schema_error;
    an empty table gives none; other columns are not read.
    """
    records = F.col("records")
    ok = F.col("broken").isNull()
    narrow = _read(pages).select(
        "tenant", "page", "broken", F.when(ok, F.col("reported")).alias("reported"),
        F.when(ok, F.size(records)).otherwise(0).alias("n_records"),
        F.when(ok, F.size(F.filter(records, lambda r: _reject(r).isNull()))).otherwise(0).alias("n_postings"),
        F.when(ok & (F.size(records) > 0), F.sha2(F.to_json(records), 256)).alias("digest"),
    )
    order = Window.partitionBy("tenant").orderBy("page")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    seen, r, last = F.col("seen"), F.col("reported"), F.col("_last")
    w = narrow.withColumn("seen", F.sum("n_records").over(so_far)).withColumn("nth", F.row_number().over(order)).withColumn("had", F.coalesce(F.sum("n_postings").over(before), F.lit(0)))
    trusted = F.when((r >= 0) & (r >= seen), r)
    w = w.withColumn("total", F.max(trusted).over(so_far)).withColumn("_last", F.max(trusted).over(before))
    anomaly = (
        F.when(~F.col("broken").isNull(), None)
        .when(r.isNull(), F.when(last.isNotNull(), "total_missing"))
        .when(r < 0, "total_negative")
        .when(r == last, None)
        .when((r == 0) & last.isNotNull(), "total_zero")
        .when(r < seen, "total_below_offset")
        .when(r > last, "total_increased")
        .when(r < last, "total_decreased")
    )
    again = F.col("digest").isNotNull() & (F.row_number().over(Window.partitionBy("tenant", "digest").orderBy("page")) > 1)
    w = w.withColumn("anomaly", anomaly).withColumn("_again", again)
    short, reached = F.col("n_records") < page_size, F.coalesce(seen >= F.col("total"), F.lit(False))
    unusable = F.col("broken").isNotNull() | F.col("_again")
    reason = F.coalesce("broken", F.when(F.col("_again"), "pagination_repeated_page"))
    late = F.when(short, F.when(seen < F.col("total"), "pagination_ended_early")).when(reached, None).when(F.col("nth") >= most_pages, "pagination_safety_limit_reached")
    w = w.withColumn("stop", unusable | short | reached | (F.col("nth") >= most_pages)).withColumn("reason", F.coalesce(reason, late))
    reachable = ~F.coalesce(F.max("stop").over(before), F.lit(False))
    w = w.withColumn("_reached", reachable)
    return w.select(
        "tenant", "page", "n_records", "n_postings", "total", F.when(F.col("_reached") & ~unusable, F.col("anomaly")).alias("anomaly"), (F.col("_reached") & ~unusable).alias("used"),
        (F.col("_reached") & F.col("stop")).alias("stop"), F.when(F.col("_reached"), F.col("reason")).alias("reason"), (F.col("_reached") & unusable & (F.col("had") == 0)).alias("failed"),
    )


def coverage(walk: DataFrame) -> DataFrame:
    """A row a tenant: pages, records, postings, total, anomalies, reason and status (complete, degraded or failed). Pages that end without an end are incomplete too."""
    used = F.col("used")
    out = walk.groupBy("tenant").agg(
        F.count_if(used).alias("pages"), F.coalesce(F.sum(F.when(used, F.col("n_records"))), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(used, F.col("n_postings"))), F.lit(0)).alias("postings"),
        F.max(F.when(used, F.col("total"))).alias("total"), F.count("anomaly").alias("anomalies"), F.max("reason").alias("_reason"), F.max("stop").alias("_ends"), F.max("failed").alias("_failed"),
    )
    reason = F.when(~F.col("_ends"), "pagination_recording_ended").otherwise(F.col("_reason"))
    status = F.when(F.col("_failed"), "failed").when(reason.isNotNull(), "degraded").otherwise("complete")
    return out.select("tenant", "pages", "records", "postings", "total", "anomalies", reason.alias("reason"), status.alias("status"))


def records_of(pages: DataFrame, walk: DataFrame) -> DataFrame:
    """tenant, page, place (from 0), reject, title, path, location, date_posted, requisition_id, record (JSON) of each record of the pages that count."""
    keys = walk.where("used").select(F.col("tenant").alias("_tenant"), F.col("page").alias("_page"))
    kept = _read(pages).join(keys, F.col("tenant").eqNullSafe(F.col("_tenant")) & (F.col("page") == F.col("_page")), "left_semi")
    each = kept.select("tenant", "page", F.posexplode("records").alias("place", "r"))
    r = F.col("r")
    return each.select(
        "tenant", "page", "place", _reject(r).alias("reject"), _text(r, "$.title").alias("title"), _text(r, "$.externalPath").alias("path"), _text(r, "$.locationsText").alias("location"),
        _text(r, "$.postedOn").alias("date_posted"), _text(r, "$.bulletFields[0]").alias("requisition_id"), F.to_json(r).alias("record"),
    )


def with_details(listings: DataFrame, details: DataFrame, signals: dict[str, str] = SIGNALS, most: int | None = None) -> DataFrame:
    """listings (tenant, page, place, title, path, location, date_posted, requisition_id, ...) with description, detail_reason, detail_status, detail_error and active.

    A path is looked up once for all its listings, if a title among them has a signal (the last such listing's first
    signal is the reason). details: tenant, path, status, payload; of several for a path that of smallest status
    counts. A path that is gone leaves its listings, not active; a requisition that differs from the first listing's
    is a conflict and fills nothing; blank fields are filled, and a location that only counts places. most: a tenant
    with more paths to look up is refused whole. Listings without a path or signal stay as they are.
    """
    reason = F.coalesce(*(F.when(F.col("title").rlike(p), k) for k, p in signals.items()))
    at = F.struct("page", "place")
    paths = listings.where("path != ''").groupBy("tenant", "path").agg(F.max_by(reason, F.when(reason.isNotNull(), at)).alias("detail_reason"), F.min_by("requisition_id", at).alias("_listed")).where("detail_reason is not null")
    if most is not None:
        paths = paths.withColumn("_refused", F.count("*").over(Window.partitionBy("tenant")) > most)
    else:
        paths = paths.withColumn("_refused", F.lit(False))
    one = details.groupBy(F.col("tenant").alias("_t"), F.col("path").alias("_p")).agg(F.min(F.struct(F.coalesce("status", F.lit(599)).alias("status"), "payload")).alias("_d"))
    d = paths.join(one, F.col("tenant").eqNullSafe(F.col("_t")) & (F.col("path") == F.col("_p")), "left").withColumn("_info", F.try_variant_get(F.try_parse_json("_d.payload"), "$.jobPostingInfo", "variant"))
    info, found = F.col("_info"), _text(F.col("_info"), "$.jobReqId")
    error = (
        F.when(F.col("_refused"), "candidate_limit")
        .when(F.col("_d").isNull(), "not_recorded")
        .when(F.col("_d.status").isin(*GONE), "posting_disappeared")
        .when(F.col("_d.status") >= 400, "request_failed")
        .when(~_is(info, "OBJECT"), "schema_error")
        .when((found != "") & (F.col("_listed") != "") & (found != F.col("_listed")), "requisition_id_conflict")
    )
    d = d.withColumn("detail_error", error)
    good = lambda p: F.when(F.col("detail_error").isNull(), p).otherwise("")
    d = d.select(
        F.col("tenant").alias("_t"), F.col("path").alias("_p"), "detail_reason", "detail_error", good(found).alias("_req"), good(html_text(_text(info, "$.jobDescription"))).alias("description"),
        good(_text(info, "$.location")).alias("_location"), good(_text(info, "$.startDate")).alias("_date"),
    )
    out = listings.join(d, F.col("tenant").eqNullSafe(F.col("_t")) & (F.col("path") == F.col("_p")), "left").drop("_t", "_p")
    place = (F.coalesce("_location", F.lit("")) != "") & ((F.col("location") == "") | F.col("location").rlike(r"(?i)^\s*\d+\s+locations?\s*$"))
    day = (F.coalesce("_date", F.lit("")) != "") & ((F.col("date_posted") == "") | F.col("date_posted").rlike(r"(?i)^posted\b"))
    req = (F.coalesce("_req", F.lit("")) != "") & (F.col("requisition_id") == "")
    filled = place | day | (F.coalesce("description", F.lit("")) != "")
    status = (
        F.when(F.col("detail_reason").isNull(), "not_selected")
        .when(F.col("detail_error") == "posting_disappeared", "disappeared")
        .when(F.col("detail_error").isNotNull(), "failed")
        .when(filled, "enriched")
        .otherwise("success")
    )
    return out.withColumns({
        "detail_status": status, "active": F.coalesce(F.col("detail_error") != "posting_disappeared", F.lit(True)), "description": F.coalesce("description", F.lit("")),
        "location": F.when(place, F.col("_location")).otherwise(F.col("location")), "date_posted": F.when(day, F.col("_date")).otherwise(F.col("date_posted")),
        "requisition_id": F.when(req, F.col("_req")).otherwise(F.col("requisition_id")),
    }).drop("_req", "_location", "_date")


def detail_coverage(detailed: DataFrame) -> DataFrame:
    """A row a tenant: candidates, successes, failures, disappeared, and degraded_reason where no path succeeded and all failed for one reason."""
    paths = detailed.where("detail_reason is not null").groupBy("tenant", "path").agg(F.max("detail_error").alias("error"))
    gone = F.col("error") == "posting_disappeared"
    out = paths.groupBy("tenant").agg(F.count("*").alias("candidates"), F.count_if(F.col("error").isNull()).alias("successes"), F.count_if(~gone).alias("failures"), F.count_if(gone).alias("disappeared"), F.min("error").alias("_a"), F.max("error").alias("_b"))
    return out.select("tenant", "candidates", "successes", "failures", "disappeared", F.when((F.col("successes") == 0) & (F.col("_a") == F.col("_b")), F.col("_a")).alias("degraded_reason"))
