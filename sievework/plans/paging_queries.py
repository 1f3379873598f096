"""Queries of recorded listing pages: a customer's orders as a board's pages, customers as details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import listing_pages
from .driver_queries import query, read

SIZE = 2


def _pages(spark, sf) -> DataFrame:
    """Two orders a page by key. A page's total counts the customer's orders up to its newest date: boards grow while they are read. A page with a dear order is lost."""
    by_key = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(Window.unboundedPreceding, 0)
    o = read(spark, sf, "orders").select("*", F.floor((F.row_number().over(by_key) - 1) / SIZE).cast("int").alias("page"), F.count("*").over(by_date).alias("known"))
    title = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.substring("o_orderpriority", 3, 20))
    posting = F.struct("o_orderkey", F.struct(title.alias("title"), F.concat(F.lit("/"), "o_orderstatus").alias("externalPath")).alias("p"))
    page = o.groupBy(F.col("o_custkey").alias("tenant"), "page").agg(F.transform(F.sort_array(F.collect_list(posting)), lambda x: x["p"]).alias("jobPostings"), F.max("known").alias("total"), F.max("o_totalprice").alias("dear"))
    lost = F.col("dear") > 480000
    return page.select("tenant", "page", F.when(~lost, F.to_json(F.struct("jobPostings", "total"))).alias("payload"), F.when(lost, "request_timeout").alias("error"))


#: The same pages walked one by one: each step holds the trusted total, the rows and postings so far, and the pages seen.
WALK_SQL = f"""o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // {SIZE} AS page, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS known,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE substr(o_orderpriority, 3) END AS title FROM orders),
p AS (SELECT o_custkey AS tenant, page, string_agg(title || '/' || o_orderstatus, ' ' ORDER BY o_orderkey) AS body, count(*) AS n, count(*) FILTER (title <> '') AS good, max(known) AS said, max(o_totalprice) > 480000 AS lost FROM o GROUP BY ALL),
w(tenant, page, total, seen, had, bodies, used, odd, done, reason, failed) AS (
  SELECT DISTINCT tenant, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false, false, false, CAST(NULL AS VARCHAR), false FROM p
  UNION ALL SELECT p.tenant, p.page, CASE WHEN bad THEN total ELSE now END, CASE WHEN bad THEN seen ELSE seen + n END, CASE WHEN bad THEN had ELSE had + good END, list_append(bodies, body), NOT bad,
    NOT bad AND (CASE WHEN total IS NULL THEN said < seen + n ELSE said <> total END),
    bad OR n < {SIZE} OR coalesce(seen + n >= now, false), CASE WHEN lost THEN 'request_timeout' WHEN bad THEN 'pagination_repeated_page' WHEN n < {SIZE} AND seen + n < now THEN 'pagination_ended_early' END, bad AND had = 0
  FROM (SELECT w.tenant, w.total, w.seen, w.had, w.bodies, p.* EXCLUDE (tenant), p.lost OR list_contains(w.bodies, p.body) AS bad, CASE WHEN p.said >= w.seen + p.n THEN greatest(coalesce(w.total, 0), p.said) ELSE w.total END AS now
    FROM w JOIN p ON p.tenant = w.tenant AND p.page = w.page + 1 WHERE NOT w.done) p)"""


@query(f"""WITH RECURSIVE {WALK_SQL}
SELECT tenant, count(*) FILTER (used) AS pages, CAST(max(seen) AS BIGINT) AS records, CAST(max(had) AS BIGINT) AS postings, max(total) AS total, count(*) FILTER (odd) AS anomalies,
CASE WHEN bool_or(done) THEN max(reason) ELSE 'pagination_recording_ended' END AS reason, CASE WHEN bool_or(failed) THEN 'failed' WHEN NOT bool_or(done) OR max(reason) IS NOT NULL THEN 'degraded' ELSE 'complete' END AS status FROM w GROUP BY tenant""")
def listing_coverage(spark, sf):
    return listing_pages.coverage(listing_pages.walked(_pages(spark, sf), SIZE))


@query(f"""WITH RECURSIVE {WALK_SQL}
SELECT tenant, CAST(o.page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY tenant, o.page ORDER BY o_orderkey) - 1 AS INTEGER) AS place, title, '/' || o_orderstatus AS path, CASE WHEN title = '' THEN 'missing_title' END AS reject
FROM w JOIN o ON o.o_custkey = w.tenant AND o.page = w.page WHERE used""")
def listing_records(spark, sf):
    pages = _pages(spark, sf)
    return listing_pages.records_of(pages, listing_pages.walked(pages, SIZE)).select("tenant", "page", "place", "title", "path", "reject")


#: Titles that are worth a look at their details.
LOOK = {"urgent": r"(?i)\burgent\b", "high": r"(?i)\bhigh\b"}


def _detailed(spark, sf) -> DataFrame:
    """Orders as listings of the boards of three states, a customer's under one path; customers as details: gone if in debt, their nation as requisition."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    listings = o.select(
        F.col("o_orderstatus").alias("tenant"), F.col("o_orderkey").alias("page"), F.lit(0).alias("place"), F.substring("o_orderpriority", 3, 20).alias("title"), F.concat(F.lit("/"), "o_custkey").alias("path"),
        F.when(F.month("o_orderdate") > 6, "2 Locations").otherwise("Here").alias("location"), F.when(F.month("o_orderdate") > 3, "Posted Today").otherwise("2020-01-01").alias("date_posted"),
        F.when(F.col("o_totalprice") < 250000, "7").otherwise("").alias("requisition_id"),
    )
    info = F.struct(F.col("c_nationkey").cast("string").alias("jobReqId"), F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>")).alias("jobDescription"), F.col("c_mktsegment").alias("location"), F.lit("2024-05-01").alias("startDate"))
    details = c.select(F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("tenant"), F.concat(F.lit("/"), "c_custkey").alias("path"), F.when(F.col("c_acctbal") < 0, 404).otherwise(200).alias("status"), F.to_json(F.struct(info.alias("jobPostingInfo"))).alias("payload"))
    return listing_pages.with_details(listings, details, LOOK)


DETAIL_SQL = """l AS (SELECT o_orderstatus AS tenant, o_orderkey AS page, substr(o_orderpriority, 3) AS title, o_custkey, month(o_orderdate) AS m, CASE WHEN o_totalprice < 250000 THEN '7' ELSE '' END AS req FROM orders),
g AS (SELECT tenant, o_custkey, arg_max(CASE title WHEN 'URGENT' THEN 'urgent' ELSE 'high' END, page) FILTER (title IN ('URGENT', 'HIGH')) AS detail_reason, arg_min(req, page) AS first_req FROM l GROUP BY ALL HAVING detail_reason IS NOT NULL),
d AS (SELECT g.*, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_custkey IS NULL THEN 'not_recorded' WHEN c_acctbal < 0 THEN 'posting_disappeared' WHEN first_req <> '' AND first_req <> CAST(c_nationkey AS VARCHAR) THEN 'requisition_id_conflict' END AS detail_error
  FROM g LEFT JOIN customer ON c_custkey = o_custkey)"""


@query(f"""WITH {DETAIL_SQL}
SELECT page AS id, detail_reason, detail_error, CASE WHEN detail_reason IS NULL THEN 'not_selected' WHEN detail_error = 'posting_disappeared' THEN 'disappeared' WHEN detail_error IS NOT NULL THEN 'failed' ELSE 'enriched' END AS detail_status,
coalesce(detail_error <> 'posting_disappeared', true) AS active, CASE WHEN ok THEN segment ELSE '' END AS description, CASE WHEN m <= 6 THEN 'Here' WHEN ok THEN segment ELSE '2 Locations' END AS location,
CASE WHEN m <= 3 THEN '2020-01-01' WHEN ok THEN '2024-05-01' ELSE 'Posted Today' END AS date_posted, CASE WHEN req = '' AND ok THEN nation ELSE req END AS requisition_id
FROM (SELECT l.*, detail_reason, detail_error, segment, nation, detail_reason IS NOT NULL AND detail_error IS NULL AS ok FROM l LEFT JOIN d USING (tenant, o_custkey))""")
def listing_details(spark, sf):
    return _detailed(spark, sf).select(F.col("page").alias("id"), "detail_reason", "detail_error", "detail_status", "active", "description", "location", "date_posted", "requisition_id")


@query(f"""WITH {DETAIL_SQL}
SELECT tenant, count(*) AS candidates, count(*) FILTER (detail_error IS NULL) AS successes, count(*) FILTER (detail_error <> 'posting_disappeared') AS failures, count(*) FILTER (detail_error = 'posting_disappeared') AS disappeared,
CASE WHEN count(*) FILTER (detail_error IS NULL) = 0 AND count(DISTINCT detail_error) = 1 THEN any_value(detail_error) END AS degraded_reason FROM d GROUP BY tenant""")
def listing_detail_coverage(spark, sf):
    return listing_pages.detail_coverage(_detailed(spark, sf))
