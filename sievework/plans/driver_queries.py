"""Queries on the driver's tables, each with its SQL: every generic operator at work on a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, pay, scores, text, urls
from ..operators import aggregates, dedupe, health, joins, ranking, timelines

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- filters, projections, sorts ------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice >= 150000 AND contains(lower(o_orderpriority), 'urgent')""")
def filter_conjunctive(spark, sf):
    o = read(spark, sf, "orders")
    return o.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 150000) & F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("""SELECT p_partkey AS id, trim(lower(coalesce(p_name, ''))) AS title, coalesce(p_brand, '') AS company, coalesce(p_type, '') AS description, '' AS location FROM part""")
def project_canonical(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.trim(text.lower_ascii("p_name")).alias("title"), text.text("p_brand").alias("company"), text.text("p_type").alias("description"), F.lit("").alias("location"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def topk_stable(spark, sf):
    return ranking.top_k(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


# -- aggregates -----------------------------------------------------------------------------------


@query("""WITH b AS (SELECT o_totalprice, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'maybe' ELSE 'low' END AS bucket, o_orderstatus FROM orders)
SELECT count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 1) AS avg_total, count(*) FILTER (bucket = 'high') AS high, count(*) FILTER (bucket = 'maybe') AS maybe,
count(*) FILTER (bucket = 'low') AS low, count(*) FILTER (o_orderstatus = 'F') AS n_paid, CAST(round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS INTEGER) AS paid_pct FROM b""")
def summary_counts(spark, sf):
    o = read(spark, sf, "orders").withColumn("cents", F.col("o_totalprice").cast("decimal(18,2)"))
    o = o.withColumn("bucket", F.when(F.col("o_totalprice") >= 300000, "high").when(F.col("o_totalprice") >= 100000, "maybe").otherwise("low"))
    out = aggregates.summary(o, "cents", "bucket", F.col("o_orderstatus") == "F")
    return out.withColumn("avg_total", F.col("avg_total").cast("double"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""")
def histogram_by_key(spark, sf):
    return aggregates.histogram(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT user_id FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type = 'error' AND value > 98 THEN 1 ELSE 0 END) = 0""")
def having_group(spark, sf):
    bad = F.sum(F.when((F.col("event_type") == "error") & (F.col("value") > 98), 1).otherwise(0))
    return read(spark, sf, "events").groupBy("user_id").agg(bad.alias("bad")).where("bad = 0").select("user_id")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, event_type, n, CAST(total AS BIGINT) AS total, total >= 5 AND n >= 0.6 * total AS dominates FROM r WHERE k = 1""")
def mode_dominance(spark, sf):
    return ranking.dominant(read(spark, sf, "events"), ["user_id"], "event_type")


@query("""WITH s AS (SELECT event_type = 'error' AS bad, value, user_id, ts FROM events)
SELECT count(*) AS attempts, count(DISTINCT user_id) AS sources, count(*) FILTER (bad) AS failures, count(*) FILTER (NOT bad AND value = 0) AS zero_successes, count(*) FILTER (value > 90) AS large, min(ts) AS first_at, max(ts) AS last_at FROM s""")
def health_summary(spark, sf):
    e = read(spark, sf, "events").withColumn("bad", F.col("event_type") == "error")
    return e.agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("user_id").alias("sources"), F.count_if("bad").alias("failures"), F.count_if(~F.col("bad") & (F.col("value") == 0)).alias("zero_successes"), F.count_if(F.col("value") > 90).alias("large"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


_LABELLED = "SELECT l.doc_id, l.quality = 1 AS actual, d.n_chars >= 600 AS predicted, d.n_chars FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark, sf):
    return read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("actual"), (F.col("n_chars") >= 600).alias("predicted"), "n_chars")


@query(f"""WITH x AS ({_LABELLED}), c AS (SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM x)
SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity, CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS accuracy, CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""")
def confusion_matrix(spark, sf):
    return aggregates.confusion(_labelled(spark, sf), F.col("predicted"), F.col("actual"))


@query(f"""WITH x AS ({_LABELLED}), e AS (SELECT unnest([0, 200, 600, 2000, 8000, 1000000]) AS band), b AS (SELECT *, CASE WHEN n_chars >= 1000000 THEN 1000000 WHEN n_chars >= 8000 THEN 8000 WHEN n_chars >= 2000 THEN 2000 WHEN n_chars >= 600 THEN 600 WHEN n_chars >= 200 THEN 200 ELSE 0 END AS of FROM x)
SELECT e.band, count(b.doc_id) AS n, count(b.doc_id) FILTER (predicted AND NOT actual) AS false_positives, count(b.doc_id) FILTER (NOT predicted AND actual) AS false_negatives FROM e LEFT JOIN b ON e.band = b.of GROUP BY e.band""")
def score_bands(spark, sf):
    p, a = F.col("predicted"), F.col("actual")
    return aggregates.bands(_labelled(spark, sf), F.col("n_chars"), [0, 200, 600, 2000, 8000, 1000000], false_positives=p & ~a, false_negatives=~p & a)


@query(f"""WITH x AS ({_LABELLED} ORDER BY n_chars DESC, doc_id LIMIT 20) SELECT count(*) FILTER (actual) AS hits, CAST(count(*) FILTER (actual) AS DOUBLE) / count(*) AS precision FROM x""")
def precision_at_k(spark, sf):
    return aggregates.precision_at(_labelled(spark, sf), [F.desc("n_chars"), F.asc("doc_id")], F.col("actual"), 20)


@query("""SELECT concat_ws('+', CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN d.n_chars >= 2000 THEN 'long' END) AS groups, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def cohort_overlap(spark, sf):
    x = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return aggregates.combinations(x, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") >= 2000})


# -- ranking and sampling -------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def first_per_group(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.first_n_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("""SELECT l_partkey, l_orderkey, l_linenumber, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS k FROM lineitem) WHERE k <= 3""")
def topn_per_group(spark, sf):
    x = read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.first_n_per_group(x, ["l_partkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3, "k").drop("l_extendedprice")


@query("""SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 25""")
def per_reason_sample(spark, sf):
    return ranking.sample_per_group(read(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 25)


@query("""SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS turn FROM events""")
def round_robin(spark, sf):
    return ranking.round_robin(read(spark, sf, "events").select("event_id", "event_type", "ts"), ["event_type"], [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7' || chr(31) || CAST(c_custkey AS VARCHAR)), c_custkey) AS k FROM customer) ORDER BY k, c_mktsegment LIMIT 50""")
def stratified_sample(spark, sf):
    return ranking.stratified_sample(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 50, seed=7)


@query("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark, sf):
    return ranking.latest_per_key(read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query("""SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) ORDER BY ts DESC, event_id LIMIT 100""")
def retention_prune(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts")
    last = e.agg(F.max("ts").alias("last"))
    kept = e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).drop("last")
    return timelines.retain(kept, "ts", [F.desc("ts"), F.asc("event_id")], 100)


# -- joins ----------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, n_name, count(s_suppkey) AS n_suppliers, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def join_lookup_array(spark, sf):
    out = joins.lookup_array_join(read(spark, sf, "nation"), read(spark, sf, "supplier"), "n_nationkey", "s_nationkey", ["s_suppkey", "s_name"], "found")
    return out.select("n_nationkey", "n_name", F.size("found").cast("long").alias("n_suppliers"), F.array_join("found.s_name", ",").alias("suppliers"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_semi(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def join_anti(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey OR s_acctbal = c_acctbal)""")
def any_key_anti(spark, sf):
    return joins.any_key_anti_join(read(spark, sf, "customer"), read(spark, sf, "supplier"), [("c_custkey", "s_suppkey"), ("c_acctbal", "s_acctbal")]).select("c_custkey")


@query("""WITH k AS (SELECT substr(n_name, 1, 1) AS letter, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) = 1)
SELECT c_custkey, n_nationkey FROM customer LEFT JOIN k ON letter = substr(c_mktsegment, 1, 1)""")
def unique_match_join(spark, sf):
    left = read(spark, sf, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).alias("initial"))
    right = read(spark, sf, "nation").select("n_nationkey", F.substring("n_name", 1, 1).alias("letter"))
    return joins.unique_match_join(left, right, "initial", "letter", "n_nationkey").drop("initial")


@query("""SELECT n_name, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
def join_chain4(spark, sf):
    x = read(spark, sf, "lineitem").join(read(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("""WITH t AS (SELECT c_custkey AS id, lower(c_name) AS a, CAST(c_nationkey AS VARCHAR) AS b FROM customer), r AS (SELECT s_suppkey AS other, replace(lower(s_name), 'supplier', 'customer') AS a, CAST(s_nationkey AS VARCHAR) AS b FROM supplier),
m AS (SELECT id, other, 0 AS tier FROM t JOIN r ON t.a = r.a UNION ALL SELECT id, other, 1 FROM t JOIN r ON t.b = r.b)
SELECT id, other, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, other) AS k FROM m) WHERE k = 1""")
def tiered_join(spark, sf):
    left = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("a"), F.col("c_nationkey").cast("string").alias("b"))
    right = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("other"), F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("ra"), F.col("s_nationkey").cast("string").alias("rb"))
    return joins.tiered_join(left, right, [("a", "ra"), ("b", "rb")], "id", "other")


@query("""WITH old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, c_acctbal AS seen FROM customer WHERE c_custkey % 4 <> 0),
new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_name) END AS name, c_acctbal - (c_custkey % 2) AS seen FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.name, ''), o.name) AS name, greatest(o.seen, n.seen) AS seen,
CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN coalesce(nullif(n.name, ''), o.name) IS DISTINCT FROM o.name OR greatest(o.seen, n.seen) IS DISTINCT FROM o.seen THEN 'updated' ELSE 'unchanged' END AS outcome FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_coalesce(spark, sf):
    c = read(spark, sf, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 4 != 0).select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_acctbal").alias("seen"))
    new = c.where(k % 7 != 0).select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.upper("c_name")).alias("name"), (F.col("c_acctbal") - k % 2).alias("seen"))
    return joins.upsert(old, new, "id", fill=["name"], latest=["seen"])


@query("""WITH old AS (SELECT o_custkey AS id, bool_or(o_orderstatus <> 'F') AS was FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), new AS (SELECT o_custkey AS id, bool_or(o_totalprice > 150000) AS wanted FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT coalesce(old.id, new.id) AS id, CASE WHEN was IS NULL AND coalesce(wanted, FALSE) THEN 'create' WHEN was IS NULL THEN 'none' WHEN NOT was AND coalesce(wanted, FALSE) THEN 'reactivate' WHEN was AND coalesce(wanted, FALSE) THEN 'refresh' WHEN was THEN 'deactivate' ELSE 'none' END AS action FROM old FULL JOIN new ON old.id = new.id""")
def reconcile_full_outer(spark, sf):
    o = read(spark, sf, "orders").withColumn("id", F.col("o_custkey"))
    old = o.where(F.year("o_orderdate") == 1995).groupBy("id").agg(F.bool_or(F.col("o_orderstatus") != "F").alias("was"))
    new = o.where(F.year("o_orderdate") == 1996).groupBy("id").agg(F.bool_or(F.col("o_totalprice") > 150000).alias("wanted"))
    return joins.reconcile(old, new, ["id"], "was", "wanted")


# -- timelines ------------------------------------------------------------------------------------


def _events(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")


@query("""WITH e AS (SELECT event_id, user_id, event_type = 'error' AS state, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, state, previous, state IS DISTINCT FROM previous AS changed, coalesce(previous AND NOT state, FALSE) AS recovered FROM e""")
def lag_transition(spark, sf):
    out = timelines.transitions(_events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("event_id", "state", "previous", "changed", "recovered")


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(event_type IN ('error', 'click') AS INTEGER) AS hit FROM events), i AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e)
SELECT event_id, CAST(sum(hit) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""")
def running_streak(spark, sf):
    return timelines.streaks(_events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "click")).select("event_id", "streak")


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_seconds FROM events) SELECT * FROM e WHERE gap_seconds >= 86400""")
def gap_absence(spark, sf):
    return timelines.gaps(_events(spark, sf), "user_id", "ts", ["ts", "event_id"], 86400).select("event_id", "user_id", "gap_seconds")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, k, event_id, t AS last, TRUE AS passes FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.t - r.last >= 86400 THEN e.t ELSE r.last END, e.t - r.last >= 86400 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE passes""")
def cooldown_emit(spark, sf):
    return timelines.cooldown(_events(spark, sf).where("event_type = 'error'"), "user_id", "ts", "event_id", 86400)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events),
r AS (SELECT user_id, k, t AS open FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t - r.open >= 10800 THEN e.t ELSE r.open END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, open AS batch_start, count(*) AS n_events FROM r GROUP BY ALL""")
def anchored_batch_3h(spark, sf):
    return timelines.anchored_batches(_events(spark, sf), "user_id", "ts", "event_id", 10800)


@query("""WITH e AS (SELECT *, CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, count(*) AS n_events FROM s GROUP BY user_id, session""")
def session_30m(spark, sf):
    return timelines.sessions(_events(spark, sf), "user_id", "ts", ["ts", "event_id"], 1800)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1, 2""")
def daily_digest(spark, sf):
    return timelines.daily_digest(_events(spark, sf), "user_id", "ts", "event_type")


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_recent FROM e""")
def rolling_24h(spark, sf):
    return timelines.trailing_count(_events(spark, sf), "user_id", "ts", 86400).select("event_id", "n_recent")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events), w AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER k AS wins, count(*) OVER k AS total FROM e WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY user_id, wins ORDER BY ts, event_id) AS losses FROM w), s AS (SELECT *, CASE WHEN ok THEN 'healthy' WHEN losses >= 3 THEN 'failing' ELSE 'degraded' END AS status FROM f),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM s)
SELECT event_id, total AS total_attempts, CAST(wins AS BIGINT) AS total_successes, CAST(losses AS BIGINT) AS consecutive_failures, status, previous_status, coalesce(previous_status IN ('degraded', 'failing') AND status = 'healthy', FALSE) AS recovery FROM p""")
def health_fold(spark, sf):
    e = read(spark, sf, "events")
    null, no = F.lit(None), F.lit(False)
    attempts = e.select(
        F.col("user_id").cast("string").alias("health_key"), F.lit("feed").alias("source_kind"), F.lit("").alias("company"), F.lit(True).alias("attempted"), (F.col("event_type") != "error").alias("succeeded"),
        F.lit(1).cast("long").alias("rows_returned"), F.lit("error").alias("error_kind"), F.col("ts").alias("observed_at"), *(null.cast("long").alias(c) for c in ("malformed_row_count", "schema_error_row_count", "duplicate_row_count", "failed_request_count")),
        *(no.alias(c) for c in ("incomplete", "truncated", "degraded")), F.lit(True).alias("complete"), F.col("event_id").alias("seq"),
    )
    out = health.health_states(attempts)
    return out.select(F.col("seq").alias("event_id"), "total_attempts", "total_successes", "consecutive_failures", "status", "previous_status", F.coalesce("recovery", F.lit(False)).alias("recovery"))


@query(r"""WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS company, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS title FROM part)
SELECT min(p_partkey) AS pos, count(*) - 1 AS merged FROM k GROUP BY company, title""")
def posting_dedupe(spark, sf):
    p = read(spark, sf, "part")
    given = {"company": F.col("p_brand"), "title": F.col("p_type")}
    rows = p.select(F.col("p_partkey").alias("pos"), *(given.get(f, F.lit("")).alias(f) for f in dedupe.FIELDS))
    kept, report = dedupe.deduplicated(rows)
    n = report.groupBy(F.col("duplicate_of").alias("_pos")).agg(F.count(F.lit(1)).alias("merged"))
    return kept.select("pos").join(n, F.col("pos") == F.col("_pos"), "left").select("pos", F.coalesce("merged", F.lit(0)).cast("long").alias("merged"))


# -- text, URLs, dates, scores ---------------------------------------------------------------------

_SQUASH = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""SELECT doc_id, sha256({_SQUASH.format("text")}) AS key FROM documents""")
def text_squash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.squash("text"), 256).alias("key"))


@query(f"""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256({_SQUASH.format("text")}) ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def exact_dup_docs(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2(text.squash("text"), 256).alias("key"))
    first = F.min_by(F.struct("source", "lang"), "doc_id")
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), first.alias("x")).select("doc_id", "x.source", "x.lang")


@query(f"""WITH d AS (SELECT doc_id, ' ' || {_SQUASH.format("text")} || ' ' AS s FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN contains(s, ' and ') THEN 'and' END, CASE WHEN contains(s, ' de la ') THEN 'de la' END, CASE WHEN contains(s, ' der ') THEN 'der' END, CASE WHEN contains(s, ' license ') THEN 'license' END) AS hits FROM d""")
def tool_hits(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", text.squash("text").alias("s"))
    hits = F.array_compact(F.array(*(F.when(text.has_phrase("s", F.lit(p)), p) for p in ("and", "de la", "der", "license"))))
    return d.select("doc_id", F.array_join(hits, ",").alias("hits"))


@query("""WITH h AS (SELECT doc_id, n_chars, CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'worthless') AS INTEGER) + CAST(contains(lower(text), 'mail') AS INTEGER) AS hits FROM documents) SELECT doc_id, hits FROM h WHERE hits > 0 ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 10""")
def keyword_rank(spark, sf):
    hits = sum((F.contains(F.lower("text"), F.lit(k)).cast("int") for k in ("license", "worthless", "mail")), F.lit(0))
    d = read(spark, sf, "documents").select("doc_id", "n_chars", hits.alias("hits")).where("hits > 0")
    return ranking.top_k(d, [F.desc("hits"), F.desc("n_chars"), F.asc("doc_id")], 10).select("doc_id", "hits")


_URL = """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 1)) AS scheme, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 2)) AS host,
regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 3), '/+$', '') AS path, substr(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 4), 2) AS query FROM u),
c AS (SELECT page_id, host, path, scheme || '://' || host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (SELECT *, array_to_string(list_sort(list_distinct(list_filter(string_split(query, '&'), lambda x: contains(x, '=') AND NOT x LIKE '%=' AND NOT (lower(x) LIKE 'utm\\_%' ESCAPE '\\') AND NOT list_contains(['gh_src','lever-source','ref','referrer','source','src','tracking','trk'], lower(split_part(x, '=', 1)))))), '&') AS q FROM p))"""


@query(f"""{_URL} SELECT page_id, url FROM c""")
def url_canonical(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.canonical_url("url").alias("url"))


@query(f"""{_URL} SELECT min(page_id) AS page_id, url, count(*) AS n FROM c GROUP BY url""")
def url_dedupe(spark, sf):
    p = read(spark, sf, "pages").select("page_id", urls.canonical_url("url").alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query(f"""{_URL} SELECT host FROM c GROUP BY host HAVING count(DISTINCT path) > 1""")
def generic_url(spark, sf):
    p = read(spark, sf, "pages").withColumn("url", urls.canonical_url("url"))
    parts = urls.parts("url")
    return aggregates.shared_keys(p.select(parts["host"].alias("host"), parts["path"].alias("path")), "host", "path")


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS s FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(s, '(?i)<br[^>]*>|</(p|div|li|ul|ol|tr|table|h[1-6])>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS s FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS s FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(s, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM c""")
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.html_text("html").alias("text"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def date_parse_multi(spark, sf):
    shapes = ["yyyy-MM-dd", "M/d/yyyy", "MM-dd-yyyy", "MMMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % len(shapes)
    shown = F.coalesce(*(F.when(k == i, F.date_format(d, s)) for i, s in enumerate(shapes)))
    return read(spark, sf, "orders").select("o_orderkey", shown.alias("shown")).select("o_orderkey", dates.parse_date("shown").alias("day"))


@query("""WITH d AS (SELECT o_orderkey, date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS days FROM orders) SELECT o_orderkey, CAST(days AS INTEGER) AS days, CASE WHEN days < 0 THEN 0 WHEN days <= 2 THEN 55 WHEN days <= 14 THEN 85 WHEN days <= 45 THEN 100 ELSE 75 END AS score FROM d""")
def deadline_bands(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", dates.days_left(F.to_date("o_orderdate"), F.lit("1995-06-17").cast("date")).alias("days"))
    return o.withColumn("score", dates.urgency("days"))


@query("""SELECT p_partkey, CASE WHEN r >= 40 THEN 100 WHEN r >= 35 THEN 95 WHEN r >= 30 THEN 90 WHEN r >= 25 THEN 80 WHEN r >= 20 THEN 70 WHEN r >= 15 THEN 55 WHEN r >= 10 THEN 40 WHEN r >= 5 THEN 25 WHEN r >= 0.01 THEN 10 ELSE 0 END AS score FROM (SELECT p_partkey, p_retailprice / 40 AS r FROM part)""")
def hourly_bands(spark, sf):
    return read(spark, sf, "part").select("p_partkey", pay.banded(F.col("p_retailprice") / 40).alias("score"))


@query("""SELECT p_partkey, 'paid' AS kind, 'USD' AS currency, CASE p_size % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'monthly' ELSE 'annual' END AS period, CAST(p_size AS DOUBLE) * 1000 AS amount_min, CAST(p_size AS DOUBLE) * 2000 AS amount_max FROM part""")
def pay_parse(spark, sf):
    unit = F.when(F.col("p_size") % 3 == 0, "/hr").when(F.col("p_size") % 3 == 1, " per month").otherwise(" annually, 401(k) match")
    p = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("$"), F.col("p_size"), F.lit(",000 - $"), F.col("p_size") * 2, F.lit("k"), unit).alias("shown"))
    return pay.with_pay(p, "shown").select("p_partkey", "pay.kind", "pay.currency", "pay.period", "pay.amount_min", "pay.amount_max")


_PARTS = """WITH s AS (SELECT o_orderkey, o_orderkey % 101 AS a, (o_orderkey * 7) % 101 AS b, (o_orderkey * 13) % 101 AS c, o_orderkey % 4 AS major, o_orderkey % 9 = 0 AS bad, CAST(o_orderkey % 40 AS INTEGER) - 5 AS days FROM orders),
t AS (SELECT *, CAST(round_even(a * 0.40::DOUBLE + b * 0.14::DOUBLE + c * 0.08::DOUBLE + a * 0.14::DOUBLE + b * 0.14::DOUBLE + c * 0.04::DOUBLE + a * 0.03::DOUBLE + b * 0.03::DOUBLE, 0) AS INTEGER) AS raw FROM s),
u AS (SELECT *, CASE WHEN major >= 3 THEN least(CASE WHEN bad THEN least(raw, 44) ELSE raw END, 44) ELSE CASE WHEN bad THEN least(raw, 44) ELSE raw END END AS total FROM t)"""


@query(f"""{_PARTS} SELECT o_orderkey, total, CASE WHEN bad OR major >= 3 THEN 'low' WHEN total >= 70 THEN 'high' WHEN total >= 45 THEN 'maybe' ELSE 'low' END AS bucket,
CASE WHEN bad OR major >= 3 OR days < 0 THEN 'skip' WHEN total >= 70 AND major = 0 THEN 'apply_now' WHEN total >= 70 THEN 'research_more' WHEN total >= 60 AND days BETWEEN 0 AND 7 AND major = 0 THEN 'apply_now' WHEN total >= 55 THEN 'apply_later' WHEN total >= 45 THEN 'research_more' ELSE 'skip' END AS action FROM u""")
def weighted_score(spark, sf):
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select("o_orderkey", (k % 101).alias("a"), (k * 7 % 101).alias("b"), (k * 13 % 101).alias("c"), (k % 4).alias("major"), (k % 9 == 0).alias("bad"), ((k % 40).cast("int") - 5).alias("days"))
    a, b, c = (F.col(x).cast("double") for x in "abc")
    o = o.withColumn("raw", scores.weighted_total(dict(zip(scores.WEIGHTS, (a, b, c, a, b, c, a, b), strict=True))))
    none = F.lit(0)
    o = o.withColumn("total", scores.capped(F.col("raw"), F.col("bad"), none, F.col("major")))
    bad, major = F.col("bad"), F.col("major")
    return o.select("o_orderkey", "total", scores.bucket(F.col("total"), bad | (major >= 3)).alias("bucket"), scores.action(F.col("total"), F.col("days"), F.lit(0.9), bad, none, major).alias("action"))


# -- arrays, maps, JSON, reports -------------------------------------------------------------------


@query("""SELECT conv_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, array_to_string(list(role ORDER BY turn)[1:3], ',') AS first_roles FROM conversations GROUP BY conv_id""")
def array_ops(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    x = read(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    roles = F.col("t.role")
    return x.select("conv_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(roles)), ",").alias("roles"), F.array_join(F.slice(roles, 1, 3), ",").alias("first_roles"))


@query("""SELECT user_id, CAST(arg_min(json_extract_string(props, '$.k'), (ts, event_id)) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS BIGINT) AS first_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY user_id""")
def map_merge(spark, sf):
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))
    known = F.when(F.col("k").isNotNull(), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(F.min_by("k", known).alias("first_k"), F.max("k").alias("max_k"))


@query("""SELECT event_id, j.key, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) AS j""")
def json_walk(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))
    return e.select("event_id", "key", "value")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '  n/a ' ELSE p_name END AS name, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS brand FROM part),
c AS (SELECT p_partkey, CASE WHEN lower(trim(name)) IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'unknown') THEN '' ELSE trim(name) END AS name, trim(brand) AS brand FROM p)
SELECT count(*) AS rows_in, count(*) FILTER (name <> '' AND brand <> '') AS rows_out, count(*) FILTER (name = '') AS no_name, count(*) FILTER (brand = '') AS no_brand FROM c""")
def cleaning_report(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select(F.when(k % 11 == 0, "  n/a ").otherwise(F.col("p_name")).alias("name"), F.when(k % 13 == 0, "").otherwise(F.col("p_brand")).alias("brand"))
    p = p.select(text.clean_cell("name").alias("name"), text.clean_cell("brand").alias("brand"))
    blank = lambda c: F.col(c) == ""
    return p.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(~blank("name") & ~blank("brand")).alias("rows_out"), F.count_if(blank("name")).alias("no_name"), F.count_if(blank("brand")).alias("no_brand"))


@query("""SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY revenue DESC, c_mktsegment LIMIT 5""")
def flagship(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'F'").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return ranking.top_k(o, [F.desc("revenue"), F.asc("c_mktsegment")], 5)
