"""Queries of alerts, incidents and remembered results, on events and documents."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import absence, alerts, cohorts, memo
from ..operators.storage import shared_dir
from .driver_queries import query, read

#: Kinds of alerts that types of events stand for.
KINDS = {"error": "new_failure", "click": "minor_degradation", "view": "direct_source_degraded", "purchase": "recovery", "signup": "minor_recovery"}
HOURS = 6


def _alerts(spark, sf) -> DataFrame:
    """Events as alerts of a user's source: the type of event is the kind, its properties the reason."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    return read(spark, sf, "events").select(
        F.concat(F.lit("source:"), "user_id").alias("health_key"), F.col("ts").alias("detected_at"), F.col("event_id").alias("seq"), kind.alias("alert_type"), F.concat(F.lit("Source "), "user_id").alias("label"),
        F.floor("value").cast("long").alias("rows_returned"), F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("reason_codes"),
    )


KIND_SQL = f"CASE event_type {' '.join(f'WHEN {e!r} THEN {k!r}' for e, k in KINDS.items())} END"
ALERT_SQL = f"""a AS (SELECT 'source:' || user_id AS health_key, ts AS detected_at, event_id AS seq, {KIND_SQL} AS alert_type, 'Source ' || user_id AS label, CAST(floor(value) AS BIGINT) AS n_rows, 'k' || (props->>'$.k') AS reason FROM events)"""
_FAILURES, _RECOVERIES = "('new_failure', 'minor_degradation', 'direct_source_degraded')", "('recovery', 'minor_recovery')"
_LIST = list(KINDS.values())


def _sent_sql() -> str:
    """All keys' alerts, one of each key a step: s and r are when each kind was last sent and resolved."""
    s = [f"s{i}" for i in range(len(_LIST))]
    r = [f"r{i}" for i in range(len(_LIST))]
    ended = [f"CASE WHEN {r[i]} IS NULL AND nk IN {_RECOVERIES if k not in ('recovery', 'minor_recovery') else str(('new_failure', 'minor_degradation'))} THEN t ELSE {r[i]} END AS {r[i]}" for i, k in enumerate(_LIST)]
    own = lambda c: f"CASE nk {' '.join(f'WHEN {k!r} THEN {c[i]}' for i, k in enumerate(_LIST))} END"
    after = [f"CASE WHEN sends AND nk = {k!r} THEN t ELSE {s[i]} END" for i, k in enumerate(_LIST)] + [f"CASE WHEN sends AND nk = {k!r} THEN NULL ELSE {r[i]} END" for i, k in enumerate(_LIST)]
    return f"""WITH RECURSIVE {ALERT_SQL},
e AS (SELECT health_key, CAST(floor(epoch(detected_at)) AS BIGINT) AS t, seq, alert_type AS nk, row_number() OVER (PARTITION BY health_key ORDER BY CAST(floor(epoch(detected_at)) AS BIGINT), seq) AS n FROM a),
f(health_key, n, seq, alert_type, sent, {', '.join(s + r)}) AS (SELECT DISTINCT health_key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), false, {', '.join(['CAST(NULL AS BIGINT)'] * (2 * len(_LIST)))} FROM e
UNION ALL SELECT health_key, n, seq, nk, sends, {', '.join(after)} FROM (SELECT *, {own(s)} IS NULL OR {own(r)} IS NOT NULL OR t - {own(s)} >= {HOURS * 3600} AS sends
  FROM (SELECT e.health_key, e.n, e.seq, e.nk, e.t, {', '.join(s)}, {', '.join(ended)} FROM f JOIN e ON e.health_key = f.health_key AND e.n = f.n + 1)))
SELECT health_key, seq, alert_type, sent FROM f WHERE n > 0"""


@query(_sent_sql())
def alerts_sent(spark, sf):
    return alerts.sent(_alerts(spark, sf), HOURS * 3600)


@query(f"""WITH {ALERT_SQL}
SELECT seq, alert_type, CASE WHEN alert_type IN {_FAILURES} THEN (SELECT arg_min(b.detected_at, (b.detected_at, b.seq)) FROM a b WHERE b.health_key = a.health_key AND b.alert_type IN {_RECOVERIES} AND (b.detected_at, b.seq) > (a.detected_at, a.seq)) END AS resolved_at FROM a""")
def alerts_resolved(spark, sf):
    return alerts.resolved(_alerts(spark, sf)).select("seq", "alert_type", "resolved_at")


@query(f"""WITH {ALERT_SQL}, e AS (SELECT health_key, max((detected_at, seq)) AS last FROM a WHERE alert_type IN {_RECOVERIES} GROUP BY health_key),
o AS (SELECT DISTINCT a.health_key, alert_type FROM a LEFT JOIN e USING (health_key) WHERE alert_type IN {_FAILURES} AND (last IS NULL OR (detected_at, seq) > last))
SELECT health_key FROM o GROUP BY health_key HAVING bool_and(alert_type = 'minor_degradation')""")
def open_minor_incidents(spark, sf):
    return alerts.open_minor_incidents(_alerts(spark, sf))


@query(f"""WITH {ALERT_SQL}, d AS (SELECT * FROM a WHERE alert_type = 'minor_degradation'), b AS (SELECT health_key, max(detected_at) AS back FROM a WHERE alert_type = 'minor_recovery' GROUP BY health_key)
SELECT health_key, count(*) AS occurrences, min(detected_at) AS first_at, max(detected_at) AS last_at, arg_max(label, (detected_at, seq)) AS label, arg_max(n_rows, (detected_at, seq)) AS rows_returned,
array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons, CASE WHEN any_value(back) >= max(detected_at) THEN 'yes' ELSE 'unknown' END AS recovered FROM d LEFT JOIN b USING (health_key) GROUP BY health_key""")
def minor_incidents(spark, sf):
    out = alerts.minor_incidents(_alerts(spark, sf))
    return out.select("health_key", "occurrences", "first_at", "last_at", "latest.label", "latest.rows_returned", F.array_join("reasons", ",").alias("reasons"), "recovered")


@query(r"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']) AS BIGINT) AS n_words, length(text) AS n_chars, text IN (SELECT text FROM d WHERE lang = 'en') AS was_known FROM d""")
def memo_word_counts(spark, sf):
    """English documents are counted and remembered; then all are asked for, and only texts that no English one had are counted."""
    path = f"{shared_dir(spark).rstrip('/')}/memo-{uuid.uuid4().hex}"
    d = read(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", memo.fingerprint({"text": F.col("text")}))

    def counts(turn: int):
        words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        return lambda rows: rows.select("fingerprint", F.size(words).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"), F.lit(turn).alias("turn"))

    day = datetime.date(2026, 6, 1)
    memo.remembered(d.where("lang = 'en'"), path, counts(1), 1, day, keep=["fingerprint"])
    out, _ = memo.remembered(d, path, counts(2), 1, day, keep=["doc_id", "fingerprint"])
    return out.select("doc_id", "n_words", "n_chars", (F.col("turn") == 1).alias("was_known"))


# -- generations and cohorts ------------------------------------------------------------------------

_SEASON = "nullif(CAST(CAST(props->>'$.k' AS BIGINT) // 40 AS VARCHAR), '0')"


@query(f"""WITH s AS (SELECT user_id || '-' || event_type AS identity, user_id AS company, ts AS observed_at, event_id AS seq, {_SEASON} AS season FROM events WHERE event_type IN ('view', 'purchase')),
r AS (SELECT user_id AS company, ts AS observed_at, event_type <> 'error' AS clean FROM events WHERE event_type IN ('error', 'click', 'signup')),
l AS (SELECT *, lag(observed_at) OVER o AS last_seen, last_value(season IGNORE NULLS) OVER (PARTITION BY identity ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM s WINDOW o AS (PARTITION BY identity ORDER BY observed_at, seq)),
m AS (SELECT l.*, (SELECT arg_max(clean, (r.observed_at, NOT clean)) FROM r WHERE r.company = l.company AND r.observed_at <= l.observed_at) AS clean,
  (SELECT max(r.observed_at) FROM r WHERE r.company = l.company AND NOT clean AND r.observed_at <= l.observed_at) AS broke,
  (SELECT min(r.observed_at) FROM r WHERE r.company = l.company) AS opened FROM l WHERE last_seen IS NOT NULL),
n AS (SELECT *, (epoch(observed_at)::BIGINT - epoch(last_seen)::BIGINT) / 86400.0 AS days, CASE WHEN clean THEN coalesce((SELECT min(r.observed_at) FROM r WHERE r.company = m.company AND r.observed_at > m.broke), opened) END AS since FROM m),
t AS (SELECT *, CASE WHEN season <> stored THEN 'season_change' WHEN since <= last_seen AND floor(epoch(observed_at))::BIGINT - floor(epoch(last_seen))::BIGINT >= 2 * 86400 THEN 'sustained_absence' END AS trigger FROM n)
SELECT identity, seq, trigger, last_seen, stored AS stored_season, season FROM t WHERE trigger IS NOT NULL""")
def generation_events(spark, sf):
    """Views and purchases as sightings of postings, errors, clicks and signups as runs of their user's source."""
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    season = F.nullif(F.floor(k / 40).cast("string"), F.lit("0"))
    s = e.where("event_type in ('view', 'purchase')").select(F.concat_ws("-", "user_id", "event_type").alias("identity"), F.col("user_id").alias("company"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"), season.alias("season"))
    r = e.where("event_type in ('error', 'click', 'signup')").select(F.col("user_id").alias("company"), F.col("ts").alias("observed_at"), (F.col("event_type") != "error").alias("clean"))
    out = absence.generation_events(s, r, 2)
    return out.join(s.select("identity", "observed_at", "seq"), ["identity", "observed_at"]).select("identity", "seq", "trigger", "last_seen", "stored_season", "season")


@query("""WITH p AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS track FROM orders),
a AS (SELECT id, row_number() OVER (ORDER BY sha256(concat_ws(chr(31), '11:random', CAST(id AS VARCHAR))), id) AS place FROM p QUALIFY place <= 100),
b AS (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS place FROM p QUALIFY place <= 100),
q AS (SELECT id, track, row_number() OVER (PARTITION BY track ORDER BY sha256(concat_ws(chr(31), '11:track', CAST(id AS VARCHAR))), id) AS turn FROM p QUALIFY turn <= 100),
c AS (SELECT id, row_number() OVER (ORDER BY turn, CASE WHEN track = '5-LOW' THEN 1 ELSE 2 END, track) AS place FROM q QUALIFY place <= 100),
u AS (SELECT id, 0 AS k, 'random' AS g, place FROM a UNION ALL SELECT id, 1, 'top', place FROM b UNION ALL SELECT id, 2, 'mixed', place FROM c),
v AS (SELECT id, min((k, place)) AS first, string_agg(g, ',' ORDER BY k) AS groups FROM u GROUP BY id)
SELECT id, groups, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS position FROM v""")
def evaluation_cohorts(spark, sf):
    """A random, a top and a stratified cohort of orders, a hundred each, and their union."""
    p = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("track"))
    drawn = {"random": cohorts.random_cohort(p, 100, 11), "top": cohorts.top_cohort(p, 100, [F.desc("price")]), "mixed": cohorts.stratified_cohort(p, 100, 11, "track", ["5-LOW"])}
    return cohorts.union_of(drawn).select("id", F.array_join("groups", ",").alias("groups"), "position")
