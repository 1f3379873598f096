"""Queries of the posting side: rules on parts advertised by given wordings, decisions on the driver's tables, each with SQL of the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import country, decisions, eligibility, fit, roles
from .driver_queries import ORACLES, QUERIES, query, read
from .posting_run import scored
from .watch import matches, with_gate

NAMES = ("k", "title", "company", "description", "requirements")
#: (key, title, company, description, requirements, role, track, confidence): each row reaches another decision.
ROLE_ROWS = (
    (1, "Backend Intern", "Acme", "Build APIs.", "Java", "swe", "backend", 0.87),
    (2, "Data Entry Intern", "Acme", "Fill spreadsheets.", "", "non_technical", "non_technical", 0.9),
    (3, "Strategy Intern", "Acme", "Plan things.", "", "non_technical", "non_technical", 0.86),
    (4, "Embedded Intern", "Acme", "Write firmware.", "", "swe", "embedded_software", 0.78),
    (5, "Embedded Internship", "Acme", "Solder boards.", "", "unknown", "electrical_hardware", 0.78),
    (6, "Selenium automation test intern", "Acme", "", "", "swe", "sdet_qa_automation", 0.78),
    (7, "Summer Internship Program", "Acme", "Tracks include software and finance.", "", "swe", "general_swe", 0.64),
    (8, "Technology Intern", "Capital One", "", "", "swe", "general_swe", 0.82),
    (9, "Data & AI Intern - Analyst", "Foo", "", "", "ml_ai", "ml_ai", 0.82),
    (10, "Product Manager Intern", "Acme", "Own production code and REST APIs; programming daily.", "Python", "swe", "backend", 0.7),
    (11, "Product Manager Intern", "Acme", "Talk to customers.", "", "product", "product", 0.82),
    (12, "Quality Engineer Intern", "Acme", "Build qa automation.", "", "swe", "sdet_qa_automation", 0.82),
    (13, "Automation Engineer Intern", "Acme", "Write software APIs.", "", "swe", "platform_infra", 0.72),
    (14, "Factory Automation Engineer", "Acme", "Firmware for PLC lines.", "", "swe", "firmware", 0.74),
    (15, "Mechanical Engineer Intern", "Acme", "CAD work.", "", "unknown", "mechanical_manufacturing", 0.82),
    (16, "Cloud Intern", "Acme", "Deploy platform services in Python.", "", "swe", "cloud", 0.68),
    (17, "Cloud Intern", "Acme", "Make slides.", "", "unknown", "other_engineering", 0.68),
    (18, "DevOps Intern", "Acme", "Keep things tidy.", "", "swe", "devops", 0.82),
    (19, "Embedded Engineer Intern", "Acme", "Production code for boards.", "", "swe", "embedded_software", 0.7),
    (20, "Engineer Intern", "Acme", "Write software.", "", "swe", "general_swe", 0.68),
    (21, "Engineer Intern", "Acme", "Pumps and valves.", "", "unknown", "other_engineering", 0.66),
    (22, "Intern", "Acme", "Help our data engineering team.", "", "data_science", "data_engineering", 0.58),
    (23, "Intern", "Acme", "Does code review daily.", "", "swe", "general_swe", 0.58),
    (24, "Intern", "Acme", "Marketing errands.", "", "non_technical", "non_technical", 0.55),
    (25, "Intern", "Acme", "Water flowers.", "", "unknown", "unknown", 0.2),
    (26, "Java Web Developer Intern", "Acme", "", "", "swe", "full_stack", 0.78),
    (27, None, None, None, None, "unknown", "unknown", 0.2),
)
#: (key, fit score, explanation) of some of them.
FIT_ROWS = (
    (1, 90, "Backend software with resume overlap in Java, REST/API/backend service work."),
    (2, 0, "Non-technical role outside the target SWE/software-adjacent watcher track."),
    (12, 50, "SDET / QA automation, but limited direct resume stack overlap."),
    (14, 40, "Firmware, but limited direct resume stack overlap; penalties: low-level/embedded/hardware-heavy context (-10)."),
    (16, 72, "Cloud software with resume overlap in Python, REST/API/backend service work; smaller positives: Vercel/Render deployment."),
    (20, 74, "Software engineering, but limited direct resume stack overlap."),
    (25, 0, "Role lacks strong software/backend/data/ML/quant evidence for the SWE watcher."),
)
#: (key, location, remote status, score)
PLACE_ROWS = ((1, "Boston, MA", "Remote", 100), (2, "remote", "", 100), (3, "New York", "Hybrid", 85), (4, "Austin", "Hybrid", 60), (5, "Ithaca, NY", "On-site", 75), (6, "", "", 60), (7, "London, UK", "On-site", 30), (8, "Austin", "On-site", 50), (9, None, None, 60))
#: (key, company, title, requirements, description, reason, level, negated, mixed): each wording that closes a posting, and those that don't.
ELIGIBILITY_ROWS = (
    (1, "Acme", "Machine Learning PhD Intern", "", "", "phd_only", "phd", False, False),
    (2, "Acme", "Intern", "Must be enrolled in a doctoral program. Python required.", "", "phd_only", "phd", False, False),
    (3, "Acme", "Intern", "Graduate students only. Python required.", "", "graduate_only", "graduate", False, False),
    (4, "Acme", "Intern", "Must be enrolled in a master's program.", "", "graduate_only", "masters", False, False),
    (5, "Acme", "Software Engineer MBA Intern", "", "", "graduate_only", "mba", False, False),
    (6, "Acme", "Intern", "Freshmen only. Python required.", "", "freshman_only", "undergraduate", False, False),
    (7, "Acme", "Intern", "Open exclusively to first-year students.", "", "freshman_only", "undergraduate", False, False),
    (8, "Acme", "Intern", "Eligible applicants are rising sophomores only after completing their freshman year.", "", "freshman_only", "undergraduate", False, False),
    (9, "Acme", "Returning Intern Software Engineer", "", "", "returning_intern_only", "unspecified", False, False),
    (10, "Acme", "Intern", "Applicants must have previously completed an internship with Acme.", "", "returning_intern_only", "unspecified", False, False),
    (11, "Acme", "Intern", "", "This is an invitation-only return internship for former interns.", "returning_intern_only", "unspecified", False, False),
    (12, "Acme", "Intern", "", "Eligible only for prior internship program participants.", "returning_intern_only", "unspecified", False, False),
    (13, "Acme", "Master Data Management Intern", "", "", None, "unspecified", False, False),
    (14, "Acme", "Intern", "Minimum: bachelor's degree. PhD preferred.", "", None, "undergraduate", False, False),
    (15, "Acme", "Intern", "Bachelor's, Master's, or PhD candidates are eligible.", "", None, "undergraduate", False, True),
    (16, "Acme", "Intern", "", "You will collaborate with PhD researchers on advanced research.", None, "unspecified", False, False),
    (17, "Acme", "Intern", "Current student in their third year or beyond of a bachelor's program, currently enrolled in a master's program, or within one year of graduation.", "", None, "undergraduate", False, True),
    (18, "Acme", "Intern", "Advanced degree not required.", "", None, "unspecified", True, False),
    (19, "Acme", "Intern", "Freshmen and sophomores are accepted.", "", None, "undergraduate", False, True),
    (20, "Acme", "Intern", "", "Freshmen are encouraged to apply.", None, "undergraduate", False, False),
    (21, "Acme", "Intern", "", "Eligible only for prior leadership program participants.", None, "unspecified", False, False),
    (22, "Acme", "Intern", "Must return to school after the internship.", "", None, "unspecified", False, False),
    (23, "Acme", "Intern", "Minimum qualifications:\nCurrently pursuing a bachelor's degree.\nPreferred qualifications:\nCurrently pursuing a PhD.", "", None, "undergraduate", False, False),
    (24, "Acme", "Graduate Research Intern", "Undergraduates welcome.", "", "graduate_only", "graduate", False, False),
    (25, "Acme", "Postdoc Intern", "", "", "phd_only", "postdoctoral", False, False),
    (26, "Acme", "Law Student Internship", "", "", "graduate_only", "jd", False, False),
    (27, None, None, None, None, None, "unspecified", False, False),
)
#: (key, country, location, remote status, description, status, reason): what tells a country, and what doesn't.
COUNTRY_ROWS = (
    (1, None, "Boston, United States", "", "", "us", None),
    (2, None, "London, United Kingdom", "", "", "outside_us", "outside_us"),
    (3, None, "Madrid, MD", "", "", "ambiguous", None),
    (4, None, "Santa Fe, New Mexico", "", "", "ambiguous", None),
    (5, None, "Mexico City, Mexico", "", "", "outside_us", "outside_us"),
    (6, "DE", "Berlin", "", "", "outside_us", "outside_us"),
    (7, "USA", "Toronto, Canada", "", "", "us", None),
    (8, None, "Toronto, Canada / Austin, USA", "", "", "us", None),
    (9, None, "", "", "Our team in Bengaluru, India works on search. Join us.", "outside_us", "outside_us"),
    (10, None, "", "", "Our customers in India love it. Join us.", "ambiguous", None),
    (11, None, "IND - Pune", "", "", "outside_us", "outside_us"),
    (12, None, "San Juan, Puerto Rico", "", "", "us", None),
    (13, None, "Remote", "Remote (EMEA)", "", "outside_us", "outside_us"),
    (14, None, "S\u00e3o Tom\u00e9 and Pr\u00edncipe", "", "", "outside_us", "outside_us"),
    (15, None, "Atlanta, Georgia", "", "", "ambiguous", None),
    (16, None, "Paris, France", "", "Or work in the United States office", "us", None),
    (17, None, "US", "", "", "us", None),
    (18, None, None, None, None, "ambiguous", None),
    (19, "Czech Republic", "", "", "", "outside_us", "outside_us"),
    (20, "C\u00f4te d\u2019Ivoire", "", "", "", "outside_us", "outside_us"),
)
PROFILE = fit.Profile(skills=("python", "java", "sql", "react", "docker"), interests=("backend", "ml/ai"), preferred_locations=("ithaca", "new york", "boston"))


def _values(rows, names: str) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def _postings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:5] for r in ROLE_ROWS], "k int, title string, company string, description string, requirements string")


def _advertised(spark: SparkSession, sf: str, texts: DataFrame, n: int) -> DataFrame:
    """Each part, advertised by the wordings of one of the texts (k, title, company, description, requirements): its name and type follow the description, every other title is in capitals."""
    p = read(spark, sf, "part")
    own = p.join(F.broadcast(texts), F.pmod("p_partkey", F.lit(n)) + 1 == F.col("k")).drop("k")
    return own.select(
        F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), F.coalesce("company", "p_brand").alias("company"),
        F.concat_ws(" ", "description", "p_name", "p_type").alias("description"), "requirements",
    )


def _advertised_sql(rows) -> str:
    """The same in SQL, with texts in lower case: title, company, body, whole."""
    values = _values([r[:5] for r in rows], "n, title, company, description, requirements")
    return f"""a AS (SELECT p_partkey AS k, lower(coalesce(title, '')) AS title, lower(coalesce(company, p_brand)) AS company, lower(concat_ws(' ', description, p_name, p_type, coalesce(requirements, ''))) AS body FROM part JOIN {values} ON p_partkey % {len(rows)} + 1 = n),
b AS (SELECT *, title || ' ' || body AS whole FROM a)"""


#: The decisions in their order, as far as the wordings above go: condition on the texts, track, confidence.
ROLE_RULES = (
    ("title = 'data & ai intern - analyst'", "'ml_ai'", 0.82),
    ("company = 'capital one' AND title = 'technology intern'", "'general_swe'", 0.82),
    ("contains(title, 'data entry')", "'non_technical'", 0.9),
    ("contains(title, 'strategy')", "'non_technical'", 0.86),
    (r"regexp_matches(title, '\bembedded intern')", "CASE WHEN regexp_matches(whole, 'firmware|embedded software') THEN 'embedded_software' ELSE 'electrical_hardware' END", 0.78),
    ("contains(title, 'automation test')", "'sdet_qa_automation'", 0.78),
    ("contains(title, 'web developer')", "'full_stack'", 0.78),
    ("contains(title, 'internship program') AND regexp_matches(body, 'tracks include.*software')", "'general_swe'", 0.64),
    ("contains(title, 'backend') AND regexp_matches(whole, 'apis?|software')", "'backend'", 0.87),
    ("contains(title, 'backend')", "'backend'", 0.82),
    ("contains(title, 'devops')", "'devops'", 0.82),
    ("contains(title, 'product manager') AND regexp_matches(whole, 'production code|programming')", "CASE WHEN contains(whole, 'api') THEN 'backend' ELSE 'general_swe' END", 0.7),
    ("contains(title, 'quality engineer') AND contains(whole, 'qa automation')", "'sdet_qa_automation'", 0.82),
    ("contains(title, 'automation engineer') AND NOT contains(title, 'factory') AND regexp_matches(whole, 'software|apis?')", "'platform_infra'", 0.72),
    ("contains(title, 'automation engineer') AND contains(whole, 'firmware')", "'firmware'", 0.74),
    ("contains(title, 'product manager')", "'product'", 0.82),
    ("contains(title, 'mechanical engineer')", "'mechanical_manufacturing'", 0.82),
    ("contains(title, 'cloud') AND contains(whole, 'platform services')", "'cloud'", 0.68),
    ("contains(title, 'cloud')", "'other_engineering'", 0.68),
    ("contains(title, 'embedded engineer')", "CASE WHEN regexp_matches(whole, 'firmware|software|production code') THEN 'embedded_software' ELSE 'electrical_hardware' END", 0.7),
    ("contains(title, 'engineer') AND regexp_matches(whole, 'software|production code')", "'general_swe'", 0.68),
    ("contains(title, 'engineer')", "'other_engineering'", 0.66),
    ("contains(body, 'data engineering')", "'data_engineering'", 0.58),
    ("regexp_matches(whole, 'code review|software')", "'general_swe'", 0.58),
    ("contains(body, 'marketing')", "'non_technical'", 0.55),
    ("true", "'unknown'", 0.2),
)
ROLES_OF_SQL = {"swe": ("backend", "full_stack", "general_swe", "platform_infra", "devops", "cloud", "embedded_software", "firmware", "sdet_qa_automation"), "data_science": ("data_engineering",), "ml_ai": ("ml_ai",), "product": ("product",), "non_technical": ("non_technical",)}
ROLE_SQL = f"""{_advertised_sql(ROLE_ROWS)},
c AS (SELECT k, whole, CASE {' '.join(f"WHEN {when} THEN {track}" for when, track, _ in ROLE_RULES)} END AS role_track, CASE {' '.join(f"WHEN {when} THEN CAST({sure} AS DOUBLE)" for when, _, sure in ROLE_RULES)} END AS confidence FROM b),
r AS (SELECT *, CASE {' '.join(f"WHEN role_track IN {tracks if len(tracks) > 1 else repr(tracks).replace(',', '')} THEN '{role}'" for role, tracks in ROLES_OF_SQL.items())} ELSE 'unknown' END AS role FROM c)"""


@query(f"WITH {ROLE_SQL} SELECT k, role, role_track, confidence FROM r")
def role_classes(spark, sf):
    c = roles.with_role(_advertised(spark, sf, _postings(spark), len(ROLE_ROWS)))
    return c.select("k", "role_class.role", "role_class.role_track", "role_class.confidence")


@query(f"""WITH {ROLE_SQL},
f AS (SELECT k, CASE role_track {' '.join(f"WHEN '{t}' THEN {n}" for t, n in fit.TRACK_AFFINITY.items() if n)} ELSE 0 END AS base, role_track, whole,
  CAST(regexp_matches(whole, '\\bpython\\b') AS INTEGER) + CAST(regexp_matches(whole, '\\bjava\\b') AS INTEGER) + CAST(regexp_matches(whole, '\\brest\\b|\\bapis?\\b|\\bbackend\\b|\\bservices?\\b') AS INTEGER)
  + CAST(contains(whole, 'analytics') AS INTEGER) + CAST(regexp_matches(whole, '\\btesting\\b') AS INTEGER) AS skills,
  2 * (CAST(regexp_matches(whole, '\\bdeploy\\b') AS INTEGER) + CAST(regexp_matches(whole, '\\bfinance\\b') AS INTEGER)) AS small,
  CASE WHEN regexp_matches(whole, 'firmware|embedded|hardware|mechanical|cad\\b') OR role_track IN ('embedded_software', 'firmware') THEN 10 ELSE 0 END AS cost FROM r)
SELECT k, CAST(CASE WHEN base = 0 OR role_track IN ('cloud', 'devops') AND NOT regexp_matches(whole, 'apis?\\b|services?\\b|backend') THEN 0 ELSE least(94, base + least(16, 4 * skills) + least(6, small) - cost) END AS INTEGER) AS score FROM f""")
def role_relevance(spark, sf):
    c = roles.with_role(_advertised(spark, sf, _postings(spark), len(ROLE_ROWS)))
    return fit.with_fit(c, fit.Profile()).select("k", "fit.score")


PLACE_TEXTS = tuple(r[:3] for r in PLACE_ROWS)


@query(f"""WITH p AS (SELECT p_partkey AS k, lower(coalesce(location, '')) AS loc, lower(coalesce(how, '')) AS how FROM part JOIN {_values(PLACE_TEXTS, "n, location, how")} ON p_partkey % {len(PLACE_TEXTS)} + 1 = n),
l AS (SELECT *, regexp_matches(loc, 'ithaca|new york|boston') AS liked FROM p)
SELECT k, CASE WHEN contains(how, 'remote') OR trim(loc) = 'remote' THEN 100 WHEN contains(how, 'hybrid') AND liked THEN 85 WHEN contains(how, 'hybrid') THEN 60 WHEN liked THEN 75 WHEN loc = '' THEN 60 WHEN regexp_matches(loc, 'india|bengaluru|bangalore|london|berlin|toronto|singapore') THEN 30 ELSE 50 END AS score FROM l""")
def place_scores(spark, sf):
    at = spark.createDataFrame(PLACE_TEXTS, "k int, location string, remote_status string")
    rows = read(spark, sf, "part").join(F.broadcast(at), F.pmod("p_partkey", F.lit(len(PLACE_TEXTS))) + 1 == F.col("k"))
    return rows.select(F.col("p_partkey").alias("k"), fit.place(PROFILE)["score"].alias("score"))


def document_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as postings: the whole text is the description, key figures vary with the id."""
    k = F.col("doc_id")
    pick = lambda by, *words: F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod(k, F.lit(by)) % len(words) + 1).cast("int"))
    return read(spark, sf, "documents").select(
        k.alias("pos"), pick(97, "Backend Intern", "Data Science Intern", "Marketing Intern", "Software Engineering Intern", "Engineer Intern", "Summer Analyst").alias("title"),
        F.concat(F.lit("Company "), k % 500).alias("company"), pick(89, "Boston, MA", "London", "", "Austin, TX").alias("location"), pick(83, "Remote", "Hybrid", "On-site", "").alias("remote_status"),
        pick(79, "$35/hr", "unpaid", "$80,000 per year", "competitive", "").alias("compensation"), F.coalesce("text", F.lit("")).alias("description"), pick(73, "Python, SQL and REST APIs", "", "3+ years of Java").alias("requirements"),
        pick(71, "2026-06-20", "", "June 1, 2026").alias("deadline"), pick(67, "Summer", "").alias("internship_type"),
    )


@query(None)
def posting_run(spark, sf):
    """Documents as postings, scored from end to end."""
    d = document_postings(spark, sf)
    # rules cost far more than dealing rows out: a file of few splits would keep most cores idle
    cores = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < cores:
        d = d.repartition(cores)
    out = scored(d, PROFILE, F.lit("2026-06-09").cast("date"))
    return out.select("pos", "id", "total", "fit_score", "bucket", "action", "watcher_action", "role", "role_track", "deadline_days_left", F.size("red_flags").alias("n_flags"), F.size("positive_signals").alias("n_signals"))


# -- decisions on the driver's tables ---------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, ['Summer ' || (2023 + o_orderkey % 5), 'Fall 20' || (24 + o_orderkey % 3)] AS terms, o_orderkey % 7 = 0 AS bare FROM orders),
y AS (SELECT o_orderkey, CASE WHEN bare THEN NULL ELSE greatest(2023 + o_orderkey % 5, 2024 + o_orderkey % 3) END AS newest FROM o)
SELECT o_orderkey, CASE WHEN newest IS NULL THEN 'unknown' WHEN newest < 2025 THEN 'stale' WHEN newest = 2025 THEN 'rollover_due' ELSE 'ok' END AS status FROM y""")
def season_terms(spark, sf):
    k = F.col("o_orderkey")
    terms = F.when(k % 7 == 0, F.array(F.lit("Summer"))).otherwise(F.array(F.concat(F.lit("Summer "), 2023 + k % 5), F.concat(F.lit("Fall 20"), 24 + k % 3)))
    return read(spark, sf, "orders").select(k, decisions.season_status(terms, F.lit("2025-07-01").cast("date")).alias("status"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS INTEGER) - 3 END AS d, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'soon' END AS deadline, (o_orderkey % 10) / 10.0::DOUBLE AS c FROM orders)
SELECT o_orderkey, CASE WHEN d IS NULL THEN CASE WHEN deadline = '' THEN 'rolling' ELSE deadline END WHEN d < 0 THEN 'expired ' || (-d) || 'd ago' WHEN d = 0 THEN 'due today' WHEN d = 1 THEN '1 day left' ELSE d || ' days left' END AS due,
CASE WHEN d IS NULL THEN 'neutral' WHEN d < 0 THEN 'low' WHEN d <= 3 THEN 'mid' ELSE 'neutral' END AS tone, CAST(greatest(0, least(4, floor(c * 4 + 0.5::DOUBLE))) AS INTEGER) AS dots FROM o""")
def deadline_display(spark, sf):
    k = F.col("o_orderkey")
    d = F.when(k % 11 != 0, (k % 9).cast("int") - 3)
    return read(spark, sf, "orders").select(k, decisions.deadline_text(d, F.when(k % 2 == 0, "").otherwise("soon")).alias("due"), decisions.deadline_tone(d).alias("tone"), decisions.confidence_dots((k % 10) / 10.0).alias("dots"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'not_collected' WHEN o_orderkey % 19 = 0 THEN 'not_on_watchlist' WHEN o_orderkey % 17 = 0 THEN 'wrong_season' WHEN o_orderkey % 13 = 0 THEN 'not_internship' WHEN o_orderkey % 11 = 0 THEN 'closed'
WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'phd_only' WHEN o_orderkey % 5 = 0 THEN 'outside_us' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'nontechnical_role' ELSE 'watcher_role_ineligible' END
WHEN o_orderkey % 100 < 40 THEN 'below_min_score' WHEN o_orderkey % 31 = 0 THEN 'already_emailed' WHEN o_orderkey % 37 = 0 THEN 'explicitly_primed' ELSE 'pending' END AS reason FROM orders""")
def final_reasons(spark, sf):
    k = F.col("o_orderkey")
    ok = lambda n: k % n != 0
    reason = decisions.final_reason(ok(23), ok(19), ok(17), ok(13), ok(11), ok(29), F.when(k % 7 == 0, "phd_only"), F.when(k % 5 == 0, "outside_us").otherwise("us"), ok(3), F.when(k % 2 == 0, "unknown").otherwise("swe"), (k % 100).cast("int"), F.lit(40), k % 31 == 0, k % 37 == 0)
    return read(spark, sf, "orders").select(k, reason.alias("reason"))


@query("""SELECT o_custkey, CASE WHEN NOT bool_or(o_orderstatus = 'O') THEN 'collected_rejected' WHEN bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority <> '1-URGENT') THEN 'both' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'direct_only' ELSE 'github_only' END AS category FROM orders GROUP BY o_custkey""")
def comparison_categories(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderpriority") == "1-URGENT", "direct_ats").otherwise("feed")).alias("sources"), F.bool_or(F.col("o_orderstatus") == "O").alias("open"))
    return o.select("o_custkey", decisions.comparison_category("sources", F.when(F.col("open"), "pending").otherwise("closed")).alias("category"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'schedule' ELSE 'manual' END AS event, list_extract(['TRUE', ' yes ', 'off', '', 'maybe', NULL], CAST(event_id % 6 AS INTEGER) + 1) AS raw FROM events),
s AS (SELECT *, lower(trim(coalesce(raw, ''))) AS said FROM e)
SELECT event_id, said IN ('1','true','yes','y','on') AS send_email, CASE WHEN event <> 'schedule' THEN 'not_applicable' WHEN said IN ('1','true','yes','y','on') THEN 'recognized_true' WHEN said IN ('0','false','no','n','off') THEN 'recognized_false' WHEN said = '' THEN 'missing_or_blank' ELSE 'invalid' END AS config_status,
CASE WHEN event <> 'schedule' THEN 'not_applicable' WHEN said IN ('1','true','yes','y','on') THEN 'yes' ELSE 'no' END AS scheduled_email_enabled FROM s""")
def send_modes(spark, sf):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("TRUE", " yes ", "off", "", "maybe", None))), (F.col("event_id") % 6 + 1).cast("int"))
    e = read(spark, sf, "events").select("event_id", decisions.send_mode(F.when(F.col("event_type") == "click", "schedule").otherwise("manual"), raw).alias("m"))
    return e.select("event_id", "m.*")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 3 = 0 THEN 'user_inactive' WHEN c_custkey % 5 = 0 THEN 'email_unverified' WHEN c_custkey % 13 = 0 OR c_custkey % 7 = 0 THEN 'globally_paused' WHEN c_mktsegment = 'BUILDING' THEN 'frequency_paused' WHEN c_mktsegment <> 'MACHINERY' THEN 'frequency_changed' END AS user_reason,
CASE WHEN c_custkey % 11 = 0 THEN 'match_missing' WHEN c_custkey % 7 = 0 THEN 'job_missing' WHEN c_custkey % 5 = 0 THEN 'match_dismissed' WHEN c_custkey % 3 = 0 THEN 'match_inactive' WHEN c_custkey % 2 = 0 THEN 'job_closed' END AS item_reason FROM customer""")
def cancellations(spark, sf):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    at = lambda n: F.when(k % n == 0, F.lit("2025-01-01").cast("timestamp"))
    user = F.when(k % 17 != 0, F.struct((k % 3 != 0).alias("is_active"), F.when(k % 5 != 0, F.lit("x")).alias("email_verified_at")))
    wants = F.when(k % 13 != 0, F.struct((k % 7 == 0).alias("globally_paused"), F.when(segment == "BUILDING", "paused").otherwise(segment).alias("alert_frequency")))
    match, job = F.when(k % 11 != 0, F.struct(at(5).alias("dismissed_at"), at(3).alias("no_longer_matches_at"))), F.when(k % 7 != 0, F.struct((k % 2 != 0).alias("is_open")))
    return read(spark, sf, "customer").select(k, decisions.user_cancellation(user, wants, F.lit("MACHINERY")).alias("user_reason"), decisions.item_cancellation(match, job).alias("item_reason"))


@query("""WITH e AS (SELECT event_id, list_extract(['new_failure', 'recovery', 'minor_degradation', 'season', 'coverage_regression'], CAST(event_id % 5 AS INTEGER) + 1) AS kind, list_extract(['off', 'transitions_only', 'failure_only'], CAST(event_id % 3 AS INTEGER) + 1) AS mode FROM events)
SELECT event_id, CASE WHEN kind = 'minor_degradation' THEN false WHEN mode = 'transitions_only' THEN kind IN ('new_failure', 'recovery', 'coverage_regression') WHEN mode = 'failure_only' THEN kind <> 'recovery' ELSE false END AS allowed FROM e""")
def alert_modes(spark, sf):
    pick = lambda *words: F.element_at(F.array(*(F.lit(w) for w in words)), (F.col("event_id") % len(words) + 1).cast("int"))
    allowed = decisions.allowed_by_mode(pick("new_failure", "recovery", "minor_degradation", "season", "coverage_regression"), pick("off", "transitions_only", "failure_only"), ("minor_degradation", "minor_recovery"))
    return read(spark, sf, "events").select("event_id", allowed.alias("allowed"))


ELIGIBILITY_TEXTS = tuple((k, title, company, description, requirements) for k, company, title, requirements, description, *_ in ELIGIBILITY_ROWS)


#: What closes a posting, as far as the wordings above go: condition on the title or the body, reason, level.
CLOSING_RULES = (
    ("regexp_matches(title, 'post-?doc')", "phd_only", "postdoctoral"),
    ("regexp_matches(title, '(phd|doctoral).*intern') OR regexp_matches(body, 'enrolled in a (phd|doctoral)')", "phd_only", "phd"),
    ("regexp_matches(title, 'graduate (student |research )?intern') AND NOT contains(title, 'undergraduate')", "graduate_only", "graduate"),
    ("regexp_matches(title, 'mba intern')", "graduate_only", "mba"),
    ("regexp_matches(title, 'law student intern')", "graduate_only", "jd"),
    ("regexp_matches(body, 'must be enrolled in a master')", "graduate_only", "masters"),
    ("regexp_matches(body, '(^|[^r])graduate students only')", "graduate_only", "graduate"),
    ("regexp_matches(body, '(freshmen|freshman|sophomores) only|exclusively to first-year')", "freshman_only", "undergraduate"),
    ("regexp_matches(title, 'returning intern') OR regexp_matches(body, 'return internship for former|prior internship program participants|completed an internship with acme')", "returning_intern_only", "unspecified"),
)
_UNDER = "undergraduate|bachelor|freshm[ae]n|first-year|sophomore|third year"


@query(f"""WITH {_advertised_sql(ELIGIBILITY_TEXTS)}
SELECT k, CASE {' '.join(f"WHEN {when} THEN '{reason}'" for when, reason, _ in CLOSING_RULES)} END AS exclusion_reason,
CASE {' '.join(f"WHEN {when} THEN '{level}'" for when, _, level in CLOSING_RULES)} WHEN regexp_matches(whole, '{_UNDER}') THEN 'undergraduate' ELSE 'unspecified' END AS degree_level,
regexp_matches(body, 'degree not required') AS negated,
regexp_matches(body, 'bachelor.s, master.s|bachelor.s program, currently enrolled in a master|freshmen and sophomores') AS mixed FROM b""")
def student_eligibility(spark, sf):
    texts = spark.createDataFrame(ELIGIBILITY_TEXTS, "k int, title string, company string, description string, requirements string")
    e = "student_eligibility."
    return eligibility.with_eligibility(_advertised(spark, sf, texts, len(ELIGIBILITY_TEXTS))).select("k", e + "exclusion_reason", e + "degree_level", F.col(e + "negation_detected").alias("negated"), F.col(e + "mixed_eligibility_detected").alias("mixed"))


COUNTRY_TEXTS = tuple(r[:5] for r in COUNTRY_ROWS)
_US_SQL, _OTHER_SQL = r"\b(usa|u s a?|us|united states|puerto rico|guam)\b", r"\b(united kingdom|mexico|canada|india|emea|france|germany|sao tome and principe|czech republic|cote d ivoire)\b"


@query(f"""WITH p AS (SELECT p_partkey AS k, coalesce(country, '') AS country, coalesce(location, '') AS location, regexp_replace(lower(strip_accents(replace(concat_ws(' / ', location, how), chr(8217), ' '))), '[^a-z0-9]+', ' ', 'g') AS loc,
  regexp_replace(lower(concat_ws(' ', description, p_name)), 'join us', '') AS said FROM part JOIN {_values(COUNTRY_TEXTS, "n, country, location, how, description")} ON p_partkey % {len(COUNTRY_TEXTS)} + 1 = n),
q AS (SELECT *, regexp_replace(loc, 'new mexico', '') AS bare, regexp_extract(said, '[^.]*\\b(team in|work in|based|located|offices?)\\b[^.]*') AS sentence FROM p),
r AS (SELECT k, CASE WHEN country IN ('US', 'USA') THEN 'us' WHEN country <> '' AND (length(country) = 2 OR regexp_matches(lower(strip_accents(replace(country, chr(8217), ' '))), '{_OTHER_SQL}')) THEN 'outside_us' WHEN country = '' AND regexp_matches(loc, '{_US_SQL}') THEN 'us'
  WHEN country = '' AND (regexp_matches(bare, '{_OTHER_SQL}') OR regexp_matches(location, '^(IND|GBR|CAN) -')) THEN 'outside_us' END AS placed,
  CASE WHEN regexp_matches(sentence, 'united states') THEN 'us' WHEN regexp_matches(sentence, '{_OTHER_SQL}') THEN 'outside_us' END AS told FROM q),
s AS (SELECT k, CASE WHEN placed = 'us' OR told = 'us' THEN 'us' ELSE coalesce(placed, told, 'ambiguous') END AS status FROM r)
SELECT k, status, CASE WHEN status = 'outside_us' THEN status END AS reason FROM s""")
def places_of_work(spark, sf):
    at = spark.createDataFrame(COUNTRY_TEXTS, "n int, country string, location string, remote_status string, description string")
    rows = read(spark, sf, "part").join(F.broadcast(at), F.pmod("p_partkey", F.lit(len(COUNTRY_TEXTS))) + 1 == F.col("n"))
    rows = rows.select(F.col("p_partkey").alias("k"), "country", "location", "remote_status", F.concat_ws(" ", "description", "p_name").alias("description"))
    return country.with_country(rows, country="country").select("k", "location_decision.status", "location_decision.reason")


GATE_SQL = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'phd_only' WHEN o_orderkey % 35 = 1 THEN 'unheard_of' END AS student, CASE WHEN o_orderkey % 3 = 0 THEN 'outside_us' END AS place,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'product' ELSE 'data_science' END AS role, CASE WHEN o_orderstatus = 'O' THEN 'data_engineering' WHEN o_orderstatus = 'F' THEN 'product' END AS track, CAST(o_orderkey % 4 AS INTEGER) * 30 AS fit FROM orders),
w AS (SELECT *, coalesce(track IN ('data_engineering'), false) AS wanted FROM r)
SELECT k, CASE WHEN student = 'phd_only' THEN student WHEN place IS NOT NULL THEN place WHEN wanted AND fit > 0 THEN NULL WHEN NOT wanted THEN coalesce(track, role) || ' does not match watcher target roles.' ELSE 'Role is outside the watcher target profile.' END AS reason FROM w"""


def _gated(spark, sf):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    student = F.struct(F.when(k % 5 == 0, "phd_only").when(k % 35 == 1, "unheard_of").alias("exclusion_reason"), none.alias("evidence_source"), none.alias("evidence"), none.alias("explanation"), *(F.lit(None).cast("boolean").alias(f) for f in ("mandatory_language_detected", "negation_detected", "mixed_eligibility_detected")))
    return read(spark, sf, "orders").select(
        k.alias("k"), student.alias("student_eligibility"), F.struct(none.alias("status"), F.when(k % 3 == 0, "outside_us").alias("reason"), none.alias("explanation")).alias("location_decision"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "product").otherwise("data_science").alias("role"), F.when(F.col("o_orderstatus") == "O", "data_engineering").when(F.col("o_orderstatus") == "F", "product").alias("role_track"),
        ((k % 4) * 30).cast("int").alias("fit_score"), none.alias("fit_explanation"), F.lit(None).cast("boolean").alias("watcher_eligible"), none.alias("watcher_ineligible_reason"),
        F.when(k % 2 == 0, "Intern").otherwise("Engineer").alias("title"), none.alias("internship_type"), (k % 11 - 2).cast("int").alias("deadline_days_left"),
    )


@query(GATE_SQL)
def watcher_gate(spark, sf):
    return with_gate(_gated(spark, sf)).select("k", F.col("gate.ineligible_reason").alias("reason"))


@query(f"SELECT k, CAST(k % 4 AS INTEGER) * 30 AS fit FROM ({GATE_SQL}) WHERE reason IS NULL AND k % 2 = 0 AND k % 11 >= 2 AND k % 4 * 30 >= 40")
def watcher_matches(spark, sf):
    return matches(_gated(spark, sf), least=40).select("k", F.col("gate.fit_score").alias("fit"))


def query_table() -> dict[str, object]:
    """All queries of this package, those of driver_queries too."""
    return QUERIES


def oracle_table() -> dict[str, str]:
    return ORACLES
