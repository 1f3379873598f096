"""Rules over one posting's text: gates, the kind of company, and the parts of its score that need no profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import clamp
from .text import C, col, company_key, text
from .wordings import first, has

# Wordings of internships, of what excludes them, and of seasons with a year.
_DASH = "[\\-‐‑‒–— ]"
NEW_GRADUATE = r"(?i)\bnew[- ]?grad(?:uate)?\b"
INTERNSHIP = rf"(?i)\b(?:intern|internship|co{_DASH}?op)\b"
SEASON_AND_YEAR = r"(?i)\b(?:spring|summer|fall|autumn|winter)[\s\-‐‑‒–—]+20\d{2}\b|\b20\d{2}[\s\-‐‑‒–—]+(?:spring|summer|fall|autumn|winter)\b"
PROFESSIONAL = r"(?i)\b(?:full[- ]?time|fulltime|entry[- ]?level|graduation date|expected graduation|graduating|graduate between|class of|degree completion)\b"


def is_internship(title: C = "title", kind: C = "internship_type") -> Column:
    """New graduates' postings aren't; those that say so are; a season with a year is, unless it is about graduation or full-time work."""
    said = F.concat(text(title), F.lit("\n"), text(kind))
    return F.when(said.rlike(NEW_GRADUATE), False).when(said.rlike(INTERNSHIP), True).otherwise(said.rlike(SEASON_AND_YEAR) & ~said.rlike(PROFESSIONAL))


def is_open(active: C = "active", days: C = "deadline_days_left") -> Column:
    """Only an explicit false closes; a deadline that is past does too."""
    return F.coalesce(col(active), F.lit(True)) & F.coalesce(col(days) >= 0, F.lit(True))


# What names, stacks, startups and other trades are called.
NAME_TOKENS = (
    "technolog", "software", "data", "cloud", "system", "labs", "lab", "platform", "digital", "analytics",
    "cyber", "robotic", "tech", "network", "compute", "intelligence", "quant", "soft", "byte", "dev",
)
AI_NAME = r"(\b[Aa][Ii]\b|(?<=[a-z])AI\b|\.ai\b)"
TECH = (
    r"\bapis?\b", r"\bpython\b", r"\bjava\b", r"\bgolang\b", r"\brust\b", r"\breact\b", r"\bnode(\.js)?\b", r"\bkubernetes\b", r"\bdocker\b",
    r"\baws\b", r"\bgcp\b", r"\bazure\b", r"\bsql\b", r"\bpostgres(ql)?\b", r"machine learning", r"\bsaas\b", r"\bplatform\b", r"infrastructure",
    r"\bbackend\b", r"\bfront[- ]?end\b", r"\bsdk\b", r"open[- ]source", r"\bllms?\b", r"data pipeline", r"\betl\b", r"microservice",
    r"\bdevops\b", r"ci/cd", r"\bterraform\b", r"\bsoftware\b", r"\balgorithms?\b",
)
STARTUP = (
    r"\bseed([- ]funded| round| stage)?\b", r"series [ab]\b", r"pre[- ]seed", r"\by ?combinator\b", r"\byc[- ]backed\b",
    r"\bfounding\b", r"early[- ]stage", r"\bstartup\b", r"\bstealth\b",
)
OTHER_TRADES = (
    r"\bbakery\b", r"\brestaurant\b", r"\bretail\b", r"\bboutique\b", r"\bsalon\b", r"staffing (agency|firm)", r"marketing agency",
    r"\blaw firm\b", r"real estate", r"\bhospitality\b", r"non[- ]?profit", r"senior living", r"\bcatering\b", r"event planning",
    r"\bwellness\b", r"property management", r"insurance agency",
)
TEAM = r"(?i)(\d{1,3})[- ]person team"


def hits(value: C, patterns: tuple[str, ...], low: C | None = None) -> Column:
    """What each pattern that matches matches first, in the patterns' order. low: the text in lower case, as a column."""
    found = F.array(*(F.trim(first(value, low, f"(?i){p}")) for p in patterns))
    return F.filter(found, lambda x: x != "")


def with_company_class(df: DataFrame, known_tech: tuple[str, ...] = (), known_other: tuple[str, ...] = (), technical: C | None = None, name: str = "company_class") -> DataFrame:
    """df with struct(category, confidence, is_startup, tech, startup, other): five layers, from known names to words of the posting.

    known_*: names in company_key form. technical: whether the role is, which keeps the employer from being ruled out.
    """
    context = F.concat_ws(" ", text("description"), text("requirements"), text("title"))
    df = df.withColumn("_context", context).withColumn("_named", F.concat_ws(" ", "_context", text("company"))).withColumns({"_low": F.lower("_context"), "_named_low": F.lower("_named")})
    team = first("_context", "_low", TEAM, 1).try_cast("int")
    df = df.withColumns({"_tech": hits("_context", TECH, "_low"), "_other": hits("_named", OTHER_TRADES, "_named_low"), "_start": hits("_context", STARTUP, "_low")})
    df = df.withColumn("_start", F.when(team <= 50, F.array_append("_start", first("_context", "_low", TEAM))).otherwise(F.col("_start")))
    n_tech, n_other, n_start = F.size("_tech"), F.size("_other"), F.size("_start")
    key, words = company_key("company"), F.split(F.lower(text("company")), "[^a-z0-9.]+")
    by_name = F.exists(words, lambda w: reduce(lambda x, y: x | y, (w.startswith(t) for t in NAME_TOKENS))) | text("company").rlike(AI_NAME)
    role = F.coalesce(col(technical), F.lit(False)) if technical is not None else F.lit(False)
    startup_or_tech = F.when(n_start > 0, "startup").otherwise("tech")
    layers = [
        (key.isin(*known_tech) if known_tech else F.lit(False), startup_or_tech, F.lit(0.95)),
        (key.isin(*known_other) if known_other else F.lit(False), F.lit("non_tech"), F.lit(0.9)),
        (by_name, startup_or_tech, F.when(n_tech >= 2, 0.8).otherwise(0.7)),
        (n_tech >= 3, startup_or_tech, F.when(n_start > 0, 0.62 + 0.03 * F.least(n_tech, F.lit(6))).otherwise(0.55 + 0.04 * F.least(n_tech, F.lit(8)))),
        ((n_other >= 1) & (n_tech <= 1) & ~role, F.lit("non_tech"), 0.55 + 0.05 * F.least(n_other, F.lit(5))),
        ((n_start > 0) & (n_other == 0), F.lit("startup"), 0.5 + 0.05 * F.least(n_start + n_tech, F.lit(6))),
        (role, F.lit("unknown"), F.lit(0.3)),
    ]
    category = F.coalesce(*(F.when(ok, c) for ok, c, _ in layers), F.lit("unknown"))
    confidence = F.bround(F.least(F.coalesce(*(F.when(ok, x) for ok, _, x in layers), F.lit(0.25)), F.lit(0.97)), 2)
    out = F.struct(category.alias("category"), confidence.alias("confidence"), (category == "startup").alias("is_startup"), F.col("_tech").alias("tech"), F.col("_start").alias("startup"), F.col("_other").alias("other"))
    return df.withColumn(name, out).drop("_context", "_named", "_low", "_named_low", "_tech", "_other", "_start")


# Costs and gains of flags, signals and hoops.
SEVERITY = {"critical": 30, "major": 12, "minor": 4}
LEARNING_GAINS = {"mentorship": 20, "ownership": 15, "conversion": 10, "structured_program": 8}
LEARNING_COSTS = {"grunt_work": 25, "no_learning_mention": 12, "founder_responsibilities": 10}
HOOPS = ((r"cover letter", 8), (r"take[- ]home|coding challenge|assessment", 8), (r"video (submission|introduction|essay)", 10), (r"\bessays?\b", 8), (r"\btranscript\b", 4), (r"(two|three|2|3) references", 5))
EASY = r"(?i)easy apply|apply with (your )?resume|resume only"


def _sum_of(items: C, key: str, amounts: dict[str, int]) -> Column:
    amount = lambda k: F.coalesce(*(F.when(k == name, F.lit(v)) for name, v in amounts.items()), F.lit(0))
    return F.aggregate(col(items), F.lit(0), lambda acc, x: acc + amount(x[key]))


def legitimacy(flags: C, signals: C, category: C, pay: C) -> Column:
    p = col(pay)
    bonus = F.when(F.exists(col(signals), lambda s: s["id"] == "reputable"), 12).otherwise(0) + F.when(col(category).isin("tech", "startup"), 6).when(col(category) == "unknown", -5).otherwise(0)
    return clamp(70 - _sum_of(flags, "severity", SEVERITY) + bonus + F.when((p["kind"] == "paid") & (p["confidence"] >= 0.5), 6).otherwise(0))


def learning(flags: C, signals: C) -> Column:
    return clamp(50 + _sum_of(signals, "id", LEARNING_GAINS) - _sum_of(flags, "id", LEARNING_COSTS))


def technical_depth(n_tools: C, software: C) -> Column:
    n = col(n_tools)
    score = F.when(n == 0, 30).when(n <= 2, 55).when(n <= 5, 75).when(n <= 8, 88).otherwise(95)
    return F.when(col(software), score).otherwise(F.least(score, F.lit(35)))


def effort(about: C, low: C | None = None) -> Column:
    cost = reduce(lambda x, y: x + y, (F.when(has(about, low, f"(?i){p}"), v).otherwise(0) for p, v in HOOPS))
    return clamp(70 - cost + F.when(has(about, low, EASY), 12).otherwise(0))
