"""How well a posting fits a profile: relevance of the role, place, skills and interests."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .posting_signals import skills
from .scores import clamp
from .text import C, col, text
from .wordings import has, labels_of


@dataclass(frozen=True)
class Profile:
    """What a reader of postings looks for. affinity: from 0 to 100 for each track; tracks without one fall back on their role's."""

    skills: tuple[str, ...] = ()
    interests: tuple[str, ...] = ()
    track_affinity: dict[str, int] = field(default_factory=dict)
    role_affinity: dict[str, int] = field(default_factory=dict)
    preferred_locations: tuple[str, ...] = ()
    least_pay: float = 15
    reputable: tuple[str, ...] = ()
    known_tech: tuple[str, ...] = ()
    known_other: tuple[str, ...] = ()


# Affinities that hold where a profile says nothing.
TRACK_AFFINITY = {
    "backend": 82, "full_stack": 80, "data_engineering": 78, "ml_ai": 76, "general_swe": 74, "platform_infra": 72, "quant_dev": 72, "frontend": 68,
    "cloud": 62, "devops": 58, "embedded_software": 55, "firmware": 50, "sdet_qa_automation": 50, "it_support": 20, "quality_test": 20,
    "solutions_engineering": 20, "product": 0, "customer_experience": 0, "electrical_hardware": 0, "mechanical_manufacturing": 0,
    "civil_structural": 0, "factory_automation": 0, "other_engineering": 0, "non_technical": 0, "unknown": 0,
}
ROLE_AFFINITY = {"swe": 90, "data_science": 90, "ml_ai": 95, "quant": 85, "product": 55, "it": 35, "non_technical": 10, "unknown": 40}

# Tracks by how they are scored.
FIT_TRACKS = ("backend", "full_stack", "frontend", "general_swe", "platform_infra", "data_engineering", "ml_ai", "quant_dev", "cloud", "devops", "embedded_software", "firmware", "sdet_qa_automation")
LOW_TRACKS = ("it_support", "quality_test", "solutions_engineering")
BEST_TRACKS = ("backend", "full_stack", "data_engineering", "ml_ai", "general_swe")

# Skills with their wordings, small gains (label, wording, gain).
STRONG_SKILLS = (
    ("Python", r"(?i)\bpython\b"), ("Java", r"(?i)\bjava\b(?!\s*script)"), ("SQL", r"(?i)\bsql\b"), ("JavaScript", r"(?i)\bjava\s*script\b|\bjavascript\b|\bjs\b"),
    ("TypeScript", r"(?i)\btype\s*script\b|\btypescript\b|\bts\b"), ("FastAPI", r"(?i)\bfastapi\b|fast api"), ("Flask", r"(?i)\bflask\b"),
    ("SQLAlchemy", r"(?i)\bsqlalchemy\b|sql alchemy"), ("Next.js", r"(?i)\bnext\.?js\b"), ("React", r"(?i)\breact(?:\.js)?\b"), ("Pandas", r"(?i)\bpandas\b"),
    ("PostgreSQL", r"(?i)\bpostgres(?:ql)?\b"), ("SQLite", r"(?i)\bsqlite\b"),
    ("REST/API/backend service work", r"(?i)\brest(?:ful)?\b|\bapis?\b|\bback[- ]?end\b|\bserver[- ]side\b|\bservices?\b|\bmicroservices?\b"),
    ("data ingestion/pipelines", r"(?i)\bdata ingestion\b|\betl\b|\bdata pipelines?\b|\bmarket data pipelines?\b|\bpipelines?\b"),
    ("data analytics", r"(?i)\bdata analy(tics|sis)\b|\banalytics\b"), ("spreadsheet/data apps", r"(?i)\bspreadsheet\b|\bdata apps?\b|\bdashboards?\b"),
    ("full-stack web apps", r"(?i)\bfull[- ]?stack\b|\bweb apps?\b"), ("Pytest/testing/evals", r"(?i)\bpytest\b|\btesting\b|\bunit tests?\b|\bevals?\b|\bevaluations?\b"),
)
SMALL_GAINS = (
    ("Git/GitHub", r"(?i)\bgit\b|\bgithub\b"), ("OpenAI API/LLM app work", r"(?i)\bopenai api\b|\bllm\b|\blarge language model"),
    ("Vercel/Render deployment", r"(?i)\bvercel\b|\brender\b|\bdeploy(ment|ed)?\b"), ("finance/data app relevance", r"(?i)\bfinance\b|\bmarket data\b|\btrading data\b|\bspreadsheet\b|\bdata apps?\b"),
)
SMALL_GAIN, MOST_SMALL, SKILL_GAIN, MOST_SKILL = 2, 6, 4, 16
# Wordings that costs and limits rest on.
BACKEND = r"(?i)\bback[- ]?end\b|\bserver[- ]side\b|\bapis?\b|\brest(ful)?\b|\bservices?\b|\bmicroservices?\b|\bdistributed systems?\b|\bdatabases?\b|\bsql\b|\bpostgres(ql)?\b|\bmysql\b|\bspring\b"
PRODUCTION = r"(?i)production code|code review|ship (real )?(code|features?)|own .*service|building services?"
OWNERSHIP = r"(?i)developer tooling|automation code|platform services?|cloud APIs?|software ownership"
CORE_STACK = r"(?i)\bpython\b|\bjava\b(?!\s*script)|\bsql\b|\bjavascript\b|\btypescript\b|\bfastapi\b|\bflask\b|\bsqlalchemy\b|\breact\b|\bnext\.?js\b|\bpandas\b|\bpostgres(?:ql)?\b|\bsqlite\b"
CPLUS = r"(?i)\bc\+\+\b|\bcpp\b"
GO_RUST = r"(?i:\bgolang\b|\brust\b)|\b(?:Go|GO)\b"
LOW_LEVEL = r"(?i)low[- ]level|kernel|driver|firmware|embedded|robotics?|hardware|electrical|mechanical|manufactur|cad\b"
OPERATIONS = r"(?i)\bsre\b|site reliability|on[- ]call|incident|ci/cd|terraform|kubernetes|cloud operations?|infrastructure operations?"
PRODUCT_WORK = r"(?i)product feature|user-facing feature|backend product|application|apis?|services?|platform services?"
REPORTING = r"(?i)\banalytics\b|\breporting\b|\breports?\b|\bdashboards?\b|business intelligence"
DATA_WORK = r"(?i)data engineer|pipeline|etl|software|python|sql|pandas|model|machine learning|ml\b|api"
VAGUE_TITLE = r"(?i)\btechnical intern\b|\btechnical co[- ]?op\b"
COMMERCIAL = r"(?i)commercial|customer[- ]facing|customer support|technical support|solutions?|sales|pre[- ]?sales|implementation consultant"
INTERESTS = {
    "backend": r"back[- ]?end|api|infrastructure|server", "data science": r"data scien|analytics|data analy", "ml/ai": r"machine learning|\bml\b|\bai\b|deep learning",
    "quant": r"quant|trading", "startup engineering": r"startup|seed|founding|early[- ]stage",
}
ABROAD = r"india|bengaluru|bangalore|london|berlin|toronto|singapore"


def affinity(role: C, profile: Profile) -> Column:
    r = col(role)
    tracks, roles = profile.track_affinity or TRACK_AFFINITY, profile.role_affinity or ROLE_AFFINITY
    of = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return F.coalesce(of(tracks, r["role_track"]), of(roles, r["role"]), F.lit(0))


def ineligible_reason(role: C, profile: Profile) -> Column:
    """Why a role is outside what the profile looks for; null if it isn't."""
    r = col(role)
    unknown = F.lit("Role lacks strong software/backend/data/ML/quant evidence for the SWE watcher.")
    return F.when(affinity(role, profile) > 0, None).when(r["role_track"] == "unknown", unknown).otherwise(F.concat(r["role_track_label"], F.lit(" role outside the target SWE/software-adjacent watcher track.")))


def with_fit(df: DataFrame, profile: Profile, role: str = "role_class", name: str = "fit") -> DataFrame:
    """df with struct(score, explanation) of title, description and requirements: affinity, gains for skills, costs, limits.

    What several of them read is a column of its own, so no pattern runs twice on a text.
    """
    r = col(role)
    track, base = r["role_track"], affinity(role, profile)
    df = df.withColumn("_all", F.concat_ws(" ", text("title"), text("description"), text("requirements")))
    df = df.withColumn("_low", F.lower("_all"))
    says = lambda pattern: has("_all", "_low", pattern)
    df = df.withColumns({"_strong": labels_of("_all", STRONG_SKILLS, "_low"), "_small": labels_of("_all", SMALL_GAINS, "_low"), "_core": says(CORE_STACK)})
    strong, small, core = F.col("_strong"), F.col("_small"), F.col("_core")
    # Costs, each with its condition and its words.
    costs = (
        (says(CPLUS) & ~core, 6, "C++ stack with no Python/Java/SQL/JS/TS overlap"),
        (says(GO_RUST) & ~core, 8, "Go/Rust stack with no Python/Java/SQL/JS/TS overlap"),
        (says(LOW_LEVEL) | track.isin("embedded_software", "firmware"), 10, "low-level/embedded/hardware-heavy context"),
        (track.isin("devops", "cloud") & says(OPERATIONS) & ~says(PRODUCT_WORK), 10, "ops/cloud/SRE work without backend product development"),
        (says(REPORTING) & ~says(DATA_WORK), 8, "analytics/reporting without data-engineering or software evidence"),
        (text("title").rlike(VAGUE_TITLE) & (F.size(strong) < 2), 12, "vague technical title with unclear software duties"),
        (says(COMMERCIAL), 15, "commercial/customer-facing/support orientation"),
        (F.coalesce(r["confidence"], F.lit(1.0)) < 0.5, 10, "low classification confidence"),
    )
    df = df.withColumn("_costs", F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("n"), F.lit(f"{words} (-{n})").alias("said"))) for c, n, words in costs))))
    cost, said = F.aggregate("_costs", F.lit(0), lambda acc, x: acc + x["n"]), F.col("_costs.said")
    gained = F.when(track.isin(*FIT_TRACKS), F.least(F.size(strong) * SKILL_GAIN, F.lit(MOST_SKILL))).otherwise(0) + F.least(F.size(small) * SMALL_GAIN, F.lit(MOST_SMALL))
    whole = base + gained - cost
    near = track.isin(*BEST_TRACKS) & (F.size(strong) >= 4)
    df = df.withColumn("_score", clamp(F.when((whole > 94) & ~near, 94).otherwise(whole)).cast("int"))
    score = F.col("_score")
    # the explanation
    more = F.when(F.size(strong) > 5, F.concat(F.lit(", plus "), F.size(strong) - 5, F.lit(" more"))).otherwise("")
    overlap = F.when(F.size(strong) > 0, F.concat(r["role_track_label"], F.lit(" with resume overlap in "), F.array_join(F.slice(strong, 1, 5), ", "), more)).otherwise(F.concat(r["role_track_label"], F.lit(", but limited direct resume stack overlap")))
    details = F.concat_ws(
        "; ",
        overlap,
        F.when(F.size(small) > 0, F.concat(F.lit("smaller positives: "), F.array_join(F.slice(small, 1, 3), ", "))),
        F.when(F.size(said) > 0, F.concat(F.lit("penalties: "), F.array_join(F.slice(said, 1, 3), "; "))),
        F.when(score >= 95, "near-perfect fit requires multiple direct resume matches"),
    )
    unowned = track.isin("cloud", "devops") & ~(says(BACKEND) | says(PRODUCTION) | says(OWNERSHIP))
    as_struct = lambda s, e: F.struct(s.cast("int").alias("score"), e.alias("explanation"))
    out = (
        F.when(base <= 0, as_struct(F.lit(0), ineligible_reason(role, profile)))
        .when(unowned, as_struct(F.lit(0), F.concat(r["role_track_label"], F.lit(" title lacks clear coding/backend/platform software ownership."))))
        .when(track.isin(*LOW_TRACKS), as_struct(F.least(base, F.lit(20)), F.concat(r["role_track_label"], F.lit(" is visible as a low-priority adjacent track, capped at 20."))))
        .otherwise(as_struct(score, F.concat(details, F.lit("."))))
    )
    return df.withColumn(name, out).drop("_all", "_low", "_strong", "_small", "_core", "_costs", "_score")


def place(profile: Profile, location: C = "location", remote: C = "remote_status") -> Column:
    """struct(score, explanation) of where the work is."""
    at, how, shown = F.lower(text(location)), F.lower(text(remote)), text(location)
    liked = reduce(lambda a, b: a | b, (F.contains(at, F.lit(p)) for p in profile.preferred_locations), F.lit(False))
    out = lambda score, *words: F.struct(F.lit(score).alias("score"), F.concat(*(w if isinstance(w, Column) else F.lit(w) for w in words)).alias("explanation"))
    hybrid = F.contains(how, F.lit("hybrid"))
    return (
        F.when(F.contains(how, F.lit("remote")) | (F.trim(at) == "remote"), out(100, "Remote — works from anywhere."))
        .when(hybrid & liked, out(85, "Hybrid in a preferred area (", shown, ")."))
        .when(hybrid, out(60, "Hybrid in ", F.when(shown == "", "an unstated location").otherwise(shown), "."))
        .when(liked, out(75, "On-site in a preferred area (", shown, ")."))
        .when(at == "", out(60, "Location not stated."))
        .when(at.rlike(ABROAD), out(30, "On-site outside the US (", shown, ")."))
        .otherwise(out(50, "On-site in ", shown, " — outside your preferred areas."))
    )


def with_matched(df: DataFrame, profile: Profile, name: str = "profile_match") -> DataFrame:
    """df with struct(matched_skills, matched_interests, summary); each text is a column of its own, so it is built once."""
    df = df.withColumns({"_blob": F.concat_ws(" ", text("title"), text("description")), "_all": F.lower(F.concat_ws(" ", text("title"), text("description"), text("requirements")))})
    df = df.withColumn("_low", F.lower("_blob"))
    have = skills("_all", profile.skills, "_all")
    liked = labels_of("_blob", [(i, "(?i)" + INTERESTS.get(i, re.escape(i))) for i in profile.interests], "_low")
    n, two = F.size(have), F.array_join(F.slice(liked, 1, 2), ", ")
    summary = (
        F.when((n > 0) & (F.size(liked) > 0), F.concat(F.lit("Matches your "), two, F.lit(" interest and uses "), n, F.lit(" of your skills.")))
        .when(n > 0, F.concat(F.lit("Uses "), n, F.lit(" of your skills: "), F.array_join(F.slice(have, 1, 4), ", "), F.lit(".")))
        .when(F.size(liked) > 0, F.concat(F.lit("Aligned with your interest in "), two, F.lit(".")))
        .otherwise("Little overlap with your stated skills and interests.")
    )
    return df.withColumn(name, F.struct(have.alias("matched_skills"), liked.alias("matched_interests"), summary.alias("summary"))).drop("_blob", "_all", "_low")
