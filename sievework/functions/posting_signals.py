"""Warnings and strengths of a posting as arrays of structs: each rule is a condition, a label and the words that it rests on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pay import hourly_mid
from .posting_rules import hits
from .text import C, col, company_key, text
from .wordings import first, has, labels_of

# Wordings of warnings.
FEE = r"(training|onboarding|application|registration|placement) fee|pay (a |an )?fee|\$\d+ (fee|deposit)|send (us )?payment"
NO_INTERVIEW = r"no interview|immediate hire|start (today|immediately) no"
OFF_PLATFORM = r"\bwhatsapp\b|\btelegram\b|text us at"
FOUNDER = (
    r"wear many hats", r"ground floor", r"build .{0,20}from scratch", r"like a (founder|co[- ]?founder)", r"no task (is )?too small",
    r"do whatever it takes", r"build (the|our) (mvp|company)", r"work directly with the (ceo|founders?)", r"hustle\b",
)
HOURS = r"nights and weekends|60\+?\s*hours|evenings? and weekends? required"
GRUNT = (
    r"data entry", r"cold[- ]call", r"door[- ]to[- ]door", r"\bfiling\b", r"run errands", r"fetch coffee", r"answer(ing)? phones",
    r"\brepetitive\b", r"enter(ing)? (supplier )?(invoices|data|receipts)",
)
LEARNING = r"\bmentor(ship|ing)?\b|\blearn(ing)?\b|\btraining\b|\bgrow(th)?\b|pair programming|1:1|intern (program|cohort)|workshops?"

# Wordings of strengths, tools and tracks.
BACKEND = r"\bback[- ]?end\b|\bapis?\b|\bdatabases?\b|\bdistributed\b|\binfrastructure\b|\bpipelines?\b|\bserver[- ]side\b"
OWNERSHIP = r"\bown(ership)? (a|an|the|your)\b|end[- ]to[- ]end|ship (a |an |your |real )?(feature|project|code|product)|your own project|lead a project"
CONVERSION = r"return offer|full[- ]time (offer|conversion|role)|new[- ]grad pipeline|convert to full[- ]time"
STRUCTURED = r"\b(8|10|12|16)[- ]week\b|summer (intern(ship)? )?program|structured (intern(ship)? )?program|intern cohort|cohort"
TOOLS = (
    "python", "java", "c++", "golang", "go", "rust", "javascript", "typescript", "react", "node", "flask", "django", "fastapi", "spring", "sql",
    "postgres", "postgresql", "mysql", "mongodb", "redis", "kafka", "spark", "airflow", "dbt", "pandas", "numpy", "scikit-learn", "pytorch",
    "tensorflow", "kubernetes", "docker", "terraform", "aws", "gcp", "azure", "linux", "git", "graphql", "rest", "grpc", "ros", "snowflake",
)
SOFTWARE_TRACKS = ("backend", "full_stack", "frontend", "general_swe", "platform_infra", "data_engineering", "ml_ai", "quant_dev", "cloud", "devops", "embedded_software", "firmware", "sdet_qa_automation")
BACKEND_TRACKS = ("backend", "full_stack", "general_swe", "platform_infra", "data_engineering", "ml_ai", "quant_dev")

FLAG = "array<struct<id:string,label:string,severity:string,evidence:string>>"
SIGNAL = "array<struct<id:string,label:string,strength:int,evidence:string>>"


def _tool_pattern(t: str) -> str:
    if t == "go":
        return r" go |\bgolang\b"
    if t == "rest":
        return r"\brest(ful)?\b"
    return rf"(?<![a-z0-9]){re.escape(t)}" + (r"(?![a-z0-9])" if t[-1].isalnum() else "")


def padded(value: C) -> Column:
    """What tools() reads, to be made a column first: else it is built once for each tool."""
    return F.concat(F.lit(" "), F.lower(text(value)), F.lit(" "))


def tools(value: C, low: C | None = None) -> Column:
    """Names of tools in a text, sorted. low: the padded() text, as a column."""
    return F.array_sort(labels_of(padded(value) if low is None else low, [(t, _tool_pattern(t)) for t in TOOLS], low))


def skills(value: C, known: tuple[str, ...], low: C | None = None) -> Column:
    """The known skills that a text names, in their order; a space in one may be a dash, and it may end with s. low: the text in lower case, as a column."""
    c = F.lower(text(value)) if low is None else col(low)
    pattern = lambda s: r"\b" + re.escape(s.lower()).replace(r"\ ", r"[\s-]") + r"s?\b"
    return labels_of(c, [(s, pattern(s)) for s in known], low)


def _said(c: C, pattern: str, low: C) -> Column:
    """What a pattern matches first, null if nothing."""
    return F.nullif(first(c, low, f"(?i){pattern}"), F.lit(""))


def _struct(kind: str, cond: Column, name: str, label: Column | str, weight: Column | str | int, evidence: Column) -> Column:
    field = "severity" if kind == "flag" else "strength"
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(cond, F.struct(F.lit(name).alias("id"), lit(label).alias("label"), lit(weight).alias(field), evidence.alias("evidence")))


def with_flags(df: DataFrame, pay: str = "pay", role: str = "role", name: str = "red_flags") -> DataFrame:
    """df with its warnings, in a fixed order. Texts that several rules read are columns of their own, so each is built once."""
    about = F.concat_ws(" ", text("description"), text("requirements"), text("compensation"))
    df = df.withColumns({"_about": about, "_needs": padded("requirements")})
    df = df.withColumns({"_low": F.lower("_about"), "_titled": F.concat_ws(" ", text("title"), "_about")}).withColumn("_titled_low", F.lower("_titled"))
    df = df.withColumns({"_tools": tools("requirements", "_needs"), "_founder": hits("_about", FOUNDER, "_low"), "_grunt": hits("_titled", GRUNT, "_titled_low"), "_learns": has("_about", "_low", f"(?i){LEARNING}")})
    df = df.withColumns({f"_said_{k}": _said("_about", pattern, "_low") for k, pattern in (("fee", FEE), ("at_once", NO_INTERVIEW), ("off", OFF_PLATFORM), ("hours", HOURS))})
    p, mid = F.col(pay), hourly_mid(pay)
    years = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text("requirements"), F.lit(r"(?i)(\d+)\s*\+?\s*years?"), F.lit(1)), lambda y: y.try_cast("int"))), F.lit(0))
    kind, raw, n = p["kind"], p["raw"], F.size("_tools")
    shown = lambda c, k: F.array_join(F.slice(c, 1, k), "; ")
    flag = lambda *args: _struct("flag", *args)
    grunt = (F.size("_grunt") > 0) & ~F.col("_learns")
    rules = [
        flag(F.col("_said_fee").isNotNull(), "scam_fee", "Asks applicants to pay a fee", "critical", F.col("_said_fee")),
        flag(F.col("_said_at_once").isNotNull(), "no_interview", "“No interview / immediate hire” hiring", "major", F.col("_said_at_once")),
        flag(F.col("_said_off").isNotNull(), "offplatform_recruiting", "Recruiting via WhatsApp/Telegram", "major", F.col("_said_off")),
        flag(kind == "unpaid", "unpaid", "Unpaid position", "major", F.when(raw != "", raw).otherwise("unpaid")),
        flag(kind == "equity_only", "equity_only", "Equity-only compensation", "major", raw),
        flag(kind == "commission_only", "commission_only", "Commission-only pay", "major", raw),
        flag(kind.isin("unknown_vague", "unknown", "stipend_unspecified"), "vague_comp", "Compensation unclear or unstated", "minor", F.when(raw != "", raw).otherwise("(blank)")),
        flag((kind == "paid") & (mid < 7.5) & (p["confidence"] >= 0.4), "very_low_pay", "Pay works out below US minimum wage", "minor", F.concat(F.lit("~$"), F.format_number(mid, 2), F.lit("/hr equivalent ("), raw, F.lit(")"))),
        flag(years >= 3, "unrealistic_experience", F.concat(F.lit("Asks for "), years, F.lit("+ years of experience from an intern")), "major", F.concat(years, F.lit("+ years in requirements"))),
        flag(F.size("_founder") >= 2, "founder_responsibilities", "Founder-level responsibilities pitched as an internship", "major", shown("_founder", 3)),
        flag(n > 10, "laundry_list", F.concat(F.lit("Requirements list "), n, F.lit(" technologies")), "minor", F.array_join(F.slice("_tools", 1, 12), ", ")),
        flag(F.col("_said_hours").isNotNull(), "excessive_hours", "Excessive hours expected", "major", F.col("_said_hours")),
        flag(grunt, "grunt_work", "Busywork with no stated learning component", "major", shown("_grunt", 3)),
        flag(~grunt & (text("description") != "") & ~F.col("_learns") & col(role).isin("non_technical", "it", "unknown"), "no_learning_mention", "No mention of mentorship or learning", "minor", F.lit("description")),
    ]
    return df.withColumn(name, F.array_compact(F.array(*rules)).cast(FLAG)).drop("_about", "_needs", "_low", "_titled", "_titled_low", "_tools", "_founder", "_grunt", "_learns", "_said_fee", "_said_at_once", "_said_off", "_said_hours")


def with_signals(df: DataFrame, known_skills: tuple[str, ...] = (), reputable: tuple[str, ...] = (), least_pay: float = 15, pay: str = "pay", track: str = "role_track", startup: C = "company_class.is_startup", name: str = "positive_signals") -> DataFrame:
    """df with its strengths, in a fixed order."""
    about = F.concat_ws(" ", text("description"), text("requirements"))
    df = df.withColumn("_about", about)
    df = df.withColumns({"_low": F.lower("_about"), "_padded": padded("_about"), "_all": F.concat_ws(" ", text("title"), "_about"), "_titled": F.concat_ws(" ", "_about", text("title"))})
    df = df.withColumns({"_all_low": F.lower("_all"), "_titled_low": F.lower("_titled")})
    df = df.withColumns({"_tools": tools("_about", "_padded"), "_skills": skills("_about", known_skills, "_low")})
    df = df.withColumns({f"_said_{k}": _said(of, pattern, low) for k, of, pattern, low in (("own", "_about", OWNERSHIP, "_low"), ("learn", "_about", LEARNING, "_low"), ("offer", "_about", CONVERSION, "_low"), ("program", "_titled", STRUCTURED, "_titled_low"), ("backend", "_all", BACKEND, "_all_low"))})
    p, mid, software = F.col(pay), hourly_mid(pay), F.coalesce(col(track).isin(*SOFTWARE_TRACKS), F.lit(False))
    paid, n = (p["kind"] == "paid") & mid.isNotNull(), F.size("_skills")
    rate = F.concat(F.lit(" (~$"), F.bround(mid, 0).cast("int"), F.lit("/hr equivalent)"))
    signal = lambda *args: _struct("signal", *args)
    rules = [
        signal(paid & (mid >= 30), "paid_well", F.concat(F.lit("Strong pay"), rate), 3, p["raw"]),
        signal(paid & (mid < 30) & (mid >= least_pay), "paid", F.concat(F.lit("Paid"), rate), 2, p["raw"]),
        signal(software & (n >= 2), "stack_match", "Tech stack overlaps your experience", 3, F.array_join(F.slice("_skills", 1, 6), ", ")),
        signal(software & (n == 1), "stack_match", "Some stack overlap with your experience", 1, F.get("_skills", F.lit(0))),
        signal(F.col("_said_own").isNotNull(), "ownership", "Clear project ownership", 2, F.col("_said_own")),
        signal(F.col("_said_learn").isNotNull(), "mentorship", "Mentorship / learning emphasized", 2, F.col("_said_learn")),
        signal(F.col("_said_offer").isNotNull(), "conversion", "Return-offer / full-time pipeline", 2, F.col("_said_offer")),
        signal(F.col("_said_program").isNotNull(), "structured_program", "Structured internship program", 1, F.col("_said_program")),
        signal(company_key("company").isin(*reputable) if reputable else F.lit(False), "reputable", "Well-known employer", 2, text("company")),
        signal(software & (F.size("_tools") >= 3), "specific_tech", "Names a concrete technical stack", 2, F.array_join(F.slice("_tools", 1, 6), ", ")),
        signal(F.coalesce(col(track).isin(*BACKEND_TRACKS), F.lit(False)) & F.col("_said_backend").isNotNull(), "backend_focus", "Backend / data infrastructure focus", 2, F.col("_said_backend")),
        signal(F.coalesce(col(startup), F.lit(False)), "startup_env", "Startup environment (matches your interest)", 1, F.lit("")),
    ]
    return df.withColumn(name, F.array_compact(F.array(*rules)).cast(SIGNAL)).drop("_about", "_low", "_padded", "_all", "_titled", "_all_low", "_titled_low", "_tools", "_skills", "_said_own", "_said_learn", "_said_offer", "_said_program", "_said_backend")


def top_labels(items: C, weight: str, most: int = 3) -> Column:
    """The labels of the heaviest items, each once; equal ones in their order."""
    ranked = F.array_sort(F.transform(col(items), lambda x, i: F.struct((-x[weight]).alias("w"), i.alias("i"), x["label"].alias("label"))))
    return F.slice(F.array_distinct(F.transform(ranked, lambda x: x["label"])), 1, most)
