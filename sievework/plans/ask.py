"""Questions in plain words over scored postings: interpret() reads a question into a plan, run_plan() lowers it to DataFrame operations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 10

# Wordings of intents, roles and filters, in the order in which they are tried; words that carry no meaning.
INTENTS = (
    ("exploitative", r"exploit|sketchy|scam|red.?flag|avoid|shady|suspicious|predatory"),
    ("apply_tonight", r"tonight|apply now|asap|right away|immediately|urgent|due soon|closing soon"),
    ("startups", r"start.?ups?\b"),
)
ROLES = (
    ("backend", r"\bback.?end\b|\bapis?\b|\bserver.?side\b"),
    ("quant", r"\bquant(itative)?\b|\btrading\b"),
    ("ml_ai", r"\bml\b|machine learning|\ba\.?i\.?\b|artificial intelligence|deep learning"),
    ("data_science", r"data scien|data analy|\bdata\b"),
    ("swe", r"\bsoftware\b|\bswe\b|\bengineering\b|\bdevelop(er|ment)\b|full.?stack"),
    ("product", r"\bproduct\b|\bpm\b"),
    ("it", r"\bit support\b|\bhelp.?desk\b"),
)
BEST = r"\bbest\b|\btop\b|\bgood\b|\brecommend|\bstrongest\b|\bshow\b|\blist\b|\bwhich\b|\bfind\b"
PAID, UNPAID, REMOTE = r"\bpaid\b", r"\bunpaid\b|\bfree labor\b", r"\bremote\b|work from home|\bwfh\b"
BACKEND_TRACKS = ("backend", "full_stack", "platform_infra", "data_engineering")
STOP_WORDS = frozenset(
    """the a an which what who show me ones one are is do does should i to for of in on only internships internship
    postings posting jobs job roles role companies company look like seem actual best good any all list find with that and or my""".split()
)


@dataclass(frozen=True)
class Plan:
    question: str
    intent: str
    role: str | None = None
    want_backend: bool = False
    paid_only: bool = False
    unpaid_only: bool = False
    remote_only: bool = False
    keywords: tuple[str, ...] = field(default=())


def interpret(question: str | None) -> Plan:
    q = (question or "").strip()
    says = lambda p: re.search(p, q, re.I) is not None
    if not q:
        return Plan("", "help")
    role = next((r for r, p in ROLES if says(p)), None)
    mods = {"paid_only": says(PAID), "unpaid_only": says(UNPAID), "remote_only": says(REMOTE)}
    if role == "backend":
        mods |= {"role": "swe", "want_backend": True}
    elif role:
        mods["role"] = role
    intent = next((i for i, p in INTENTS if says(p)), None)
    if intent is None and (role or any(v is True for v in mods.values()) or says(BEST)):
        intent = "best_for_role"
    words = () if intent else tuple(w for w in re.findall(r"[a-z0-9+#.]+", q.lower()) if w not in STOP_WORDS)
    return Plan(q, intent or ("keyword" if words else "help"), keywords=words, **mods)


def _signal(name: str) -> Column:
    return F.exists("positive_signals", lambda s: s["id"] == name)


def _flags(severity: str) -> Column:
    return F.size(F.filter("red_flags", lambda f: f["severity"] == severity))


def filters(plan: Plan) -> list[tuple[str, Column]]:
    """(label, condition) of the plan's filters."""
    kind = F.col("compensation.kind")
    out = []
    if plan.paid_only:
        out.append(("paid roles only", kind.isin("paid", "stipend_unspecified")))
    if plan.unpaid_only:
        out.append(("unpaid roles only", kind == "unpaid"))
    if plan.remote_only:
        out.append(("remote only", F.lower("remote_status") == "remote"))
    if plan.want_backend:
        out.append(("role: backend-adjacent software/data roles", F.col("role_track").isin(*BACKEND_TRACKS) | _signal("backend_focus")))
    elif plan.role:
        out.append((f"role: {plan.role.replace('_', ' ')}", F.col("role") == plan.role))
    return out


def run_plan(plan: Plan, jobs: DataFrame) -> DataFrame:
    """id, company, title, score, action, headline and matched (postings that the intent matches) of the first ten, in rank order.

    jobs: the scored schema with a unique pos, which decides ties as the input's order does. Only the
    ranked ten leave the executors; matched is counted by a window over the matching rows' one aggregate.
    """
    for _, c in filters(plan):
        jobs = jobs.where(c)
    total, days = F.col("total"), F.col("deadline_days_left")
    first_reason = F.coalesce(F.try_element_at("reasons", F.lit(1)), F.col("action_label"))
    if plan.intent == "exploitative":
        jobs = jobs.where((_flags("critical") > 0) | (_flags("major") > 0))
        order = [_flags("critical").desc(), _flags("major").desc(), total.asc()]
        bad = F.filter("red_flags", lambda f: f["severity"].isin("critical", "major"))
        headline = F.array_join(F.slice(F.transform(bad, lambda f: f["label"]), 1, 2), "; ")
    elif plan.intent == "apply_tonight":
        jobs = jobs.where((F.col("action") == "apply_now") | (days.between(0, 7) & (total >= 55)))
        order = [F.coalesce(days, F.lit(999)).asc(), total.desc()]
        when = F.when(days.isNull(), "no hard deadline").otherwise(F.concat(F.lit("deadline in "), days, F.when(days == 1, " day").otherwise(" days")))
        headline = F.concat_ws(" - ", when, first_reason)
    elif plan.intent == "startups":
        jobs = jobs.where(F.col("is_startup") | _signal("startup_env"))
        own = Window.partitionBy(F.lower(F.trim(F.coalesce("company", F.lit(""))))).orderBy(total.desc(), F.col("pos"))
        jobs = jobs.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")
        order = [total.desc()]
        told = F.filter("company_evidence", lambda e: F.lower(e).rlike("startup|team|seed"))
        headline = F.coalesce(F.try_element_at(told, F.lit(1)), F.lit("Startup language in the posting"))
    elif plan.intent == "keyword":
        blob = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("company", "title", "description", "requirements"))))
        hits = sum((F.contains(blob, F.lit(k)).cast("int") for k in plan.keywords), F.lit(0))
        jobs = jobs.withColumn("_hits", hits).where("_hits > 0")
        order, headline = [F.desc("_hits"), total.desc()], first_reason
    elif plan.intent == "best_for_role":
        rank = F.col("role_relevance") + F.col("technical_depth") + 0.5 * total
        if plan.want_backend:
            rank = rank + F.when(_signal("backend_focus"), 15).otherwise(0)
        order, headline = [rank.desc()], first_reason
    else:
        jobs, order, headline = jobs.limit(0), [F.col("pos")], F.lit("")
    matched = jobs.agg(F.count(F.lit(1)).alias("matched"))
    ten = jobs.orderBy(*order, F.col("pos")).limit(MOST).select("id", "company", "title", total.alias("score"), "action", headline.alias("headline"))
    return ten.crossJoin(F.broadcast(matched))


def ask(question: str, jobs: DataFrame) -> DataFrame:
    return run_plan(interpret(question), jobs)


def list_jobs(jobs: DataFrame, bucket: str | None = None, role: str | None = None, action: str | None = None, paid_only: bool = False, remote_only: bool = False, min_score: int | None = None, q: str | None = None) -> DataFrame:
    """jobs that pass all given filters; q is looked for in company, title and location."""
    for column, value in (("bucket", bucket), ("role", role), ("action", action)):
        if value:
            jobs = jobs.where(F.col(column) == value)
    if paid_only:
        jobs = jobs.where(F.col("compensation.kind").isin("paid", "stipend_unspecified"))
    if remote_only:
        jobs = jobs.where(F.lower("remote_status") == "remote")
    if min_score is not None:
        jobs = jobs.where(F.col("total") >= min_score)
    if q:
        some = F.lit(False)
        for c in ("company", "title", "location"):
            some = some | F.contains(F.lower(c), F.lit(q.lower()))
        jobs = jobs.where(some)
    return jobs
