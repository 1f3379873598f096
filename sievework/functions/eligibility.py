"""Which students a posting is open to: wordings that close it to others, looked for in the evidence it gives.

A posting stays open unless a structured field, its title, a requirement or its description closes it in so many words.
What is preferred, negated or open to several groups closes nothing. Missing and empty texts are no evidence, so such
postings are open; texts of any length are read whole; equal rows get equal answers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import C, bounded, col, text

# Terms for degrees and years.
PHD = r"(?:phd|doctoral|doctorate|post[- ]?doctoral|post[- ]?doc)"
MASTERS = r"(?:master(?:'s|s)|ms|master of (?:science|arts)|master(?=\s+(?:degree|program|students?|candidates?)\b))"
GRADUATE = (
    r"(?:graduate (?:degree|program|student|students|candidate|candidates)|"
    + MASTERS + r"(?: degree| program| student| students| candidate| candidates)?|"
    r"mba(?: degree| program| student| students| candidate| candidates)?|"
    r"jd(?: degree| program| student| students| candidate| candidates)?|"
    r"juris doctor(?: degree| program| student| students| candidate| candidates)?|"
    r"law (?:degree|school|student|students|candidate|candidates)|"
    r"advanced[- ]degree(?: program| student| students| candidate| candidates)?|"
    r"post[- ]?baccalaureate(?: program| student| students)?|"
    r"postgraduate(?: degree| program| student| students)?)"
)
UNDERGRADUATE = r"(?:undergraduate|undergrad|bachelor(?:'s|s)?|baccalaureate|associate(?:'s|s)? degree|\bbs\b|\bba\b)"
FIRST_YEAR = r"(?:freshman|freshmen|college freshman|college freshmen|first[- ]year (?:college )?student|first[- ]year (?:college )?students)"
LATER_YEAR = r"(?:sophomore|sophomores|second[- ]year (?:college )?student|second[- ]year (?:college )?students|junior|juniors|senior|seniors)"
RISING = r"rising sophomores?"
INTERNSHIP = r"(?:intern|internship|co[- ]?op)"
JOINED = r"(?:\b(?:and|or|and/or)\b|/|;)"

# Wordings that make a term, @ here, a condition.
DEGREE_CONDITIONS = (
    r"\bcurrently (?:pursuing|enrolled in)\b.{0,70}\b@\b",
    r"\b(?:must|required to|is required to)\b.{0,70}\b(?:pursue|be enrolled|hold|have)\b.{0,40}\b@\b",
    r"\b@\b.{0,35}\b(?:students?|candidates?)\b.{0,20}\bonly\b",
    r"\b(?:minimum|required) (?:degree|education|qualification)\b.{0,35}\b@\b",
)
PHD_CONDITIONS = (
    r"\b(?:must be|required to be)\b.{0,50}\b@\b.{0,30}\b(?:student|candidate)\b",
    r"\b(?:only|exclusively|restricted to)\b.{0,45}\b@\b.{0,30}\b(?:students?|candidates?|program)\b",
    r"\bexpected graduation from\b.{0,50}\b@\b.{0,20}\bprogram\b",
    r"\b@\b.{0,15}\b(?:degree|enrollment)\b.{0,15}\b(?:required|only)\b",
    r"\beligible applicants are\b.{0,40}\b@\b.{0,30}\b(?:students?|candidates?)\b",
)
GRADUATE_CONDITIONS = (
    r"\b(?:only|exclusively|restricted to)\b.{0,45}\b@\b",
    r"\b@\b.{0,20}\b(?:required|only)\b",
    r"\beligible applicants are\b.{0,45}\b@\b",
)
FIRST_YEAR_CONDITIONS = (
    r"\b@\b.{0,25}\bonly\b",
    r"\b(?:only|exclusively|restricted to)\b.{0,40}\b@\b",
    r"\b(?:must be|required to be)\b.{0,35}\b@\b",
    r"\beligible applicants are\b.{0,35}\b@\b",
)
RISING_CONDITIONS = (r"\b@\b.{0,25}\bonly\b", r"\b(?:must be|required to be|eligible applicants are)\b.{0,35}\b@\b")
RETURNING = r"\breturning intern(?:s|ship|ships)?\b|\breturn internship\b"
RETURNING_CONDITIONS = (
    r"\b(?:former|returning) interns?\b.{0,25}\bonly\b",
    r"\bfor returning interns?\b",
    r"\binvitation[- ]only\b.{0,35}\b(?:return|returning) internship\b",
    r"\b(?:return|returning) internship\b.{0,35}\binvitation[- ]only\b",
)
PARTICIPANTS_CONDITIONS = (
    r"\b(?:eligible|open|restricted)\b.{0,25}\bonly\b.{0,45}\bprior (?:internship )?program participants?\b",
    r"\bprior (?:internship )?program participants?\b.{0,25}\bonly\b",
)
PARTICIPANTS_ARE_INTERNS = r"\b(?:internship|interned|returning interns?)\b"
PRIOR_CONDITIONS = (
    r"\b(?:must|required to|is required to)\b.{0,80}\b(?:previously (?:completed an? internship|interned)|prior internship)\b",
    r"\b(?:previously (?:completed an? internship|interned)|prior internship)\b.{0,80}\b(?:required|mandatory|must have)\b",
)
SAME_EMPLOYER = r"\b(?:with|at) (?:us|our company|this company|the same company|this employer)\b|\bhere\b"
SAID_FALSE = r"\b(?:false|no|not required)\b"

# Wordings that take a condition back.
PREFERENCE = r"\b(?:preferred|preference|preferably|desired|nice to have|a plus|ideally|encouraged|welcome to apply)\b"
NEGATED = (
    r"(?:\b(?:" + PHD + "|" + GRADUATE + r")\b(?:\s+\w+){0,3}\s+(?:is |are )?not (?:required|mandatory)\b"
    r"|\bno\s+(?:" + PHD + "|" + GRADUATE + r")\b(?:\s+\w+){0,3}\s+(?:is |are )?required\b)"
)

# Headings of qualifications.
PREFERRED_HEADING = r"^\s*(?:preferred|desired|bonus|nice[- ]to[- ]have)(?:\s+(?:qualifications?|requirements?|skills?))?\s*:?\s*(.*)$"
REQUIRED_HEADING = r"^\s*(?:minimum|required|basic|mandatory|must[- ]have)(?:\s+(?:qualifications?|requirements?|skills?|education))?\s*:?\s*(.*)$"
INNER_HEADING = r"(?<!^)(?=\b(?:preferred|desired|minimum|required|basic|mandatory)(?:\s+(?:qualifications?|requirements?|skills?|education))?\s*:)"

# Names of fields, in lower case without other characters than letters and digits.
STATUS_FIELDS = frozenset((
    "academiclevel", "academicdegree", "academicstanding", "academicstatus", "applicanteligibility", "candidatelevel", "candidateeligibility",
    "classyear", "degree", "degreelevel", "degreerequirement", "degreerequirements", "educationlevel", "educationrequirement",
    "educationrequirements", "eligibility", "eligibilitycriteria", "eligibilityrequirements", "minimumdegree", "minimumeducation",
    "programeligibility", "requireddegree", "requirededucation", "studenteligibility", "studentlevel", "studentstatus", "targetdegree",
    "targetstudentlevel",
))
OTHER_FIELDS = frozenset((
    "minimumqualification", "minimumqualifications", "prioreligibility", "priorinternrequired", "requiredqualification",
    "requiredqualifications", "returningintern", "returninginternonly",
))
CONTAINERS = frozenset((
    "additionalmetadata", "applicationmetadata", "candidate", "extra", "jobmetadata", "metadata", "postingmetadata", "qualifications",
    "requirementsmetadata", "sourcedetails", "sourcemetadata",
))
PREFERRED_FIELDS = ("preferred", "desired", "bonus", "nicetohave")

# What is said of a decision.
OPEN = "No title, structured field, required qualification, or mandatory description language clearly limits eligibility to an excluded group."
CLOSED = "Clear mandatory %s restriction found in %s: \"%s\""


def _any(conditions: tuple[str, ...], term: str = "") -> str:
    return "|".join(c.replace("@", term) for c in conditions)


def _whole(term: str) -> str:
    return rf"\b{term}\b"


def _beside(a: str, b: str) -> str:
    return rf"\b{a}\b.*\b{b}\b|\b{b}\b.*\b{a}\b"


def _listed(a: str, b: str, near: int) -> str:
    """Both in one enumeration, in either order."""
    gap = f".{{0,{near}}}"
    return rf"\b{a}\b{gap}{JOINED}{gap}\b{b}\b|\b{b}\b{gap}{JOINED}{gap}\b{a}\b"


HIGHER = f"(?:{PHD}|{GRADUATE})"
#: Every rule needs one of these, so evidence without them isn't looked at again.
NEEDED = rf"\b(?:{HIGHER}|{FIRST_YEAR}|{RISING})\b|intern|participant"
MIXED_STUDENTS = (
    rf"\bcurrent students?\b.{{0,80}}\b{UNDERGRADUATE}\b.{{0,50}},\s*currently (?:enrolled in|pursuing)\b.{{0,40}}\b{HIGHER}\b"  # fixed value
)
YEARS_JOINED = r"\b(?:and|or|and/or)\b"

#: Characters that stand for one ASCII character (wide, styled or raised forms, odd spaces), from Unicode's own rule.
_PLAIN_FROM, _PLAIN_TO = None, None


def _plain_forms() -> tuple[str, str]:
    global _PLAIN_FROM, _PLAIN_TO
    if _PLAIN_FROM is None:
        import unicodedata

        pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for block in (range(0x80, 0xD800), range(0xF900, 0x10000)) for c in block]
        pairs = [(a, b) for a, b in pairs if len(b) == 1 and b.isascii() and b != "\0"] + [("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("\1", " ")]
        _PLAIN_FROM, _PLAIN_TO = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return _PLAIN_FROM, _PLAIN_TO


def canonical(c: C) -> Column:
    """Plain characters; Ph. D. and M. S. without their dots."""
    odd = F.replace(F.translate(text(c), *_plain_forms()), F.lit("…"), F.lit("..."))
    s = F.when(text(c).rlike(r"[^\x02-\x7F]"), odd).otherwise(text(c))
    return F.regexp_replace(F.regexp_replace(s, r"(?i)\bph\s*\.\s*d\s*\.?", "PhD"), r"(?i)\bm\s*\.\s*s\s*\.?", "MS")


def normal(c: C) -> Column:
    return F.trim(F.regexp_replace(F.lower(canonical(c)), r"(?U)\s+", " "))


def segments(c: C) -> Column:
    """array<struct<text, preferred>>: the sentences of a list of qualifications; those below a heading of what is preferred, or that say so, are preferred.

    Every heading starts a section, so no sentence has to know the lines before it.
    """
    lines = F.split(F.regexp_replace(canonical(c), "(?i)" + INNER_HEADING, "\n"), r"[\r\n]+")
    lines = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"^[ \t\-*•]+|[ \t\-*•]+$", ""))
    lines = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, "(?is)" + PREFERRED_HEADING, "\1P$1"), "(?is)" + REQUIRED_HEADING, "\1R$1"))
    sections = F.split(F.concat(F.lit("\1R"), F.array_join(lines, "\n")), "\1")
    told = F.transform(F.filter(sections, lambda s: F.length(s) > 1), lambda s: F.struct((F.substring(s, 1, 1) == "P").alias("preferred"), F.split(F.substr(s, F.lit(2)), r"[.!?;•\n]+").alias("parts")))
    flat = F.flatten(F.transform(told, lambda s: F.transform(s["parts"], lambda p: F.struct(F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+$", "")).alias("text"), s["preferred"].alias("preferred")))))
    return F.transform(F.filter(flat, lambda s: s["text"] != ""), lambda s: F.struct(s["text"].alias("text"), (s["preferred"] | s["text"].rlike("(?i)" + PREFERENCE)).alias("preferred")))


def _name(key: object) -> str:
    return re.sub("[^a-z0-9]+", "", str(key).casefold())


def _told(value: object) -> Iterator[str]:
    """The scalars of a value, a nested field's behind its name."""
    if isinstance(value, dict):
        for key, inner in value.items():
            if not any(w in _name(key) for w in PREFERRED_FIELDS) and (found := "; ".join(_told(inner))):
                yield f"{key}: {found}"
    elif isinstance(value, list):
        for inner in value:
            yield from _told(inner)
    elif value is not None and (found := str(value).strip()):
        yield found


def _fields(value: dict, path: str, top: bool) -> Iterator[tuple[str, str]]:
    for key, inner in value.items():
        name, at = _name(key), f"{path}{key}"
        if any(w in name for w in PREFERRED_FIELDS):
            continue
        if name in STATUS_FIELDS or name in OTHER_FIELDS:
            if found := "; ".join(_told(inner)):
                yield at, f"{key}: {found}"
        elif isinstance(inner, dict) and (not top or name in CONTAINERS):
            yield from _fields(inner, at + ".", False)


@F.pandas_udf(ArrayType(StructType([StructField("source", StringType()), StructField("text", StringType())])))
def structured(objects: pd.Series) -> pd.Series:
    """The fields of a JSON object that speak of eligibility, with their paths. At the top only known containers are opened; what isn't an object has none."""

    def of(s):
        try:
            value = json.loads(s) if s else None
        except ValueError:
            value = None
        return [{"source": a, "text": b} for a, b in _fields(value, "", True)] if isinstance(value, dict) else []

    return objects.map(of)


def _evidence(told: Column, fields: bool) -> Column:
    """array<struct<kind, source, text>> in the order in which it is heard."""
    item = lambda kind, source, of: F.struct(F.lit(kind).alias("kind"), source.alias("source"), of.alias("text"))
    required = lambda name: F.transform(F.filter(told[name], lambda s: ~s["preferred"]), lambda s: item(name, F.lit(name), s["text"]))
    parts = [F.array(item("title", F.lit("title"), text("title"))), required("requirements"), required("description")]
    if fields:
        parts.insert(0, F.transform(told["extra"], lambda s: item("structured", s["source"], s["text"])))
    return F.filter(F.concat(*parts), lambda e: F.trim(e["text"]) != "")


def _is_status(e: Column) -> Column:
    field = F.element_at(F.split(e["source"], r"\."), -1)
    return (e["kind"] == "structured") & F.regexp_replace(F.lower(field), "[^a-z0-9]+", "").isin(*sorted(STATUS_FIELDS))


def _mixed_degrees(s: Column) -> Column:
    return s.rlike(_whole(UNDERGRADUATE)) & s.rlike(_whole(HIGHER)) & (F.contains(s, F.lit("/")) | s.rlike(_listed(UNDERGRADUATE, HIGHER, 80)) | s.rlike(MIXED_STUDENTS))


def _mixed_years(s: Column) -> Column:
    near = rf".{{0,45}}{YEARS_JOINED}.{{0,45}}"
    return s.rlike(_whole(FIRST_YEAR)) & s.rlike(_whole(LATER_YEAR)) & s.rlike(rf"\b{FIRST_YEAR}\b{near}\b{LATER_YEAR}\b|\b{LATER_YEAR}\b{near}\b{FIRST_YEAR}\b")


def _closes(e: Column, title: str, wording: str) -> Column:
    """A title needs other words than a sentence; a field of status needs none."""
    return F.when(e["kind"] == "title", e["left"].rlike(title)).otherwise(e["status"] | e["left"].rlike(wording))


def _returning(e: Column, company: Column) -> Column:
    s = e["left"]
    name = F.regexp_replace(company, r"[^\p{L}\p{N} ]", r"\\$0")
    here = s.rlike(SAME_EMPLOYER) | ((company != "") & F.rlike(s, F.concat(F.lit(r"\b(?:with|at) "), name, F.lit(r"\b"))))
    field = (e["kind"] == "structured") & ~s.rlike(SAID_FALSE) & (s.rlike(RETURNING) | F.regexp_replace(s, "[^a-z0-9]+", "").rlike("returningintern|priorinternrequired"))
    told = field | s.rlike(_any(RETURNING_CONDITIONS)) | (s.rlike(_any(PARTICIPANTS_CONDITIONS)) & s.rlike(PARTICIPANTS_ARE_INTERNS)) | (s.rlike(_any(PRIOR_CONDITIONS)) & here)
    return F.when(e["kind"] == "title", s.rlike(RETURNING)).otherwise(told)


def _graduate_level(s: Column) -> Column:
    return F.when(s.rlike(r"\bmba\b"), "mba").when(s.rlike(r"\b(?:jd|juris doctor|law (?:degree|school|student))\b"), "jd").when(s.rlike(_whole(MASTERS)), "masters").otherwise("graduate")


def _restriction(e: Column, company: Column) -> Column:
    """struct<reason, level> or null, of evidence with `left`, its text without what is negated. The first group that it names closes it."""
    s, one_degree = e["left"], ~_mixed_degrees(e["left"])
    said = lambda reason, level: F.struct(F.lit(reason).alias("reason"), level.alias("level"))
    phd = s.rlike(_whole(PHD)) & one_degree & _closes(e, _beside(PHD, INTERNSHIP), _any(DEGREE_CONDITIONS + PHD_CONDITIONS, PHD))
    graduate = s.rlike(_whole(GRADUATE)) & one_degree & _closes(e, _beside(GRADUATE, INTERNSHIP), _any(DEGREE_CONDITIONS + GRADUATE_CONDITIONS, GRADUATE))
    titled = s.rlike(_whole(FIRST_YEAR)) & s.rlike(_whole(INTERNSHIP))
    years = _any(FIRST_YEAR_CONDITIONS, FIRST_YEAR) + "|" + _any(RISING_CONDITIONS, RISING)
    first_year = s.rlike(rf"\b{FIRST_YEAR}\b|\b{RISING}\b") & ~_mixed_years(s) & F.when(e["kind"] == "title", titled).otherwise(e["status"] | s.rlike(years))
    found = (
        F.when(phd, said("phd_only", F.when(s.rlike(r"\bpost[- ]?doc(?:toral)?\b"), "postdoctoral").otherwise("phd")))
        .when((e["kind"] == "title") & s.rlike(r"\bgraduate(?: student| research)? intern(?:ship)?\b"), said("graduate_only", F.lit("graduate")))
        .when(graduate, said("graduate_only", _graduate_level(s)))
        .when(first_year, said("freshman_only", F.lit("undergraduate")))
        .when(_returning(e, company), said("returning_intern_only", F.lit("unspecified")))
    )
    return F.when((F.trim(e["norm"]) != "") & ~e["norm"].rlike(PREFERENCE), found)


def _first(e: Column) -> Column:
    """The first restriction that no field so far has lifted: a field that is open to several groups lifts what is said of one of them."""
    none = F.struct(F.lit(False).alias("degrees"), F.lit(False).alias("years"), F.lit(None).cast("struct<reason:string,level:string,source:string,text:string>").alias("found"))

    def step(state, x):
        field = x["kind"] == "structured"
        degrees, years = state["degrees"] | (field & x["degrees"]), state["years"] | (field & x["years"])
        reason = x["said"]["reason"]
        lifted = F.when(reason.isin("phd_only", "graduate_only"), degrees).when(reason == "freshman_only", years).otherwise(False)
        now = F.when(reason.isNotNull() & ~lifted, F.struct(reason.alias("reason"), x["said"]["level"].alias("level"), x["source"].alias("source"), x["text"].alias("text")))
        return F.struct(degrees.alias("degrees"), years.alias("years"), F.coalesce(state["found"], now).alias("found"))

    return F.aggregate(e, none, step)["found"]


def with_eligibility(df: DataFrame, extra: C | None = None, name: str = "student_eligibility") -> DataFrame:
    """df and a struct `name`: eligible, exclusion_reason, degree_level, evidence_source, evidence, explanation, mandatory_language_detected, negation_detected, mixed_eligibility_detected.

    df: company, title, requirements, description. extra: a column of JSON objects with a posting's further fields.
    Structured fields are heard first, then the title, requirements, description. Columns of df keep their names
    and values; one of the result's name is replaced.
    """
    company = normal("company")
    told = {n: segments(n) for n in ("requirements", "description")} | ({} if extra is None else {"extra": structured(col(extra))})
    heard = df.withColumn(name, F.struct(*(c.alias(n) for n, c in told.items())))
    now = F.col(f"`{name}`")
    heard = heard.withColumn(name, F.transform(_evidence(now, extra is not None), lambda e: e.withField("norm", normal(e["text"]))))
    heard = heard.withColumn(name, F.filter(now, lambda e: e["norm"].rlike(NEEDED)))
    heard = heard.withColumn(name, F.transform(now, lambda e: e.withField("left", F.regexp_replace(e["norm"], NEGATED, " ")).withField("degrees", _mixed_degrees(e["norm"])).withField("years", _mixed_years(e["norm"])).withField("status", _is_status(e))))
    heard = heard.withColumn(name, F.transform(now, lambda e: e.withField("said", _restriction(e, company))))
    heard = heard.withColumn(name, F.struct(
        _first(now).alias("found"), F.exists(now, lambda e: e["norm"].rlike(NEGATED)).alias("negated"), F.exists(now, lambda e: e["degrees"] | e["years"]).alias("mixed"),
    ))
    found, snippet = now["found"], bounded(now["found"]["text"], 240)
    every = normal(F.concat_ws(" ", text("title"), text("requirements"), text("description")))
    open_to = F.when(every.rlike(rf"\b(?:{UNDERGRADUATE}|{FIRST_YEAR}|{LATER_YEAR}|{RISING})\b"), "undergraduate").otherwise("unspecified")
    return heard.withColumn(name, F.struct(
        found.isNull().alias("eligible"), found["reason"].alias("exclusion_reason"), F.coalesce(found["level"], open_to).alias("degree_level"),
        found["source"].alias("evidence_source"), F.when(found.isNotNull(), snippet).alias("evidence"),
        F.when(found.isNull(), OPEN).otherwise(F.format_string(CLOSED, found["reason"], found["source"], snippet)).alias("explanation"),
        found.isNotNull().alias("mandatory_language_detected"), now["negated"].alias("negation_detected"), now["mixed"].alias("mixed_eligibility_detected"),
    ))
