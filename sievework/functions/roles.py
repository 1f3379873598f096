"""What kind of role a posting is: a table of decisions over hits in its title and text, the first that holds decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import C, col, company_key, squash, text
from .wordings import first, has

# Tracks, their labels, the role of each, and the roles' labels.
TRACK_LABELS = {
    "backend": "Backend software", "full_stack": "Full-stack software", "frontend": "Frontend software", "general_swe": "Software engineering",
    "platform_infra": "Platform / infrastructure software", "data_engineering": "Data engineering / analytics", "ml_ai": "ML / AI engineering",
    "quant_dev": "Quant development", "devops": "DevOps / developer tooling", "cloud": "Cloud software", "embedded_software": "Embedded software",
    "firmware": "Firmware", "sdet_qa_automation": "SDET / QA automation", "technical_product": "Technical product", "it_support": "IT support",
    "customer_experience": "Customer experience engineering", "solutions_engineering": "Solutions engineering",
    "electrical_hardware": "Electrical / hardware engineering", "mechanical_manufacturing": "Mechanical / manufacturing engineering",
    "civil_structural": "Civil / structural engineering", "quality_test": "Quality / test engineering",
    "factory_automation": "Factory automation engineering", "other_engineering": "Other engineering", "product": "Product",
    "non_technical": "Non-technical", "unknown": "Unknown",
}
ROLE_LABELS = {
    "swe": "Software engineering", "data_science": "Data science / analytics", "ml_ai": "ML / AI", "product": "Product", "quant": "Quant",
    "it": "IT", "non_technical": "Non-technical", "unknown": "Unknown",
}
ROLE_OF = {
    "backend": "swe", "full_stack": "swe", "frontend": "swe", "general_swe": "swe", "platform_infra": "swe", "devops": "swe", "cloud": "swe",
    "embedded_software": "swe", "firmware": "swe", "sdet_qa_automation": "swe", "technical_product": "product", "data_engineering": "data_science",
    "ml_ai": "ml_ai", "quant_dev": "quant", "product": "product", "it_support": "it", "non_technical": "non_technical",
}
TECHNICAL_ROLES = ("swe", "data_science", "ml_ai", "quant")
SOFTWARE_TRACKS = (
    "backend", "full_stack", "frontend", "general_swe", "platform_infra", "data_engineering", "ml_ai", "quant_dev", "devops", "cloud",
    "embedded_software", "firmware", "sdet_qa_automation", "technical_product",
)

# Wordings of software titles.
SOFTWARE_TITLES = (
    ("backend", r"\bback[- ]?end\b|\bserver[- ]side\b"),
    ("full_stack", r"\bfull[- ]?stack\b"),
    ("frontend", r"\bfront[- ]?end\b|\bui engineer\b|\bweb developer\b"),
    ("platform_infra", r"\bplatform software\b|\binfrastructure software\b|\bsite reliability\b|\bsre\b"),
    ("data_engineering", r"\bdata engineer(ing)?\b|\bdata science\b|\bdata analy(st|tics)\b|\bdata infrastructure\b|\bdata pipeline"),
    ("ml_ai", r"machine[- ]learning (engineer|engineering|intern)|\bml\b|\bml engineer\b|\bai engineer\b|\ba\.?\s*i\.?\s+integration\b|\bai[- ]integration\b|deep learning|computer vision|\bnlp\b|\bllms?\b|\bpytorch\b|\btensorflow\b"),
    ("quant_dev", r"\bquant(itative)? (developer|engineer|analyst|trading|research)|\bquantitative trading intern\b|\btrading intern\b|\bsystematic (investing|trading|research)\b|\bmarket model(l)?ing\b"),
    ("embedded_software", r"\bembedded software\b"),
    ("firmware", r"\bfirmware\b"),
    ("sdet_qa_automation", r"\bsdet\b|software qa automation|qa automation|software test automation|test automation framework"),
    ("technical_product", r"\bassociate product manager\b|\btechnical product manage(r|ment)\b|\bapm intern(ship)?\b|\bproduct development internship program\b"),
    ("general_swe", r"\bsoftware (engineer|engineering|developer|development)\b|\bswe\b|\bdeveloper intern\b|\bfounding engineer\b"),
    ("cloud", r"\bcloud developer\b|\bcloud software\b"),
    ("devops", r"\bdevops\b|developer tooling|build engineer"),
)
# Wordings of other titles.
OTHER_TITLES = (
    ("customer_experience", r"customer experience engineer|customer support engineer|technical support engineer"),
    ("solutions_engineering", r"solutions? engineer|sales engineer|forward deployed engineer|\bdigital solutions?\b|\bworkflow automation\b|\bintelligent systems?\b"),
    ("it_support", r"\bit (support|intern(ship)?)\b|help[- ]?desk|desktop support|sysadmin|systems administrator|network administrator"),
    ("electrical_hardware", r"electrical engineer|hardware engineer|\brf engineer|fpga engineer|pcb|circuit"),
    ("mechanical_manufacturing", r"naval architect|marine engineer|mechanical engineer|mechanical design engineer|manufacturing engineer|industrial engineer|industrial design engineer|physical product design|product design engineer|process engineer|aerospace engineer"),
    ("civil_structural", r"civil engineer|structural engineer"),
    ("quality_test", r"quality engineer|test engineer|validation engineer|verification engineer"),
    ("factory_automation", r"factory automation engineer|automation engineer|plc|plant automation|manufacturing automation"),
    ("product", r"product manage(r|ment)|\bpm intern\b|\bproduct intern\b|product development (co[- ]?op|intern)"),
    ("non_technical", r"commercial (co[- ]?op|intern(ship)?)"),
    ("non_technical", r"consumer insights?|consumer research|market research|survey research|data entry|\bmarketing\b|\bsales\b|business development|\bhr\b|human resources|recruit(ing|er)|social media|\bcontent\b|\bbrand\b|administrative|operations intern|accounting|activities intern|cold[- ]call|copywrit"),
)
# Titles that name a discipline by a phrase of their own.
SCOPED_TITLES = (
    ("full_stack", r"\bjava web develop(?:er|ing)\b|entwicklung (?:einer )?web[- ]app"),
    ("general_swe", r"\bit[- ]entwicklung\b|datenanalyse und softwaremonitoring"),
    ("devops", r"\bpowershell (?:development |automation )?intern(?:ship)?\b"),
    ("sdet_qa_automation", r"\bautomation tester\b.*\bselenium\b|\bselenium\b.*\bautomation test"),
    ("ml_ai", r"\b(?:intern(?:ship)?\W{0,12}ai research|ai research\W{0,12}intern(?:ship)?)\b"),
    ("ml_ai", r"\bdata and ai intern(?:ship)?\b|\bai (?:&|and) automation development\b"),
    ("ml_ai", r"d[ée]veloppeur ia et automatisation|data et intelligence artificielle"),
    ("ml_ai", r"\bai(?:[- ]based)? (?:hvac )?research\b|\bai[- ]based arc detection\b"),
    ("ml_ai", r"agentic ai|agentischer ki|generative ki|\bki[- ]entwicklung\b|\bdata\s*&\s*ai solutions\b"),
    ("ml_ai", r"world[- ]action model|\bvla\b.{0,50}autonomous driving"),
    ("electrical_hardware", r"\bhardware penetration testing\b"),
    ("quant_dev", r"\bquant and portfolio analytics\b"),
    ("technical_product", r"\bit product business analyst\s*/\s*product owner assistant\b"),
    ("it_support", r"\bit (?:global |infrastructure )?support intern(?:ship)?\b|\bit admin intern(?:ship)?\b"),
    ("mechanical_manufacturing", r"\binternship\b.{0,100}\bengineering in manufacturing\b"),
    ("mechanical_manufacturing", r"\binternship\b.{0,50}\bengineering mechanics and hydraulic\b"),
    ("other_engineering", r"\binternship\b.{0,50}\br&d engineering design\b"),
    ("other_engineering", r"\bintern(?:ship)?\b.{0,70}\btechnical engineering (?:responsibility|function)\b"),
    ("other_engineering", r"\bintern,? engineering\b"),
    ("general_swe", r"\bsoftwareentwicklung\b|\bszoftverfejleszt[őo]\b|ingenier[ií]a inform[aá]tica"),
    ("electrical_hardware", r"measurement technology for consumer sensors|hardware[- ]kalibrierung.{0,40}mems|zuverl[aä]ssigkeit von mems|fem simulation.{0,60}elektrischer antriebe"),
    ("other_engineering", r"fertigungsverfahren f[üu]r mems|simulationsmodelle f[üu]r mems|versuchsdurchf[üu]hrung und datenanalyse f[üu]r mems"),
    ("other_engineering", r"\brobotics system development\b|entwicklung robotischer systeme|humanoide roboter|\b3d[- ]cfd simulation\b"),
    ("it_support", r"\binternship in information system and technology\b"),
    ("technical_product", r"digital experience product ownership"),
)
# Other wordings that decisions rest on.
STRATEGY = r"\b(?:strategy analyst|strategy intern|business strategy|corporate strategy|operations strategy|product strategy|strategic planning)\b"
BACKEND = r"\bback[- ]?end\b|\bserver[- ]side\b|\bapis?\b|\brest(ful)?\b|\bmicroservices?\b|\bservices?\b|\bdistributed systems?\b|\bdatabases?\b|\bsql\b|\bpostgres(ql)?\b|\bmysql\b|\bspring\b"
SOFTWARE = r"\bsoftware\b|\bdeveloper\b|\bweb app\b|\bapis?\b|\brest(ful)?\b|\bmicroservices?\b|\bdistributed systems?\b|\bproduction code\b|\bcode review\b|\bbuild(ing)? services?\b|\bprogramming\b|\bcoding\b|\bplatform software\b|\binfrastructure software\b|\bdata engineer(ing)?\b|\bml engineer\b|machine learning|\bsdet\b|qa automation|software test automation|\bembedded software\b|\bfirmware\b"
MANUFACTURING = r"manufactur|factory|plant|plc|mechanical|electrical|hardware|industrial|process"
UMBRELLA = r"\b(?:summer )?internship program\b|\b(?:intern|summer) rotational program\b|\ball tracks\b"
PROGRAM_TRACK = r"\b(?:tracks?|functions?|pathways?|business areas?)\b.{0,180}\b(?:technology|software|engineering|data|analytics|quantitative|risk technology)\b|\b(?:technology|software|engineering|data|analytics|quantitative|risk technology)\b.{0,180}\b(?:tracks?|functions?|pathways?|business areas?)\b"
EMBEDDED_CODE = r"\bfirmware\b|\bembedded software\b|\bsoftware development\b|\bprogramming\b|\bcoding\b|\bc\+\+\b"
DUTIES = r"software|developer|back[- ]?end|front[- ]?end|full[- ]?stack|apis?|production code|programming|coding"
CLEAR_CODE = r"embedded software|firmware|software engineer|software developer|back[- ]?end|full[- ]?stack|platform software|infrastructure software"
#: (language or cloud, what must stand beside it, what that shows)
PAIRS = (
    (r"\bjava\b", BACKEND, "Java with backend/API context"),
    (r"\bpython\b", r"back[- ]?end|api|data|machine learning|ml|pipeline|service", "Python with software/data context"),
    (r"\bsql\b", r"back[- ]?end|data engineer|pipeline|database|service", "SQL with backend/data context"),
    (r"\b(aws|gcp|azure|cloud)\b", r"code|api|service|platform|developer|software|automation framework", "cloud with software/platform context"),
)
CLOUD_BESIDE = r"code|api|service|platform|developer|software"
AI_ANALYST_TITLES = ("data ai intern analyst", "data and ai intern analyst")
CAPITAL_ONE, CAPITAL_ONE_TITLES, CAPITAL_ONE_SEASON = ("capital one", "capital one financial"), ("technology intern", "technology internship program", "technology internship program intern"), r"^technology internship program summer [0-9]{4}$"
NOTHING = "No clear role signals in the title or description."

ROLE = "struct<role:string,label:string,confidence:double,evidence:array<string>,role_track:string,role_track_label:string,software_evidence:array<string>,non_swe_evidence:array<string>>"


def _any_case(pattern: str) -> str:
    """Capitals with accents too, where a pattern has any such letter."""
    return f"(?i){pattern}" if pattern.isascii() else f"(?iu){pattern}"


def _has(c: Column, pattern: str, low: C | None = None) -> Column:
    return has(c, low, _any_case(pattern))


def _first(c: Column, pattern: str, low: C | None = None) -> Column:
    return F.trim(first(c, low, _any_case(pattern)))


def found(c: Column, table: tuple[tuple[str, str], ...], low: C | None = None) -> Column:
    """(track, hit) of each entry of a table that a text matches, in the table's order."""
    return F.filter(F.array(*(F.struct(F.lit(track).alias("track"), _first(c, p, low).alias("hit")) for track, p in table)), lambda x: x["hit"] != "")


def _both(a: Column, b: Column) -> Column:
    """Both, the second looked at only if the first holds."""
    return F.when(a, b).otherwise(False)


def software_evidence(full: C, low: C | None = None) -> Column:
    """The first five words of software work in a text, then what its languages show beside them; each once."""
    c = col(full)
    words = F.regexp_extract_all(c, F.lit(f"(?i){SOFTWARE}"), F.lit(0))
    words = words if low is None else F.when(_has(c, SOFTWARE, low), words).otherwise(F.array().cast("array<string>"))
    shown = F.array_compact(F.array(*(F.when(_both(_has(c, a, low), _has(c, b, low)), said) for a, b, said in PAIRS)))
    return F.array_distinct(F.concat(F.transform(F.slice(words, 1, 5), lambda x: F.trim(x)), shown))


def is_software_work(full: C, low: C | None = None) -> Column:
    """Explicit software work, not tools alone."""
    c = col(full)
    return F.when(_has(c, SOFTWARE, low), True).when(_both(_has(c, r"\b(java|python|sql)\b", low), _has(c, BACKEND, low)), True).otherwise(_both(_has(c, PAIRS[3][0], low), _has(c, CLOUD_BESIDE, low)))


@dataclass
class Decision:
    """Where `when` holds: the track, how sure it is, and why.

    software and other stand in for evidence where there is none; only_software replaces it, also is added to it.
    """

    when: Column
    track: Column | str
    confidence: Column | float
    why: list[Column | str]
    software: Column | None = None
    other: Column | None = None
    only_software: Column | None = None
    also: Column | None = None


def _quoted(prefix: str, hit: Column) -> Column:
    return F.concat(F.lit(f'{prefix}"'), hit, F.lit('"'))


def _decisions() -> list[Decision]:
    """In order: the first that holds decides. Columns with _ are those that with_role makes."""
    title, full, body = F.col("_title"), F.col("_full"), F.col("_body")
    soft, other, scoped = F.get("_soft_title", F.lit(0)), F.get("_other_title", F.lit(0)), F.get("_scoped", F.lit(0))
    soft_body, other_body = F.get("_soft_body", F.lit(0)), F.get("_other_body", F.lit(0))
    in_full = lambda pattern: _has(full, pattern, "_full_low")
    strong, key = F.col("_strong"), squash("_title")
    strategy, embedded = _first(title, STRATEGY), F.regexp_extract(title, r"(?i)\bembedded intern(?:ship)?\b", 0)
    is_other = other.isNotNull()
    backend_else = lambda otherwise: F.when(in_full(BACKEND), "backend").otherwise(otherwise)
    overridden = lambda why: F.concat(F.lit('non-SWE title signal "'), other["hit"], F.lit(f'" overridden by {why}'))
    rescued = is_other & ((other["track"] == "product") | ((other["track"] == "non_technical") & _has(title, OTHER_TITLES[9][1]))) & strong & in_full(DUTIES)
    tested = is_other & other["track"].isin("factory_automation", "quality_test") & in_full(CLEAR_CODE)
    cloud, devops, embedded_engineer = _has(title, r"\bcloud\b"), _has(title, r"\bdevops\b"), _has(title, r"\bembedded engineer")
    engineer = _has(title, r"\b(engineer|engineering intern)\b")
    program = F.when(_has(title, UMBRELLA), _first(body, PROGRAM_TRACK, "_body_low"))
    no = F.array().cast("array<string>")
    return [
        Decision(key.isin(*AI_ANALYST_TITLES), "ml_ai", 0.82, [_quoted("exact Data & AI internship title: ", title)], only_software=F.array(title)),
        Decision(company_key("company").isin(*CAPITAL_ONE) & (key.isin(*CAPITAL_ONE_TITLES) | key.rlike(CAPITAL_ONE_SEASON)), "general_swe", 0.82, [_quoted("Capital One technology internship title: ", title)], only_software=F.array(title)),
        # clerical work isn't data work
        Decision(_has(title, "data entry"), "non_technical", 0.9, ['title: "data entry"'], other=F.array(F.lit("data entry"))),
        Decision((strategy != "") & soft.isNull(), "non_technical", 0.86, [_quoted("business-strategy title: ", strategy)], also=F.array(F.concat(F.lit("non_technical: "), strategy))),
        Decision(embedded != "", F.when(in_full(EMBEDDED_CODE), "embedded_software").otherwise("electrical_hardware"), 0.78, [_quoted("scoped technical title: ", embedded)]),
        Decision(scoped.isNotNull(), scoped["track"], 0.78, [_quoted("scoped technical title: ", scoped["hit"])], F.when(scoped["track"].isin(*SOFTWARE_TRACKS), F.array(scoped["hit"])).otherwise(no)),
        Decision(F.coalesce(program, F.lit("")) != "", "general_swe", 0.64, [_quoted("explicit technical program track: ", program)], F.array(F.lit("explicit technology/analytics/engineering program track"))),
        Decision(soft.isNotNull(), soft["track"], 0.82 + F.when(F.size("_software") > 0, 0.05).otherwise(0.0), [_quoted("title: ", soft["hit"]), F.when(soft_body.isNotNull(), _quoted("", soft_body["hit"]))], F.array(soft["hit"])),
        Decision(rescued, F.when(in_full(BACKEND), "backend").when(in_full(r"full[- ]?stack|react|typescript|next\.?js"), "full_stack").otherwise("general_swe"), 0.7, [overridden("clear software duties")]),
        Decision(is_other & (other["track"] == "quality_test") & in_full(r"\bsdet\b|qa automation|software test automation|automated testing framework"), "sdet_qa_automation", 0.82, [_quoted("title: ", other["hit"]), "software QA automation context"], F.array(F.lit("software QA automation"))),
        Decision(is_other & (other["track"] == "factory_automation") & strong & ~_has(title, MANUFACTURING), "platform_infra", 0.72, [_quoted("title: ", other["hit"]), "software automation context"]),
        Decision(tested, F.when(in_full(r"\bfirmware\b"), "firmware").when(in_full("embedded software"), "embedded_software").otherwise("general_swe"), 0.74, [overridden("explicit software context")]),
        Decision(is_other, other["track"], 0.82, [_quoted("title: ", other["hit"])], other=F.array(other["hit"])),
        Decision(cloud & strong, "cloud", 0.68, ['title: "cloud"', "software/platform context"]),
        Decision(cloud, "other_engineering", 0.68, ['title: "cloud" without software ownership context']),
        Decision(devops & strong, "devops", 0.68, ['title: "DevOps"', "developer tooling/software context"]),
        Decision(devops, "other_engineering", 0.68, ['title: "DevOps" without software ownership context']),
        Decision(embedded_engineer, F.when(in_full(r"firmware|embedded software|software|production code|programming|coding"), "embedded_software").otherwise("electrical_hardware"), 0.7, ['title: "embedded engineer"']),
        Decision(engineer & strong, backend_else("general_swe"), 0.68, ["generic engineer title with strong software context"]),
        Decision(engineer, "other_engineering", 0.66, ["generic engineer title without strong software context"]),
        Decision(soft_body.isNotNull(), soft_body["track"], 0.58, [_quoted("", soft_body["hit"])]),
        Decision(strong, "general_swe", 0.58, ["strong software context"]),
        Decision(other_body.isNotNull(), other_body["track"], 0.55, [_quoted("", other_body["hit"])]),
        Decision(F.lit(True), "unknown", 0.2, [NOTHING]),
    ]


def _map(table: dict[str, str], key: Column, missing: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(missing))


def with_role(df: DataFrame, name: str = "role_class") -> DataFrame:
    """df with the struct ROLE, from title, company, description and requirements; nulls are blank.

    Hits and texts are columns of their own, so no pattern runs twice on a text; all of it is one projection of built-in functions.
    """
    df = df.withColumns({"_title": text("title"), "_body": F.concat_ws(" ", text("description"), text("requirements"))})
    df = df.withColumn("_full", F.concat_ws(" ", "_title", "_body"))
    df = df.withColumns({"_body_low": F.lower("_body"), "_full_low": F.lower("_full")})
    title, body = F.col("_title"), F.col("_body")
    df = df.withColumns({
        "_soft_title": found(title, SOFTWARE_TITLES), "_soft_body": found(body, SOFTWARE_TITLES, "_body_low"), "_other_title": found(title, OTHER_TITLES), "_other_body": found(body, OTHER_TITLES, "_body_low"),
        "_scoped": found(title, SCOPED_TITLES), "_software": software_evidence("_full", "_full_low"), "_strong": is_software_work("_full", "_full_low"),
    })
    df = df.withColumn("_others", F.transform(F.concat("_other_title", "_other_body"), lambda x: F.concat(x["track"], F.lit(": "), x["hit"])))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    if_none = lambda have, instead: F.col(have) if instead is None else F.when(F.size(have) > 0, F.col(have)).otherwise(instead)
    verdicts = []
    for d in _decisions():
        why = F.array_compact(F.array(*map(lit, d.why)))
        software = if_none("_software", d.software) if d.only_software is None else d.only_software
        other = if_none("_others", d.other) if d.also is None else F.concat("_others", d.also)
        verdicts.append(F.when(d.when, F.struct(lit(d.track).alias("track"), lit(d.confidence).cast("double").alias("confidence"), why.alias("why"), software.alias("software"), other.alias("other"))))
    df = df.withColumn("_verdict", F.coalesce(*verdicts))
    v = F.col("_verdict")
    df = df.withColumn("_role", _map(ROLE_OF, v["track"], "unknown"))
    out = F.struct(
        F.col("_role").alias("role"), _map(ROLE_LABELS, F.col("_role"), "Unknown").alias("label"), F.bround(F.least(v["confidence"], F.lit(0.95)), 2).alias("confidence"), F.slice(v["why"], 1, 5).alias("evidence"),
        v["track"].alias("role_track"), _map(TRACK_LABELS, v["track"], "Unknown").alias("role_track_label"), F.slice(v["software"], 1, 6).alias("software_evidence"), F.slice(v["other"], 1, 6).alias("non_swe_evidence"),
    )
    made = ("_title", "_body", "_full", "_body_low", "_full_low", "_soft_title", "_soft_body", "_other_title", "_other_body", "_scoped", "_software", "_strong", "_others", "_verdict", "_role")
    return df.withColumn(name, out.cast(ROLE)).drop(*made)
