import random

from pyspark.sql import functions as F

from sievework.functions import fit, posting_rules, posting_signals, roles, wordings

LONG = [f"(?i){p}" for _, p in (*roles.SOFTWARE_TITLES, *roles.OTHER_TITLES)] + [f"(?i){p}" for p in (*posting_rules.TECH, *posting_rules.STARTUP, *posting_rules.OTHER_TRADES, *posting_signals.FOUNDER, *posting_signals.GRUNT)]
LONG += [f"(?i){p}" for p in (roles.SOFTWARE, roles.BACKEND, roles.PROGRAM_TRACK, posting_signals.FEE, posting_signals.HOURS, posting_signals.LEARNING, posting_signals.STRUCTURED)]
LONG += [p for _, p in (*fit.STRONG_SKILLS, *fit.SMALL_GAINS)] + [fit.GO_RUST, fit.CPLUS, fit.OPERATIONS, fit.COMMERCIAL, posting_rules.TEAM]


def test_a_pattern_finds_the_same_with_its_literals_before_it(spark):
    rng = random.Random(5)
    parts = sorted({x for p in LONG for _, literals in wordings.alternatives(p) for x in literals or ()} | {"go", "Go", "C++", "12", "60+", "$5 ", "K", "İ", "é", "ai", "a.i. ", "s", "end", "-", "\n"})
    texts = [rng.choice(["", " ", "-"]).join(rng.choice([x, x.upper(), x.title()]) for x in rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    for at in range(0, len(LONG), 16):
        some = LONG[at : at + 16]
        plain = df.select(*(F.struct(F.col("t").rlike(p), F.regexp_extract("t", p, 0)).alias(f"p{i}") for i, p in enumerate(some))).collect()
        gated = df.select(*(F.struct(wordings.has("t", "low", p), wordings.first("t", "low", p)).alias(f"p{i}") for i, p in enumerate(some))).collect()
        assert [[tuple(x) for x in r] for r in gated] == [[tuple(x) for x in r] for r in plain]


def test_literals_of_patterns():
    assert wordings.alternatives(r"(?i)\bback[- ]?end\b|Java|x*|[a|b]c(d|ef)") == ((r"(?i)\bback[- ]?end\b", ("back",)), ("(?i)Java", ("java",)), ("(?i)x*", None), ("(?i)[a|b]c(d|ef)", ("c",)))
    assert wordings.alternatives("(?iu)straße") == (("(?iu)straße", None),)
    # nearly all patterns of long texts have one in each alternative, so a text without any is passed by no pattern
    known = [literals for p in LONG for _, literals in wordings.alternatives(p)]
    assert None not in known
