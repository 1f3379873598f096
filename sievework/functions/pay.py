"""Pay from free text: kind, currency, period, amounts and a comparable US dollar rate an hour, as one struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col, text

# Dollars a unit of each currency, hours a period, what an amount's suffix multiplies by.
DOLLARS = {"USD": 1.0, "INR": 0.012, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73}
HOURS = {"hourly": 1.0, "weekly": 40.0, "monthly": 160.0, "annual": 2080.0, "term": 480.0}
TIMES = {"k": 1e3, "m": 1e6, "l": 1e5, "lakh": 1e5, "lakhs": 1e5, "lpa": 1e5}

# Wordings, in the order in which they are tried.
UNPAID = r"(?i)\b(unpaid|no (pay|compensation|salary|stipend)|volunteer|for (college )?credit|credit[- ]only|academic credit)\b"
NOT_UNPAID = r"(?i)\b(?:not|isn't|is not)\s+(?:an?\s+)?unpaid\b"
COMMISSION = r"(?i)commission[\s-]*(only|based)|100% commission"
EQUITY_FOR_SURE = r"(?i)equity[\s-]*only|only equity|equity in lieu|paid in equity|equity[\s-]*based"
EQUITY = r"(?i)\bequity"
VAGUE = r"(?i)\b(competitive|negotiable|doe|tbd|market rate|commensurate|depends on experience)\b"
STIPEND = r"(?i)\bstipend\b"
CURRENCIES = (("INR", r"(?i)₹|\b(inr|rs\.?|rupees?)\b"), ("EUR", r"(?i)€|\beur\b"), ("GBP", r"(?i)£|\bgbp\b"), ("CAD", r"(?i)\bcad\b|c\$"), ("USD", r"(?i)\$|\busd\b"))
PERIODS = (
    ("hourly", r"(?i)/\s*h(ou)?r\b|per\s+hour|hourly|an\s+hour|/\s*h\b"),
    ("weekly", r"(?i)/\s*w(ee)?k\b|per\s+week|weekly|a\s+week"),
    ("monthly", r"(?i)/\s*mo(nth)?\b|per\s+month|monthly|a\s+month|/\s*m\b"),
    ("annual", r"(?i)/\s*y(ea)?r\b|per\s+year|yearly|annual(ly)?|per\s+annum|\bp\.?a\.?\b|\blpa\b"),
    ("term", r"(?i)for\s+the\s+(summer|term|semester|program|internship)|\btotal\b|\blump\s*sum\b"),
)
AMOUNT = r"(?i)(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(lpa|lakhs|lakh|k|m|l)?(?![a-z0-9])"

_AMOUNTS = "array<struct<value:double,suffix:string>>"


def amounts(c: C) -> Column:
    """Amounts of money in a text, in order; percentages, hours, durations and retirement plans are none.

    Matches are marked in place and the text split at the marks, so each piece has an amount, its suffix
    and what follows, and ends with what stands before the next.
    """
    s = F.regexp_replace(text(c), r"(?i)401\s*\(?k\)?", " ")
    pieces = F.split(F.regexp_replace(s, AMOUNT, "\u0001$1\u0002$2\u0003"), "\u0001")

    def read(i: Column) -> Column:
        piece, last = F.get(pieces, i), F.get(pieces, i - 1)
        number, rest = F.split_part(piece, F.lit("\u0002"), F.lit(1)), F.substring_index(piece, "\u0002", -1)
        suffix, tail = F.lower(F.split_part(rest, F.lit("\u0003"), F.lit(1))), F.substring_index(rest, "\u0003", -1)
        tail = F.concat(F.substring(tail, 1, 12), F.when(i < F.size(pieces) - 1, "0").otherwise(""))
        before = F.right(F.regexp_replace(last, "(?s)^.*\u0003", ""), F.lit(8))
        money = before.rlike(r"(?i)(?:[$€£₹]|(?:usd|eur|gbp|cad|inr|rs\.?)\s*)$")
        none = tail.rlike(r"^\s*%") | (tail.rlike(r"(?i)^\s*(hours?|hrs?)\b") & ~money) | ((suffix == "") & ~money & tail.rlike(r"(?i)^\s*-?\s*(?:days?|weeks?|months?|years?)\b"))
        times = F.coalesce(*(F.when(suffix == k, F.lit(v)) for k, v in TIMES.items()), F.lit(1.0))
        value = F.replace(number, F.lit(","), F.lit("")).try_cast("double") * times
        return F.when(~none, F.struct(value.alias("value"), suffix.alias("suffix")))

    found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), read)
    return F.when(F.size(pieces) > 1, F.array_compact(found)).otherwise(F.array()).cast(_AMOUNTS)


def first_of(value: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern that matches, or null."""
    return F.coalesce(*(F.when(value.rlike(p), label) for label, p in table))


def _lookup(key: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def with_pay(df, source: str, name: str = "pay"):
    """df with the struct `name` (raw, kind, currency, period, amounts, dollars an hour, confidence) read from the text column `source`.

    Null and blank text has kind unknown. Each step is a column of its own, so that no pattern runs twice.
    """
    raw = F.trim(text(source))
    df = df.withColumn("_raw", raw).withColumn("_found", amounts("_raw"))
    df = df.withColumn("_currency", first_of(F.col("_raw"), CURRENCIES)).withColumn("_stated", first_of(F.col("_raw"), PERIODS))
    r, found = F.col("_raw"), F.col("_found")
    none = F.size(found) == 0
    kind = (
        F.when(r == "", "unknown")
        .when(F.regexp_replace(r, NOT_UNPAID, "").rlike(UNPAID), "unpaid")
        .when(r.rlike(COMMISSION), "commission_only")
        .when(r.rlike(EQUITY_FOR_SURE), "equity_only")
        .when(~none, "paid")
        .when(r.rlike(VAGUE), "unknown_vague")
        .when(r.rlike(STIPEND), "stipend_unspecified")
        .when(r.rlike(EQUITY), "equity_only")
        .otherwise("unknown")
    )
    # "80-90k": a lone pair of which only the second has a suffix shares it where that brings both close
    a, b = F.get(found, 0), F.get(found, 1)
    ratio = F.try_divide(b["value"], a["value"])
    pair = (F.size(found) == 2) & (b["suffix"] != "") & (a["suffix"] == "") & (a["value"] < 1000) & (b["value"] >= 1000)
    shared = F.when(pair & (ratio / 1e3).between(0.5, 2.0), 1e3).when(pair & (ratio / 1e5).between(0.5, 2.0), 1e5).otherwise(1.0)
    values = F.transform(found, lambda x, i: F.when(i == 0, x["value"] * shared).otherwise(x["value"]))
    df = df.withColumn("_kind", kind).withColumn("_low", F.array_min(values)).withColumn("_high", F.array_max(values))
    currency = F.coalesce("_currency", F.lit("USD"))
    dollars = F.col("_low") * _lookup(currency, DOLLARS)
    guess = F.when((currency == "INR") & (F.col("_low") >= 100_000), "annual").when(dollars <= 200, "hourly").when(dollars < 10_000, "monthly").otherwise("annual")
    df = df.withColumn("_period", F.coalesce("_stated", guess))
    paid = F.col("_kind") == "paid"
    hourly = lambda x: F.when(paid, F.bround(F.col(x) * _lookup(currency, DOLLARS) / _lookup(F.col("_period"), HOURS), 2)).when(F.col("_kind") == "unpaid", 0.0)
    sure = F.greatest(F.lit(0.9) - F.when(F.col("_stated").isNull(), 0.35).otherwise(0.0) - F.when(F.col("_currency").isNull(), 0.1).otherwise(0.0), F.lit(0.2))
    confidence = (
        F.when(paid, F.bround(sure, 2))
        .when(F.col("_kind") == "unpaid", 0.95)
        .when(F.col("_kind") == "commission_only", 0.9)
        .when(F.col("_kind") == "equity_only", F.when(none, 0.9).otherwise(0.85))
        .when(F.col("_kind") == "unknown_vague", 0.6)
        .when(F.col("_kind") == "stipend_unspecified", 0.5)
        .otherwise(0.0)
    )
    pay = F.struct(
        r.alias("raw"),
        F.col("_kind").alias("kind"),
        F.when(paid, currency).alias("currency"),
        F.when(paid, F.col("_period")).alias("period"),
        (paid & F.col("_stated").isNull()).alias("period_assumed"),
        F.when(paid, F.col("_low")).alias("amount_min"),
        F.when(paid, F.col("_high")).alias("amount_max"),
        hourly("_low").alias("usd_hourly_min"),
        hourly("_high").alias("usd_hourly_max"),
        confidence.alias("confidence"),
    )
    return df.withColumn(name, pay).drop("_raw", "_found", "_currency", "_stated", "_kind", "_low", "_high", "_period")


def hourly_mid(pay: C) -> Column:
    p = col(pay)
    return (p["usd_hourly_min"] + p["usd_hourly_max"]) / 2


# Fixed values: (dollars an hour from, score), scores of other kinds.
BANDS = ((40, 100), (35, 95), (30, 90), (25, 80), (20, 70), (15, 55), (10, 40), (5, 25), (0.01, 10))
KIND_SCORES = {"unpaid": 0, "equity_only": 5, "commission_only": 10, "stipend_unspecified": 50}


def banded(rate: C) -> Column:
    r = col(rate)
    out = F.when(r >= BANDS[0][0], BANDS[0][1])
    for least, score in BANDS[1:]:
        out = out.when(r >= least, score)
    return out.otherwise(0)


def pay_score(pay: C) -> Column:
    p = col(pay)
    out = F.when(p["kind"] == "paid", banded(hourly_mid(p)))
    for kind, score in KIND_SCORES.items():
        out = out.when(p["kind"] == kind, score)
    return out.otherwise(45)
