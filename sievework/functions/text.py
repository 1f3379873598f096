"""Text expressions: everything here is a Column of built-in functions, so it stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: C) -> Column:
    """Missing text is blank text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def lower_ascii(c: C) -> Column:
    return F.lower(text(c))


def squash(c: C) -> Column:
    """Lower case; each run of characters outside a-z and 0-9 is one space; trimmed."""
    return F.trim(F.regexp_replace(lower_ascii(c), "[^a-z0-9]+", " "))


def collapse(c: C) -> Column:
    return F.trim(F.regexp_replace(text(c), "\\s+", " "))


# Words that name a company's legal form.
LEGAL_FORMS = ("inc", "llc", "ltd", "pvt", "co", "corp", "corporation", "company", "gmbh")


def company_key(c: C) -> Column:
    """squash without words of legal form."""
    words = F.filter(F.split(squash(c), " "), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))
    return F.array_join(words, " ")


def city_key(c: C) -> Column:
    """squash of what stands before the first comma."""
    return squash(F.split_part(text(c), F.lit(","), F.lit(1)))


def posting_key(company: C, title: C, location: C) -> Column:
    return F.concat_ws("|", company_key(company), squash(title), city_key(location))


def posting_id(key: C) -> Column:
    return F.substring(F.sha1(text(key)), 1, 10)


# Cells that mean nothing was given.
BLANKS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown")


def clean_cell(c: C, single_line: bool = False) -> Column:
    """Plain dashes, quotes and spaces; trimmed; what means nothing is blank."""
    s = F.trim(F.translate(text(c), " –—’", " --'"))
    s = F.regexp_replace(s, "^\\s+|\\s+$", "")
    if single_line:
        s = F.regexp_replace(s, "\\s+", " ")
    return F.when(F.lower(s).isin(*BLANKS), "").otherwise(s)


def has_phrase(value: C, phrase: C) -> Column:
    """Whether a squashed text has a squashed phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), col(value), F.lit(" ")), F.concat(F.lit(" "), col(phrase), F.lit(" ")))


def phrases_overlap(a: C, b: C) -> Column:
    return has_phrase(a, b) | has_phrase(b, a)


def slug(c: C) -> Column:
    return F.regexp_replace(squash(c), " ", "-")


def bounded(c: C, limit: int) -> Column:
    """Collapsed and cut to limit characters, the last three of them dots where something was cut."""
    s = collapse(c)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("..."))).otherwise(s)


def ordered_distinct_ci(values: Column) -> Column:
    """The first of values equal but for case, in order; blanks are dropped."""
    given = F.filter(values, lambda v: F.trim(v) != "")
    keys = F.transform(given, lambda v: F.lower(F.trim(v)))
    return F.filter(given, lambda v, i: F.array_position(keys, F.lower(F.trim(v))) == i + 1)


# The entities that html_text reads.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text(c: C) -> Column:
    """Text of HTML: scripts and styles go, breaks and ends of blocks are new lines, other tags are blanks, runs of blanks are one."""
    s = F.regexp_replace(text(c), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, "(?i)<br[^>]*>|</(p|div|li|ul|ol|tr|table|h[1-6])>", "\n")
    s = F.regexp_replace(s, "<[^>]*>", " ")
    for name, value in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(value))
    s = F.regexp_replace(s, "[ \t\r\f]+", " ")
    s = F.regexp_replace(s, " ?\n[ \n]*", "\n")
    return F.regexp_replace(s, "^[ \n]+|[ \n]+$", "")


def csv_safe(c: C) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe before it."""
    return F.when(col(c).rlike("^\\s*[=+\\-@]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def redact(c: C, limit: int = 320) -> Column:
    """URLs and secrets of an error text are masked; one line of at most limit characters."""
    s = F.regexp_replace(text(c), "(?i)https?://\\S+", "[url]")
    s = F.regexp_replace(s, "(?i)\\b(token|secret|password|passwd|api[-_]?key|authorization|bearer)\\b\\s*[:=]?\\s*\\S+", "$1=[redacted]")
    return F.substring(collapse(s), 1, limit)
