"""Dates in many spellings, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, clean_cell, col, lower_ascii

# Texts that name no day.
ROLLING = "rolling|open until filled|ongoing"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_date(c: C) -> Column:
    """The day a text names, or null. Month names may be short; two-digit years from 69 on are of the last century.

    The cleaned text is bound once, as the only element of an array: written out in each rule it would be
    cleaned many times a row, in more code than a generated method may have.
    """
    s = F.regexp_replace(F.lower(clean_cell(c, single_line=True)), "(\\d)(?:st|nd|rd|th)\\b", "$1")
    return F.get(F.transform(F.array(s), _day), F.lit(0))


def _day(s: Column) -> Column:
    take = lambda p, i: F.regexp_extract(s, p, i)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    iso, us, short = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", "^(\\d{1,2})([/-])(\\d{1,2})\\2(\\d{4})$", "^(\\d{1,2})/(\\d{1,2})/(\\d{2})$"
    name = "(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
    first, second = f"^{name} (\\d{{1,2}}),? (\\d{{4}})$", f"^(\\d{{1,2}}) {name} (\\d{{4}})$"
    number = lambda m: F.element_at(F.create_map(*(F.lit(x) for i, m_ in enumerate(MONTHS, 1) for k in dict.fromkeys((m_, m_[:3])) for x in (k, str(i)))), m)
    return (
        F.when(s.rlike(ROLLING), None)
        .when(s.rlike(iso), day(take(iso, 1), take(iso, 2), take(iso, 3)))
        .when(s.rlike(us), day(take(us, 4), take(us, 1), take(us, 3)))
        .when(s.rlike(short), day(F.concat(F.when(take(short, 3) >= "69", "19").otherwise("20"), take(short, 3)), take(short, 1), take(short, 2)))
        .when(s.rlike(first), day(take(first, 3), number(take(first, 1)), take(first, 2)))
        .when(s.rlike(second), day(take(second, 3), number(take(second, 2)), take(second, 1)))
    )


def days_left(deadline: Column, today: Column) -> Column:
    return F.datediff(deadline, today)


# Fixed values: (days up to, score); a day that is past scores 0, no day at all 70, a later one 75.
URGENCY = ((2, 55), (14, 85), (45, 100))


def urgency(days: C) -> Column:
    d = col(days)
    out = F.when(d.isNull(), 70).when(d < 0, 0)
    for upto, score in URGENCY:
        out = out.when(d <= upto, score)
    return out.otherwise(75)


def iso_day(c: C) -> Column:
    """The day of an epoch in seconds or milliseconds, or of an ISO text, as text; blank if none."""
    s = F.trim(col(c).cast("string"))
    n = F.when(s.rlike("^\\d+(\\.\\d+)?$"), s.try_cast("double"))
    seconds = F.when(n > 1e10, n / 1000).otherwise(n)
    day = F.coalesce(F.to_date(F.timestamp_seconds(seconds)), F.try_to_date(F.substring(s, 1, 10), "y-M-d"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


SEASON = "(spring|summer|fall|autumn|winter)"


def season_key(c: C) -> Column:
    """season:year of a term such as "Summer 2026" or "fall '26", or null; autumn is fall, two digits are of this century."""
    s = F.trim(F.regexp_replace(lower_ascii(c), "\\s+", " "))
    p = f"^{SEASON}[ -]?'?(20\\d{{2}}|\\d{{2}})$"
    q = f"^(20\\d{{2}})[ -]?{SEASON}$"
    season = F.when(s.rlike(p), F.regexp_extract(s, p, 1)).when(s.rlike(q), F.regexp_extract(s, q, 2))
    year = F.when(s.rlike(p), F.regexp_extract(s, p, 2)).when(s.rlike(q), F.regexp_extract(s, q, 1))
    return F.when(season.isNotNull(), F.concat(F.when(season == "autumn", "fall").otherwise(season), F.lit(":"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))


def season_of_title(c: C) -> Column:
    """The one season:year that a title names, or null where it names none or several."""
    found = F.regexp_extract_all(lower_ascii(c), F.lit(f"\\b{SEASON}[ -]*'?(?:20\\d{{2}}|\\d{{2}})\\b"), F.lit(0))
    keys = F.array_distinct(F.array_compact(F.transform(found, lambda x: season_key(F.regexp_replace(x, "[ -]+'?", " ")))))
    return F.when(F.size(keys) == 1, F.element_at(keys, 1))


def freshness(at: Column, now: Column) -> Column:
    minutes = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 60
    return F.when(minutes < 60, "hour").when(minutes < 1440, "day").otherwise("older")
