"""Canonical URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col, text

# Query keys that only track, and hosts under which http means https.
TRACKING_KEYS = ("gh_src", "lever-source", "ref", "referrer", "source", "src", "tracking", "trk")
SECURE_HOSTS = (".ashbyhq.com", ".greenhouse.io", ".lever.co", ".myworkdayjobs.com", ".smartrecruiters.com", ".workable.com")
HOST_ALIASES = {"boards.greenhouse.io": "job-boards.greenhouse.io"}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def parts(c: C) -> dict[str, Column]:
    """scheme, host, path, query and fragment of a URL, https where it names no scheme."""
    url = F.trim(text(c))
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    take = lambda i: F.regexp_extract(full, _PARTS, i)
    return {"scheme": F.lower(take(1)), "host": F.lower(take(2)), "path": take(3), "query": F.substring(take(4), 2, 1 << 30), "fragment": F.substring(take(5), 2, 1 << 30)}


def canonical_url(c: C) -> Column:
    """A URL without what doesn't identify a page: tracking keys, repeated pairs, the order of pairs, a last slash, the fragment, case of the host."""
    p = parts(c)
    host = p["host"]
    for old, new in HOST_ALIASES.items():
        host = F.when(host == old, new).otherwise(host)
    path = F.regexp_replace(p["path"], "/+$", "")
    last = F.regexp_extract(path, "([^/]*)$", 1)
    pairs = F.filter(F.split(p["query"], "&"), lambda x: F.contains(x, F.lit("=")) & (F.substring_index(x, "=", -1) != ""))

    def keeps(x: Column) -> Column:
        key, value = F.lower(F.split_part(x, F.lit("="), F.lit(1))), F.regexp_replace(x, "^[^=]*=", "")
        return ~(key.startswith("utm_") | key.isin(*TRACKING_KEYS) | ((key == "gh_jid") & (value == last)))

    query = F.array_join(F.array_sort(F.array_distinct(F.filter(pairs, keeps))), "&")
    secure = F.lit(False)
    for h in SECURE_HOSTS:
        secure = secure | host.endswith(h)
    scheme = F.when((p["scheme"] == "http") & secure, "https").otherwise(p["scheme"])
    out = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.trim(text(c)) == "", "").when(p["scheme"] == "", F.lower(F.trim(text(c)))).otherwise(out)


# Query keys and routes that carry a posting's id in a fragment.
POSTING_KEYS = ("gh_jid", "jid", "job_id", "jobid", "posting_id", "postingid", "req_id", "reqid", "requisition_id", "requisitionid")
POSTING_ROUTES = ("job", "jobs", "position", "positions", "role", "roles")


def fragment_posting_id(c: C) -> Column:
    """The posting id that a URL's fragment names as a key's value or as route/id; blank if none."""
    fragment = F.trim(F.try_url_decode(parts(c)["fragment"]))
    query = F.when(F.contains(fragment, F.lit("?")), F.substring_index(fragment, "?", -1)).otherwise(fragment)
    by_key = F.trim(F.regexp_extract(query, f"(?i)(?:^|[&?])(?:{'|'.join(POSTING_KEYS)})=([^&]+)", 1))
    by_route = F.trim(F.regexp_extract(F.split_part(fragment, F.lit("?"), F.lit(1)), f"(?i)^/?(?:{'|'.join(POSTING_ROUTES)})/([^/]+)$", 1))
    return F.coalesce(F.when(by_key != "", by_key).when(by_route != "", by_route), F.lit(""))


def posting_url(c: C) -> Column:
    """canonical_url, with the fragment's posting id if it has one."""
    own = F.lower(F.regexp_replace(fragment_posting_id(c), "\\s+", ""))
    return F.when((canonical_url(c) != "") & (own != ""), F.concat(canonical_url(c), F.lit("#posting_id="), F.url_encode(own))).otherwise(canonical_url(c))


# Last path segments, path parts and query keys of pages that list postings.
LISTING_SEGMENTS = (
    "career", "careers", "early-career", "early-careers", "intern", "internship", "internships", "job", "jobs", "join-us",
    "openings", "opportunities", "positions", "results", "roles", "search", "students", "university",
)
LISTING_PATHS = ("/job-search", "/jobs/search", "/search-jobs", "/search-results")
SEARCH_KEYS = ("keyword", "keywords", "location", "q", "query", "search")


def listing_rules(path: Column, query: Column, posting_id: Column) -> Column:
    """Whether a path and query name one posting: an id key or fragment, else two path segments or more that aren't a list's."""
    path = F.lower(F.regexp_replace(path, "/+$", ""))
    keys = F.transform(F.split(F.lower(query), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    listing = path.rlike("|".join(LISTING_PATHS)) | path.rlike(f"(^|/)({'|'.join(LISTING_SEGMENTS)})$") | (path == "") | F.arrays_overlap(keys, F.array(*map(F.lit, SEARCH_KEYS)))
    has_id = F.arrays_overlap(keys, F.array(*map(F.lit, POSTING_KEYS))) | (posting_id != "")
    return has_id | (~listing & path.rlike("[^/]/+[^/]"))


def names_one_posting(c: C) -> Column:
    """listing_rules of a URL; a blank one names none."""
    p = parts(c)
    return (F.trim(text(c)) != "") & listing_rules(p["path"], p["query"], fragment_posting_id(c))


def origin(c: C) -> Column:
    p = parts(c)
    return F.concat(p["scheme"], F.lit("://"), p["host"])


def without_secrets(c: C) -> Column:
    """A URL without user, query and fragment."""
    p = parts(c)
    return F.concat(p["scheme"], F.lit("://"), F.regexp_replace(p["host"], "^.*@", ""), p["path"])


def is_application_url(c: C) -> Column:
    p = parts(c)
    return col(c).isNotNull() & F.trim(text(c)).rlike("(?i)^https?://") & (p["host"] != "") & ~F.contains(p["host"], F.lit("@"))
