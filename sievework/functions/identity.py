"""Keys under which two postings are one: a requisition, a URL of its own, or company, title and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import C, company_key, squash, text
from .urls import canonical_url, fragment_posting_id, listing_rules, parts


def _join(provider: Column, scope: Column, native: Column) -> Column:
    """provider|scope|id in normal form, blank without provider or id; a blank scope is global."""
    tidy = lambda c: F.replace(squash(c), F.lit(" "), F.lit("_"))
    own = F.lower(F.regexp_replace(text(native), "\\s+", ""))
    place = F.when(tidy(scope) == "", "global").otherwise(tidy(scope))
    return F.when((tidy(provider) == "") | (own == ""), "").otherwise(F.concat_ws("|", tidy(provider), place, own))


def with_url_parts(df: DataFrame, source: str = "source_url") -> DataFrame:
    """df with u_url (canonical), u_host, u_path, u_query and u_id (the fragment's posting id) of a URL column.

    Each is a column of its own: the rules below name them many times, and one expression of all would
    hold a copy of their patterns for each mention.
    """
    df = df.withColumn("u_url", canonical_url(source)).withColumn("u_id", fragment_posting_id(source))
    p = parts("u_url")
    return df.withColumns({"u_host": p["host"], "u_path": p["path"], "u_query": p["query"]})


def board_requisition() -> Column:
    """struct(provider, scope, native) that a job board's URL names, or null. Each board is one row of rules: host, scope, id."""
    host, path, query = F.col("u_host"), F.col("u_path"), F.col("u_query")
    at = lambda i: F.trim(F.try_url_decode(F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(i))))
    jid = F.regexp_extract(query, "(?i)(?:^|&)gh_jid=([^&]+)", 1)
    jobs = "(?i)^/([^/]+)/(?:[^/]+/)*jobs/([^/]+)$"
    workday = F.regexp_replace(F.regexp_extract(path, "_([A-Za-z]+\\d[A-Za-z0-9-]*)$", 1), "(?<=\\d)-\\d+$", "")
    oracle = "(?i)/sites/([^/]+)/(?:job|jobs|requisition|requisitions)/([^/]+)"
    google = F.regexp_extract(path, "(?i)/results/([A-Za-z0-9]+)", 1)
    greenhouse = host == "job-boards.greenhouse.io"
    rules = [
        (greenhouse & path.rlike(jobs), "greenhouse", F.regexp_extract(path, jobs, 1), F.regexp_extract(path, jobs, 2)),
        (greenhouse & (jid != ""), "greenhouse", F.when(at(1) != "", at(1)).otherwise(host), jid),
        ((host == "jobs.lever.co") & (at(2) != "") & (F.lower(at(2)) != "apply"), "lever", at(1), at(2)),
        ((host == "jobs.ashbyhq.com") & (at(2) != ""), "ashby", at(1), at(2)),
        ((host == "jobs.smartrecruiters.com") & at(2).rlike("^[A-Za-z0-9]"), "smartrecruiters", at(1), F.regexp_extract(at(2), "^([A-Za-z0-9]+)", 1)),
        ((host == "apply.workable.com") & (F.lower(at(2)) == "j") & (at(3) != ""), "workable", at(1), at(3)),
        (host.endswith(".myworkdayjobs.com") & (workday != ""), "workday", F.concat_ws(":", F.split_part(host, F.lit("."), F.lit(1)), at(1)), workday),
        (host.endswith(".fa.oraclecloud.com") & path.rlike(oracle), "oracle_hcm", F.concat_ws(":", host, F.regexp_extract(path, oracle, 1)), F.regexp_extract(path, oracle, 2)),
        (host.isin("careers.google.com", "www.google.com") & (google != ""), "google_careers", host, google),
    ]
    out = F
    for ok, name, scope, native in rules:
        out = out.when(ok, F.struct(F.lit(name).alias("provider"), scope.alias("scope"), native.alias("native")))
    return out


def fragment_requisition() -> Column:
    """struct(provider, scope, native) of a posting id in a fragment; the scope is the page's hash."""
    path = F.when(F.col("u_path") == "", "/").otherwise(F.col("u_path"))
    scope = F.sha2(F.concat_ws("\u0000", "u_host", path, "u_query"), 256)
    return F.when((F.col("u_id") != "") & (F.col("u_url") != ""), F.struct(F.lit("url_fragment").alias("provider"), scope.alias("scope"), F.col("u_id").alias("native")))


# Connectors whose own ids name a requisition.
BOARDS = ("ashby", "greenhouse", "lever", "oracle_hcm", "smartrecruiters", "talentbrew", "workable", "workday")


def with_requisition(df: DataFrame, company: str = "company", extra: str | None = None) -> DataFrame:
    """df (with_url_parts) with u_board and req: a requisition's key given before, then the connector's id, then the URL's, then the fragment's; blank if none.

    extra names a map column of what the connector says.
    """
    says = (lambda k: F.trim(text(F.col(extra)[k]))) if extra else (lambda k: F.lit(""))
    blank = lambda c: F.when(c != "", c)
    df = df.withColumns({"u_board": board_requisition(), "u_fragment": fragment_requisition()})
    adapter, own = F.lower(says("source_adapter")), says("source_requisition_id")
    own = F.when((own == "") & (says("source") == "direct") & adapter.isin(*BOARDS), says("source_id")).otherwise(own)
    board = F.col("u_board")
    df = df.withColumns({"u_own": own, "u_provider": F.coalesce(blank(F.lower(says("source_system"))), board["provider"], blank(adapter), F.lit("source_native"))})
    place = F.coalesce(F.when(board["provider"] == F.col("u_provider"), board["scope"]), blank(squash(says("source_scope"))), company_key(company))
    of = lambda s: F.when(s.isNotNull(), _join(s["provider"], s["scope"], s["native"]))
    key = F.coalesce(blank(says("posting_requisition_key")), F.when(F.col("u_own") != "", _join(F.col("u_provider"), place, F.col("u_own"))), of(board), of(F.col("u_fragment")), F.lit(""))
    return df.withColumn("req", key).drop("u_fragment", "u_own", "u_provider")


def protected_title(title: C) -> Column:
    """squash of a title in which C++ and C# stay words of their own."""
    t = F.regexp_replace(text(title), "(?i)(?<![a-z0-9])c\\s*\\+\\+(?![a-z0-9+])", " cplusplus ")
    return squash(F.regexp_replace(t, "(?i)(?<![a-z0-9])c\\s*#(?![a-z0-9#])", " csharp "))


def other_scripts(title: C) -> Column:
    """What squash drops of a title in other scripts; Unicode's decomposition has no built-in function."""

    @F.arrow_udf(StringType())
    def kept(titles):
        import unicodedata

        import pyarrow as pa

        def of(t: str | None) -> str:
            plain = (c for c in unicodedata.normalize("NFKD", t or "").casefold() if not unicodedata.combining(c))
            return unicodedata.normalize("NFKC", "".join(c for c in plain if c.isalnum() and not c.isascii()))

        return pa.array([of(t) for t in titles.to_pylist()], pa.string())

    return kept(text(title))


def fallback_key(company: C, title: C, location: C) -> Column:
    """company|title|location, blank where all three are; the whole location counts.

    The decomposition runs only for titles outside ASCII: for others it is the empty text.
    """
    rest = F.when(text(title).rlike("[^\\x00-\\x7F]"), other_scripts(title)).otherwise("")
    key = F.concat_ws("|", company_key(company), F.trim(F.concat_ws(" ", protected_title(title), rest)), squash(location))
    return F.when(key == "||", "").otherwise(key)


def own_url_key() -> Column:
    """The URL's key (of with_url_parts and with_requisition) if its shape names one posting, else blank."""
    own = F.lower(F.regexp_replace("u_id", "\\s+", ""))
    key = F.when(own != "", F.concat("u_url", F.lit("#posting_id="), F.url_encode(own))).otherwise(F.col("u_url"))
    specific = listing_rules(F.col("u_path"), F.col("u_query"), F.col("u_id")) | F.col("u_board").isNotNull()
    return F.when((F.col("u_url") != "") & specific, key).otherwise("")
