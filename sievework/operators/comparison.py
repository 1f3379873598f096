"""What a run did with each posting, source against source: light summaries of all, dear details of the few that are kept.

Postings have id (one row each), company, title, identity, requisition, url, sources (array), final_reason, generic_url; duplicates,
the report of merged rows, have position, kept_identity, company, title, reason. A role is a company and a title by their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import comparison_category
from ..functions.text import company_key, redact, squash, text
from .ranking import first_n_per_group
from .storage import written

# Categories in the order of a report, reasons that reject as a matter of routine, states of a source that is in trouble.
CATEGORIES = ("github_only", "direct_only", "both", "collected_rejected", "no_postings")
ROUTINE_REASONS = ("not_internship", "closed", "wrong_season", "nontechnical_role", "watcher_role_ineligible", "outside_us", "below_min_score")
TROUBLED = ("degraded", "failed", "failing", "unknown")
TROUBLED_COVERAGE = ("degraded", "failing", "uncovered")
PARTS = ("identity", "deduplication", "sources", "decision")
ROUTINE_SAMPLE, MOST_DETAILS, MOST_SIMILAR = 25, 2_000, 25


def with_role(df: DataFrame) -> DataFrame:
    return df.withColumn("_company", company_key("company")).withColumn("_title", squash("title"))


# -- what stands beside a posting -------------------------------------------------------------------


def similar_requisitions(postings: DataFrame, most: int = MOST_SIMILAR) -> DataFrame:
    """id, similar: other requisitions of the posting's role, by identity, `most` at most; none for a posting without requisition.

    A role's first `most` + 1 requisitions hold what any of its postings is shown, so a role of any size is one short
    array and no posting meets another. A requisition stands for its first posting by id.
    """
    named = with_role(postings).where(text("requisition") != "")
    each = named.groupBy("_company", "_title", "requisition").agg(F.min(F.struct("id", "identity", "url")).alias("first"))
    each = each.select("_company", "_title", F.struct(F.col("first.identity").alias("identity"), "requisition", F.col("first.url").alias("url")).alias("other"))
    few = first_n_per_group(each, ["_company", "_title"], [F.col("other.identity"), F.col("other.requisition")], most + 1)
    role = few.groupBy("_company", "_title").agg(F.array_sort(F.collect_list("other")).alias("others"))
    own = named.select("id", "requisition", "_company", "_title").join(role, ["_company", "_title"])
    return own.select("id", F.slice(F.filter("others", lambda o: o["requisition"] != F.col("requisition")), 1, most).alias("similar"))


def _positions(df: DataFrame, duplicates: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """Duplicates with their role, and the keys that relate one to a posting: identity, role, and the title alone where several sources have it."""
    kept = with_role(duplicates).select("position", F.nullif(text("kept_identity"), F.lit("")).alias("identity"), "_company", "_title", *df)
    return [(kept.where("identity is not null"), ["identity"]), (kept, ["_company", "_title"]), (kept, ["_title"])]


def with_related_counts(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """postings with duplicate_sightings: how many duplicates relate to each, each once, without listing any.

    Those of its identity plus those of its title (its role, where one source has it) less those that are both: three
    lookups of counts, so a title that very many duplicates share costs one row.
    """
    kept = _positions([], duplicates)[1][0]
    own = with_role(postings)
    keys = {"i": ["identity"], "r": ["_company", "_title"], "t": ["_title"], "ir": ["identity", "_company", "_title"], "it": ["identity", "_title"]}
    for name, key in keys.items():
        counts = kept.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias(f"_{name}"))
        own = own.join(counts, key, "left")
    n = {k: F.coalesce(f"_{k}", F.lit(0)) for k in keys}
    return own.select(*postings.columns, F.when(F.size("sources") > 1, n["i"] + n["t"] - n["it"]).otherwise(n["i"] + n["r"] - n["ir"]).alias("duplicate_sightings"))


def related_duplicates(postings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """id, diagnostics: the duplicates that relate to each of some postings, by position. As large as its answer: for selected postings."""
    own = with_role(postings).select("id", "identity", "_company", "_title", (F.size("sources") > 1).alias("_several"))
    arms = []
    for n, (kept, key) in enumerate(_positions([F.col("reason")], duplicates)):
        asked = own.where("_several") if n == 2 else own
        arms.append(asked.select("id", *key).join(kept.select("position", "reason", *key), key).select("id", "position", "reason"))
    every = reduce(DataFrame.unionByName, arms).groupBy("id", "position").agg(F.first("reason").alias("reason"))
    return every.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "reason"))).alias("diagnostics"))


def coverage_by_name(coverage: DataFrame, companies: DataFrame) -> DataFrame:
    """_company, direct_status, direct_coverage, backstop: the last coverage by position of each name of its company."""
    names = companies.select(company_key("company").alias("_own"), F.explode(F.concat(F.array("company"), F.coalesce("names", F.array().cast("array<string>")))).alias("name"))
    own = coverage.withColumn("_own", company_key("company"))
    every = own.join(names, "_own", "left").select(company_key(F.coalesce("name", "company")).alias("_company"), "position", "direct_status", "direct_coverage", "backstop")
    last = every.groupBy("_company").agg(F.max(F.struct("position", "direct_status", "direct_coverage", "backstop")).alias("c"))
    return last.select("_company", *(F.nullif(F.col(f"c.{c}"), F.lit("")).alias(c) for c in ("direct_status", "direct_coverage")), F.col("c.backstop").alias("backstop"))


# -- summaries and their selection ------------------------------------------------------------------


def summaries(postings: DataFrame, duplicates: DataFrame, companies: DataFrame, coverage: DataFrame) -> DataFrame:
    """A light row for each posting, and one of category no_postings for each company none of whose names any posting has.

    companies: company, names (array of further names); coverage: company, position, direct_status, direct_coverage, backstop.
    Repeated postings stay; a posting without company has no coverage.
    """
    known = coverage_by_name(coverage, companies)
    own = with_related_counts(postings, duplicates).withColumn("_company", company_key("company")).join(known, "_company", "left")
    found = own.select(
        "id", redact("company").alias("company"), redact("title").alias("title"), redact("identity").alias("identity"), F.transform("sources", redact).alias("sources"),
        redact("final_reason").alias("final_reason"), comparison_category("sources", "final_reason").alias("category"), "direct_status", "direct_coverage", "backstop",
        F.coalesce("generic_url", F.lit(False)).alias("generic_url"), "duplicate_sightings",
    )
    seen = postings.select(company_key("company").alias("_company")).distinct()
    names = companies.select("company", F.explode(F.concat(F.array("company"), F.coalesce("names", F.array().cast("array<string>")))).alias("name")).select("company", company_key("name").alias("_company"))
    without = companies.select("company").distinct().join(names.join(seen, "_company", "left_semi").select("company").distinct(), "company", "left_anti")
    none = without.withColumn("_company", company_key("company")).join(known, "_company", "left").select(
        F.lit(None).cast(postings.schema["id"].dataType).alias("id"), "company", F.lit("").alias("title"), F.lit("").alias("identity"), F.array().cast("array<string>").alias("sources"), F.lit("not_collected").alias("final_reason"),
        F.lit("no_postings").alias("category"), "direct_status", "direct_coverage", "backstop", F.lit(False).alias("generic_url"), F.lit(0).cast("long").alias("duplicate_sightings"),
    )
    return found.unionByName(none)


def in_trouble() -> Column:
    """Something about the entry's source, address or merging wants a look."""
    state = reduce(lambda a, b: a | b, (F.contains(text("direct_coverage"), F.lit(m)) for m in TROUBLED_COVERAGE))
    return F.coalesce(F.col("direct_status").isin(*TROUBLED), F.lit(False)) | state | F.col("generic_url") | (F.col("duplicate_sightings") > 0)


def is_routine() -> Column:
    return (F.col("category") == "collected_rejected") & F.col("final_reason").isin(*ROUTINE_REASONS) & ~in_trouble()


def priority() -> Column:
    """0 kept by a source, 1 in trouble, 2 no postings, 3 an uncommon reason, 4 routine."""
    return F.when(F.col("category").isin(*CATEGORIES[:3]), 0).when(in_trouble(), 1).when(F.col("category") == "no_postings", 2).when(~F.col("final_reason").isin(*ROUTINE_REASONS), 3).otherwise(4)


def sample_key() -> Column:
    """The same for an entry in any run and order."""
    return F.sha2(F.concat_ws("\x1f", text("identity"), text("id"), F.lower("company"), F.lower("title"), "final_reason"), 256)


def _order() -> list[Column]:
    return [F.col("sample_key"), F.col("identity"), text("id"), F.lower("company"), F.lower("title")]


def select_details(entries: DataFrame, per_reason: int = ROUTINE_SAMPLE, most: int = MOST_DETAILS) -> DataFrame:
    """The summaries whose details are kept, with priority, sample_key and display (their place from 1).

    Of routine rejections a stable sample of `per_reason` for each reason; all others; of both the first `most` by
    priority and sample key. Each task cuts first, so only so many of a reason, and of all, are shuffled; `most` rows
    are numbered in one task.
    """
    keyed = entries.withColumn("priority", priority()).withColumn("sample_key", sample_key()).withColumn("_routine", is_routine())
    order = _order()
    sampled = first_n_per_group(keyed.where("_routine"), ["final_reason"], order, per_reason)
    kept = keyed.where("not _routine").unionByName(sampled).orderBy("priority", *order).limit(most)
    place = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category"))
    shown = Window.orderBy(place, F.lower("company"), F.lower("title"), "identity", "final_reason", text("id"))
    return kept.drop("_routine").withColumn("display", F.row_number().over(shown))


def selected(postings: DataFrame, duplicates: DataFrame, companies: DataFrame, coverage: DataFrame, per_reason: int = ROUTINE_SAMPLE, most: int = MOST_DETAILS) -> DataFrame:
    """select_details() of summaries(), with the duplicates looked up only of postings that can be kept.

    A posting that some source kept goes before all others, whatever was merged into it. Where such postings fill the
    selection, the first `most` of them are all of it, and no other is shuffled; else every posting is looked up.
    """
    kept = postings.where(comparison_category("sources", "final_reason").isin(*CATEGORIES[:3])).withColumn("_whole", F.struct(*postings.columns))
    kept = kept.withColumns({c: redact(c) for c in ("company", "title", "identity", "final_reason")}).withColumn("sample_key", sample_key())
    first = written(kept.orderBy(*_order()).limit(most).select("_whole.*"), "first")
    return select_details(summaries(first if first.count() >= most else postings, duplicates, companies, coverage), per_reason, most)


def details(selected: DataFrame, postings: DataFrame, duplicates: DataFrame, similar: DataFrame | None = None, parts: Sequence[str] = PARTS) -> DataFrame:
    """selected with a struct `trace` of what an entry's posting is, what it was merged from and what stands beside it; null for companies without postings.

    Only selected postings are looked at: the joins take their few ids, and the roles beside them, to the postings.
    parts: which of the trace's parts are made; what stands beside a posting is looked up only for `identity`.
    """
    chosen = postings.join(F.broadcast(selected.select("id").where("id is not null")), "id", "left_semi")
    looked = chosen.join(related_duplicates(chosen, duplicates), "id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(looked.schema[c].dataType))
    made = {}
    if "identity" in parts:
        if similar is None:
            roles = with_role(chosen).select("_company", "_title").distinct()
            similar = similar_requisitions(with_role(postings).join(F.broadcast(roles), ["_company", "_title"], "left_semi").select(*postings.columns))
        looked = looked.join(similar.join(F.broadcast(chosen.select("id")), "id", "left_semi"), "id", "left")
        made["identity"] = F.struct("identity", "requisition", "url", F.col("generic_url").alias("generic_or_shared_url"), none("similar").alias("similar_requisitions"))
    made["deduplication"] = F.struct(F.size(none("diagnostics")).alias("duplicate_sightings"), none("diagnostics").alias("merge_diagnostics"))
    made["sources"] = F.struct("sources", F.array_contains("sources", "direct_ats").alias("direct_found"), F.exists("sources", lambda s: s != "direct_ats").alias("feed_found"))
    made["decision"] = F.struct("final_reason", (F.col("final_reason") == "pending").alias("pending"))
    trace = F.struct(*(made[p].alias(p) for p in PARTS if p in parts))
    return selected.join(looked.select("id", trace.alias("trace")), "id", "left")


def category_counts(entries: DataFrame) -> DataFrame:
    """category, n for every category, zeros included."""
    every = entries.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = entries.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


# What a report calls each status of a direct source.
DIRECT_TOTALS = {"direct_healthy": "healthy_with_listings", "direct_empty": "healthy_empty", "direct_failed": "failed", "direct_unsupported": "not_configured", "direct_degraded": "degraded", "direct_unknown": "unknown"}


def source_totals(attempts: DataFrame, states: DataFrame) -> DataFrame:
    """One row: direct sources by the status of their state (unknown without one), feeds that succeeded or failed.

    attempts: health_key, source_kind, succeeded; states: health_key, status.
    """
    now = attempts.join(states.select("health_key", "status"), "health_key", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    direct, feed = F.col("source_kind") == "direct", F.col("source_kind") == "github_feed"
    totals = [F.count_if(direct & (F.col("status") == status)).alias(name) for name, status in DIRECT_TOTALS.items()]
    return now.agg(*totals, F.count_if(feed & F.col("succeeded")).alias("github_healthy"), F.count_if(feed & ~F.col("succeeded")).alias("github_failed"))
