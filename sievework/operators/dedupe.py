"""Deduplication of postings by requisition, own URL, or company, title and place.

The match isn't transitive: two rows of different requisitions never match, though a third without one may
match either. So keys only gather rows that may meet, as components of a graph, and a component's rows are
folded in their order. Rows whose keys no other row has, nearly all, pass by both.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import C, text
from .components import components
from .storage import written

FIELDS = ("company", "title", "location", "compensation", "description", "requirements", "source_url", "date_posted", "deadline", "remote_status", "internship_type")


def with_keys(rows: DataFrame, extra: str | None = None) -> DataFrame:
    """pos, req, url and fb, the three keys, of rows; extra names a map column of provenance.

    The parts of URLs and the requisitions are written before rules read them: collapsed into one
    expression, the rules would hold a copy of the URL's patterns for each mention.
    """
    slim = rows.select("pos", "company", "title", "location", "source_url", *([extra] if extra else []))
    parts = written(identity.with_url_parts(slim), "urls")
    out = written(identity.with_requisition(parts, extra=extra).drop(*([extra] if extra else [])), "requisitions")
    out = out.withColumn("url", identity.own_url_key()).withColumn("fb", identity.fallback_key("company", "title", "location"))
    out = written(out.select("pos", "req", "url", "fb"), "keys")
    # a URL that several requisitions share names none of them
    shared = out.where("url <> '' and req <> ''").groupBy(F.col("url").alias("_url")).agg(F.min("req").alias("a"), F.max("req").alias("b")).where("a <> b").select("_url", F.lit(True).alias("_shared"))
    out = out.join(shared, F.col("url") == F.col("_url"), "left")
    return out.withColumn("url", F.when(F.col("_shared"), "").otherwise(F.col("url"))).drop("_url", "_shared")


def identity_key(req: C = "req", url: C = "url", fb: C = "fb") -> Column:
    tier = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"{name}|"), text(c)))
    return F.coalesce(tier("requisition", req), tier("url", url), tier("fallback", fb), F.lit(""))


def match_reason(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Why two rows are one posting, or null: requisitions decide where both have one, then URLs, then the fallback."""
    has = lambda x, k: x[k] != ""
    both = lambda k: has(a, k) & has(b, k)
    same = lambda k: both(k) & (a[k] == b[k])
    return (
        F.when(both("req"), F.when(a["req"] == b["req"], "requisition_id"))
        .when(has(a, "req") | has(b, "req"), F.when(same("url"), "source_url"))
        .when(both("url"), F.when(a["url"] == b["url"], "source_url"))
        .when(same("fb"), "company+title+location")
    )


def _reason(a: dict, b: dict) -> str | None:
    if a["req"] and b["req"]:
        return "requisition_id" if a["req"] == b["req"] else None
    if a["req"] or b["req"]:
        return "source_url" if a["url"] and a["url"] == b["url"] else None
    if a["url"] and b["url"]:
        return "source_url" if a["url"] == b["url"] else None
    return "company+title+location" if a["fb"] and a["fb"] == b["fb"] else None


def fold(rows: list[dict]) -> list[dict]:
    """Rows of a component in their order: each joins the first kept row that it matches and fills its blanks, or is kept."""
    kept: list[dict] = []
    index: dict[tuple[str, str], list[int]] = {}
    out = []

    def enter(i: int) -> None:
        for k in ("req", "url", "fb"):
            if kept[i][k]:
                index.setdefault((k, kept[i][k]), []).append(i)

    for row in rows:
        tiers = ("req", "url") if row["req"] else ("url", "fb") if row["url"] else ("fb",)
        found = next(((i, why) for k in tiers if row[k] for i in index.get((k, row[k]), ()) if (why := _reason(kept[i], row))), None)
        if found is None:
            kept.append(dict(row))
            enter(len(kept) - 1)
            out.append({"pos": row["pos"], "duplicate_of": None, "matched_on": None, "merged_fields": []})
            continue
        i, why = found
        filled = [f for f in FIELDS if not kept[i][f] and row[f]]
        for f in filled:
            kept[i][f] = row[f]
        out.append({"pos": row["pos"], "duplicate_of": kept[i]["pos"], "matched_on": why, "merged_fields": filled})
    for o, by in zip(out, [{r["pos"]: r for r in kept}.get(x["pos"]) for x in out], strict=True):
        o |= {f: (by or {}).get(f) for f in FIELDS}
    return out


def deduplicated(rows: DataFrame, extra: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows with their blanks filled, report) of rows with FIELDS and a unique pos.

    report: pos, duplicate_of, matched_on and merged_fields of each row that was merged. Blank text is missing;
    nulls count as blank. Filling a kept row's blanks doesn't give it keys that its input rows lack.
    """
    plain = rows.select("pos", *([extra] if extra else []), *(text(f).alias(f) for f in FIELDS))
    keyed = written(with_keys(plain, extra), "keys")
    plain = plain.select("pos", *FIELDS)
    ends = reduce(DataFrame.unionByName, (keyed.where(f"{k} <> ''").select("pos", F.concat(F.lit(f"{k}:"), F.col(k)).alias("key")) for k in ("req", "url", "fb")))
    first = ends.groupBy(F.col("key").alias("_key")).agg(F.min("pos").alias("v"), F.max("pos").alias("z")).where("v < z").drop("z")
    edges = ends.join(first, F.col("key") == F.col("_key")).select(F.col("pos").alias("u"), "v")
    label = components(edges)
    # only rows that may meet are shuffled with all their text
    met = plain.join(keyed.join(label, F.col("pos") == F.col("node")).drop("node"), "pos")
    alone = plain.join(label, F.col("pos") == F.col("node"), "left_anti")
    schema = "pos long, duplicate_of long, matched_on string, merged_fields array<string>, " + ", ".join(f"{f} string" for f in FIELDS)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(part.sort_values("pos").to_dict("records")), columns=["pos", "duplicate_of", "matched_on", "merged_fields", *FIELDS]).astype({"duplicate_of": "Int64"})

    folded = written(met.groupBy("label").applyInPandas(one, schema), "folded")
    kept = alone.select("pos", *FIELDS).unionByName(folded.where("duplicate_of is null").select("pos", *FIELDS))
    report = folded.where("duplicate_of is not null").select("pos", "duplicate_of", "matched_on", "merged_fields")
    return kept, report


def with_ids(rows: DataFrame) -> DataFrame:
    """rows (with company, title, location, req, url, fb) with id: ten digits of the canonical key's hash.

    Where several rows have one id and each an identity of its own, the identity's hash is added. The figures of an
    id are an aggregate joined back, as only ids that repeat are concerned.
    """
    from ..functions.text import posting_id, posting_key

    out = rows.withColumn("id", posting_id(posting_key("company", "title", "location"))).withColumn("_who", identity_key())
    many = out.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("_who") != "", F.col("_who"))).alias("own")).where("n > 1 and n = own").select("_id", F.lit(True).alias("_apart"))
    out = out.join(many, F.col("id") == F.col("_id"), "left")
    return out.withColumn("id", F.when(F.col("_apart"), F.concat_ws("-", "id", F.sha2("_who", 256))).otherwise(F.col("id"))).drop("_who", "_id", "_apart")
