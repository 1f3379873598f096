"""What each of five filters removes, alone and behind the others, in every order.

A document is a mask of the filters that it fails. Counts of masks, of all documents and of those with a
good or a toxic label, are the rows of a matrix, three for each part of the corpus; products with integer
matrices of 32 masks by 600 places (120 orders of 5 steps) give what is kept, removed, redundant or
failed by one filter alone at each step. The corpus is read once; no document is filtered 120 times.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The filter at each of the 600 places.
PLACES = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

_WORD = r"[^\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def outcomes() -> dict[str, np.ndarray]:
    """The matrices, 32 x 600: 1 where a document of this mask has that outcome at that place."""
    fails = (np.arange(32)[:, None] >> np.arange(5)) & 1
    here = fails[:, PLACES]
    before = np.cumsum(here, axis=2) - here
    alone = (fails.sum(axis=1) == 1)[:, None, None]
    found = {"kept": (here == 0) & (before == 0), "removed": (here == 1) & (before == 0), "redundant": (here == 1) & (before > 0), "unique_fails": (here == 1) & alone}
    return {k: m.reshape(32, -1).astype(np.int64) for k, m in found.items()}


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A few words, B few distinct ones, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n, capitals = F.size(words).cast("long"), F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    fails = [n < 50, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * 65, capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask, and those with a good or toxic label.

    Texts are told by their SHA-256 and leave the rows before the first shuffle. Rows of one text, part and
    labels are counted before they meet, so a text of any number of copies is four rows a part where its
    smallest doc_id is found.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), own_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    told = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(told.hint("merge"), "doc_id", "left").fillna(0, ["good", "toxic"])
    # in a group a doc_id has one row, so the least struct has the number of rows of the least doc_id
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first)
    low = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("fresh", F.col("nameless") + F.when(F.col("first.doc_id") == low, F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    each = groups.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    return each.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _products(batches):
    m = outcomes()
    letters = (PLACES.reshape(-1)[:, None] == np.arange(5)).astype(np.int64)
    orders, steps = np.repeat(ORDERS, 5), np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            some = batch.slice(lo, 100)
            parts, cells = some.column(0), some.column(1)
            at = np.repeat(np.arange(len(parts)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
            cell = cells.flatten()
            hist = np.zeros((3, len(parts), 32), np.int64)
            for k, name in enumerate(("n", "good", "toxic")):
                np.add.at(hist[k], (at, cell.field("mask").to_numpy()), cell.field(name).to_numpy())
            lost = hist @ m["removed"]
            found = {k: hist[0] @ m[k] for k in ("kept", "redundant", "unique_fails")} | {"removed": lost[0], "good_lost": lost[1], "toxic_lost": lost[2]}
            found["shapley"] = (lost[0] @ letters)[:, PLACES.reshape(-1)]
            yield pa.RecordBatch.from_arrays(
                [parts.take(pa.array(np.repeat(np.arange(len(parts)), 600))), pa.array(np.tile(orders, len(parts))), pa.array(np.tile(steps, len(parts)))] + [pa.array(found[c].reshape(-1)) for c in COUNTS],
                names=["part", "filter_order", "step", *COUNTS],
            )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS: 600 rows for each source of docs.

    A null source is the part of the empty string, as is an empty one. A null text is an empty one, of no
    words, and equals other empty ones. A row without doc_id is no copy and makes no other row one; rows
    that repeat the smallest doc_id of their text are no copies either. Several labels of a document count as
    one that has what any of them has; labels of no document or without id, null labels and other columns are of no
    effect. Texts count whole; no documents give no rows.
    """
    cells = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_products, SCHEMA)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
