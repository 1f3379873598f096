"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents, in a fixed order, are one run of tokens cut in blocks of equal size (BLOCK; a source
too small for that has a smaller block of its own, and its seats count those). Seats (blocks to
take) go to sources by the highest quotients target / (2 seats + 1). As that rule is
house-monotone, the seats of the first k shards are a prefix of those of the first k + 1: their
differences are each shard's integer quotas. Seat j of a source takes block perm(j mod blocks),
where perm is a seeded permutation, so a source of more seats than blocks repeats blocks evenly.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .arrowtext import slices, sums, texts_of, words_of
from .sharding import permute

#: Sources are a dimension that the driver plans over; beyond this many it refuses instead of failing later.
MOST_SOURCES = 200_000


@dataclass(frozen=True)
class Plan:
    """Of one source: size and target in tokens, tokens a block, blocks it has, seats it gets, seats up to and including each shard."""

    source: str | None
    size: int
    target: float
    block: int
    blocks: int
    seats: int
    upto: tuple[int, ...]
    seed: int


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share x all tokens by weight; a target stops at most x its source's size, its excess goes to the others by weight."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left = total - sum(out)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2 seats + 1); ties go to the earlier one.

    A divisor near the answer gives all but a few seats at once; a heap hands out or takes back the rest.
    """
    whole = sum(weights)
    if whole <= 0 or seats <= 0:
        return [0] * len(weights)
    out = [max(0, int(seats * w / whole + 0.5) - 1) for w in weights]
    add = [(-w / (2 * n + 1), i) for i, (w, n) in enumerate(zip(weights, out, strict=True)) if w > 0]
    heapq.heapify(add)
    for _ in range(seats - sum(out)):
        _, i = add[0]
        out[i] += 1
        heapq.heapreplace(add, (-weights[i] / (2 * out[i] + 1), i))
    # a start below the answer may still exceed it for one party: move seats while a held quotient is below an open one
    while True:
        held = [(weights[i] / (2 * n - 1), -i) for i, n in enumerate(out) if n > 0]
        free = [(weights[i] / (2 * n + 1), -i) for i, n in enumerate(out) if weights[i] > 0]
        if not held or min(held) >= max(free):
            return out
        out[-min(held)[1]] -= 1
        out[-max(free)[1]] += 1


#: Tokens a block.
BLOCK = 512
#: A source that has fewer blocks than this is cut in smaller ones of its own, so that it can meet its target.
LEAST_BLOCKS = 64


def own_block(size: int, block: int = BLOCK) -> int:
    """Tokens a block of a source of that size; other sources have no part in it."""
    return max(1, min(block, size // LEAST_BLOCKS))


def plan(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 0) -> list[Plan]:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    size = [sizes[s] for s in names]
    target = targets(size, [float(weights[i % len(weights)]) for i in range(len(names))], share, most)
    block = [own_block(n) for n in size]
    blocks = [-(-n // own) for n, own in zip(size, block, strict=True)]
    claim = [t * b / n if n else 0.0 for t, b, n in zip(target, blocks, size, strict=True)]
    seats = round(sum(claim))
    upto = [sainte_lague(claim, seats * (k + 1) // shards) for k in range(shards)]
    return [Plan(s, size[i], target[i], block[i], blocks[i], min(upto[-1][i], int(most * blocks[i])), tuple(u[i] for u in upto), seed + 1 + i) for i, s in enumerate(names)]


def taken(start: np.ndarray, size: np.ndarray, source: np.ndarray, plans: list[Plan]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each overlap of a document with a block: its document, first and end token within it, the times it is taken, and the first seat that takes it."""
    block = np.array([p.block for p in plans], np.int64)[source]
    first = start // block
    many = np.where(size > 0, (start + size - 1) // block - first + 1, 0)
    doc = np.repeat(np.arange(len(start)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    low = np.maximum(at * block[doc], start[doc]) - start[doc]
    high = np.minimum((at + 1) * block[doc], start[doc] + size[doc]) - start[doc]
    times, seats = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    of = source[doc]
    for s in np.unique(of):
        p, own = plans[s], of == s
        if p.blocks:
            seat = permute(at[own], p.blocks, p.seed, back=True)
            times[own] = np.maximum(0, -(-(p.seats - seat) // p.blocks))
            seats[own] = seat
    return doc, low, high, times, seats


def dealt(doc: np.ndarray, words: np.ndarray, times: np.ndarray, seats: np.ndarray, source: np.ndarray, plans: list[Plan]) -> np.ndarray:
    """Words that each shard takes of each document (a row of shards): seat j belongs to the first shard k whose upto[k] is above j."""
    shards = len(plans[0].upto) if plans else 0
    out = np.zeros((len(source), shards), np.int64)
    each = np.repeat(np.arange(len(doc)), times)
    turn = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    of = source[doc[each]]
    for s in np.unique(of):
        own = of == s
        at = each[own]
        k = np.searchsorted(np.array(plans[s].upto), seats[at] + turn[own] * plans[s].blocks, side="right")
        np.add.at(out, (doc[at], k), words[at])
    return out


def placed(docs: DataFrame, source: Column, size: Column, keys: list[str], bins: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Each row's first token in its source's run, and each source's size. Runs are ordered by hash bin, then by keys.

    Only the sums of bins meet in one place, never a source's rows.
    """
    rows = docs.withColumn("_source", source).withColumn("_size", size).withColumn("_bin", F.pmod(F.xxhash64(*keys), F.lit(bins)).cast("int"))
    own = Window.partitionBy("_source", "_bin").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    bin_ = docs.select(source.alias("_s"), size.alias("_size"), F.pmod(F.xxhash64(*keys), F.lit(bins)).cast("int").alias("_b")).groupBy("_s", "_b").agg(F.sum("_size").alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bin_ = bin_.select("_s", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"), "_n")
    return rows, bin_


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size (words) and crc (of the text) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))

    def count(batches):
        for whole in batches:
            for b in slices(whole):
                t = texts_of(b.column(2))
                crc = [zlib.crc32(t.buf[i:j]) for i, j in zip(t.offsets[:-1], t.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words_of(t).counts(), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "source", "size", "crc"])

    schema = StructType([*rows.schema.fields[:2], StructField("size", LongType()), StructField("crc", LongType())])
    return rows.mapInArrow(count, schema)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (words), source, source_size, target (its source's, in words), taken and shard_words (array<long>) of every row.

    Weights repeat over sources in code point order, null last. taken counts repeats and is at most `most`
    x size; shard_words has the words of it that each shard takes. A null or empty text has size 0 and is
    never taken; a text of any length is counted whole and cut where blocks end; a null source is a source;
    repeated rows are rows like others, and which of them a block falls on is arbitrary; an empty table
    gives none. Other columns are not read.
    """
    from .tables import written

    spark = docs.sparkSession
    rows = written(measured(docs, id_col, text_col, source_col), "mix-sizes")
    return _mix(spark, rows, weights, share, most, shards, seed)


def _sizes(rows: DataFrame) -> dict[str | None, int]:
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them into fewer before mixing")
    return {r["source"]: int(r["n"] or 0) for r in found}


def _mix(spark, rows: DataFrame, weights, share, most, shards, seed, extra: tuple[str, ...] = ()) -> DataFrame:
    plans = plan(_sizes(rows), weights, share, most, shards, seed)
    known = spark.createDataFrame([(i, p.source, p.size, p.target) for i, p in enumerate(plans)], "_k int, _name string, source_size long, target double")
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_name")))
    with_bins, bins = placed(rows, F.col("_k"), F.col("size"), ["doc_id", "crc", "size"])
    joined = with_bins.join(bins, (F.col("_source") == F.col("_s")) & (F.col("_bin") == F.col("_b")))
    joined = joined.select("doc_id", "source", "size", "source_size", "target", F.col("_source").alias("k"), (F.col("_offset") + F.col("_before")).alias("start"), *extra)

    def take(batches):
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            start, size = col("start").astype(np.int64), col("size").astype(np.int64)
            k = col("k").astype(np.int64)
            doc, low, high, times, seats = taken(start, size, k, plans)
            got = sums((high - low) * times, np.searchsorted(doc, np.arange(len(start) + 1)))
            words = dealt(doc, high - low, times, seats, k, plans)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * words.shape[1], pa.int32()), pa.array(words.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64()), lists], names=[*b.schema.names, "taken", "shard_words"])

    return joined.mapInArrow(take, StructType([*joined.schema.fields, StructField("taken", LongType()), StructField("shard_words", ArrayType(LongType()))]))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard_words")


def mixed_documents(docs: DataFrame, seed: int = 0, **rules) -> DataFrame:
    """The mix itself, with the columns of docs: a document's text is what the mix takes of it, once for each time.

    The first row of a document has the words of blocks taken at least once, a second those taken twice.
    Words not cut keep what stands between them; a document of which nothing is taken has no row, nor has a
    null or empty text. Long texts are cut where blocks end; a null source is a source; repeated rows are
    rows like others; an empty table stays empty. Columns of docs keep their names and values.
    """
    from .tables import written

    spark, given = docs.sparkSession, docs.columns
    # the columns have names of their own in here, so none of docs can clash
    docs = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "source") else f"given {i}") for i, c in enumerate(given)))
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = written(measured(docs, "doc_id", "text", "source"), "mix-sizes")
    plans = plan(_sizes(sizes), seed=seed, **rules)
    known = spark.createDataFrame([(i, p.source) for i, p in enumerate(plans)], "_k int, _name string")
    keyed = lambda d: d.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    with_bins, bins = placed(keyed(sizes), F.col("_k"), F.col("size"), ["doc_id", "crc", "size"])
    start = with_bins.join(bins, (F.col("_source") == F.col("_s")) & (F.col("_bin") == F.col("_b"))).select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), F.col("_source").alias("_k"), (F.col("_offset") + F.col("_before")).alias("_start"))
    start = start.groupBy("_id", "_crc", "_k").agg(F.sort_array(F.collect_list("_start")).alias("_starts"))
    full = keyed(docs.withColumn("_crc", F.crc32(text.cast("binary"))))
    own = Window.partitionBy("doc_id", "_crc", "_k").orderBy(F.lit(0))
    full = full.withColumn("_copy", F.row_number().over(own))
    full = full.join(start.withColumnRenamed("_crc", "_c").withColumnRenamed("_k", "_kk"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_c")) & (F.col("_k") == F.col("_kk")))
    full = full.select(*names, "_k", F.element_at("_starts", F.col("_copy")).alias("_start"))

    def cut(batches):
        for whole in batches:
            for b in slices(whole):
                t = texts_of(b.column(b.schema.get_field_index("text")))
                w = words_of(t)
                size = w.counts().astype(np.int64)
                start = b.column(b.schema.get_field_index("_start")).to_numpy(zero_copy_only=False).astype(np.int64)
                k = b.column(b.schema.get_field_index("_k")).to_numpy(zero_copy_only=False).astype(np.int64)
                doc, low, high, times, _ = taken(start, size, k, plans)
                rows, texts = [], []
                at = np.searchsorted(doc, np.arange(len(start) + 1))
                for i in range(len(start)):
                    lo, hi, n = low[at[i] : at[i + 1]], high[at[i] : at[i + 1]], times[at[i] : at[i + 1]]
                    for copy in range(1, int(n.max(initial=0)) + 1):
                        keep = n >= copy
                        if keep.all():
                            texts.append(t.raw(i).decode())
                        else:
                            texts.append(_pieces(t, w, w.first[i], lo[keep], hi[keep]))
                        rows.append(i)
                out = b.take(pa.array(rows, pa.int64())).select(names)
                j = names.index("text")
                yield pa.RecordBatch.from_arrays([pa.array(texts, out.column(j).type) if c == j else out.column(c) for c in range(len(names))], names=names)

    return full.mapInArrow(cut, docs.schema).toDF(*given)


def _pieces(t, w, first: int, low: np.ndarray, high: np.ndarray) -> str:
    """Neighbouring kept blocks stay one piece with what stands between their words; pieces are joined by a newline."""
    out, i = [], 0
    while i < len(low):
        j = i
        while j + 1 < len(low) and low[j + 1] == high[j]:
            j += 1
        out.append(t.buf[w.start[first + low[i]] : w.end[first + high[j] - 1]].tobytes().decode())
        i = j + 1
    return "\n".join(out)
