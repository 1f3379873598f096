"""Exact top-k search by inner product: branch and bound over dimensions in vertical layout.

Candidates stand column by column, a dimension a row. Scores grow by a block of dimensions at a time; what
the dimensions still to come can add is at most the product of the remaining masses (the norms of both
vectors' rests), so pairs that can't reach the query's k-th best score so far are dropped, and the rest
are gathered anew once they are few.

Spark deals candidates to groups of bounded bytes, every query to each group, and merges the groups' best.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions a block, queries and candidates looked at together, and candidates that give the first bound.
DIMENSIONS, QUERIES, CANDIDATES, FIRST = 8, 64, 8192, 1024
#: Bytes of candidates that a task holds; candidates below which groups aren't cut further; queries that one task answers.
GROUP_BYTES, LEAST_GROUP, TASK_QUERIES = 32 << 20, 512, 1 << 18
#: Products of components up to this size sum up exactly in doubles over 2^13 dimensions; others are taken as whole numbers of any size.
NARROW = 1 << 20
_LONG = (1 << 63) - 1
_NOTHING = -(1 << 63)

FOUND = "query_id long, _q long, vec_id long, score long"


def whole(vectors: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """A row of floor(scale * x) for each vector, filled up with zeros; doubles, whose values are whole numbers."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))))
    start = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(start, size)] = values
    return out


def usable(vector: str):
    """Not null, without null, NaN or infinite components."""
    return F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _wider(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Best:
    """The k best candidates of each of some queries: highest score, then smallest id, rows without id last."""

    def __init__(self, queries: int, k: int):
        self.k, self.bound = k, np.full(queries, _NOTHING, np.int64)
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, query, score, nameless, ids) -> None:
        """bound: the k-th best score of each query, once there are k."""
        q, s, no, i = (np.concatenate(x) for x in zip(self.rows, (query, score, nameless, ids), strict=True))
        # the complement turns the order round without overflow
        order = np.lexsort((i, no, ~s, q))
        q, s, no, i = q[order], s[order], no[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bound[q[last]] = s[last]
        self.rows = tuple(x[place < self.k] for x in (q, s, no, i))


class Group:
    """Candidates in vertical layout: narrow ones as columns of doubles with the masses of their rests, others as rows."""

    def __init__(self, ids: np.ndarray, nameless: np.ndarray, vectors: np.ndarray):
        narrow = (np.abs(vectors) <= NARROW).all(axis=1) & (vectors.shape[1] <= 1 << 13)
        self.ids, self.nameless = ids[narrow], nameless[narrow]
        self.columns = np.ascontiguousarray(vectors[narrow].T)
        self.rest = _rests(self.columns.T).T
        self.wide_ids, self.wide_nameless, self.wide = ids[~narrow], nameless[~narrow], vectors[~narrow]

    def answer(self, qid: np.ndarray, q: np.ndarray, k: int) -> Best:
        best = Best(len(q), k)
        width = max(q.shape[1], len(self.columns), self.wide.shape[1])
        narrow = (np.abs(q) <= NARROW).all(axis=1) & (width <= 1 << 13)
        near, far = np.flatnonzero(narrow), np.flatnonzero(~narrow)
        if len(near):
            own = q[near][:, : len(self.columns)]
            self._bounded(best, near, qid[near], _wider(own, len(self.columns)))
            _by_whole_numbers(best, near, qid, q, self.wide_ids, self.wide_nameless, self.wide)
        if len(far):
            _by_whole_numbers(best, far, qid, q, self.ids, self.nameless, self.columns.T)
            _by_whole_numbers(best, far, qid, q, self.wide_ids, self.wide_nameless, self.wide)
        return best

    def _bounded(self, best: Best, near: np.ndarray, qid: np.ndarray, q: np.ndarray) -> None:
        rest, dims = _rests(q), len(self.columns)
        edges = [0, *range(min(FIRST, len(self.ids)), len(self.ids), CANDIDATES), len(self.ids)]
        for lo, hi in pairwise(edges):
            if lo == hi:
                continue
            columns, ids, c_rest = self.columns[:, lo:hi], self.ids[lo:hi], self.rest[:, lo:hi]
            bound = best.bound[near]
            score, pairs = np.zeros((len(q), hi - lo)), None
            for b, d in enumerate(range(0, dims, DIMENSIONS)):
                block = slice(d, min(d + DIMENSIONS, dims))
                if pairs is None:
                    score += q[:, block] @ columns[block]
                    if (bound == _NOTHING).any():
                        continue
                    alive = score + rest[:, b + 1, None] * c_rest[b + 1] >= bound[:, None]
                    if 8 * np.count_nonzero(alive) < alive.size:
                        pairs = np.nonzero(alive)
                        score = score[pairs]
                else:
                    i, j = pairs
                    score = score + np.einsum("pd,dp->p", q[i, block], columns[block][:, j])
                    alive = score + rest[i, b + 1] * c_rest[b + 1, j] >= bound[i]
                    pairs, score = (i[alive], j[alive]), score[alive]
            if pairs is None:
                # of whole rows only what can be among the k best goes on
                score[(qid[:, None] == ids) & ~self.nameless[lo:hi]] = -np.inf
                least = np.maximum(np.partition(score, -best.k, axis=1)[:, -best.k], bound) if hi - lo >= best.k else np.full(len(q), -np.inf)
                pairs = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                score = score[pairs]
            i, j = pairs
            other = (ids[j] != qid[i]) | self.nameless[lo:hi][j]
            i, j, score = i[other], j[other], score[other]
            best.add(near[i], score.astype(np.int64), self.nameless[lo:hi][j], ids[j])


def _rests(x: np.ndarray) -> np.ndarray:
    """Norms of what follows each block of dimensions, a little too large rather than too small; a column for each border."""
    edges = [*range(0, x.shape[1], DIMENSIONS), x.shape[1]]
    squares = np.stack([(x[:, e:] ** 2).sum(axis=1) for e in edges], axis=1)
    return np.sqrt(squares) * (1 + 1e-9)


def _by_whole_numbers(best: Best, which: np.ndarray, qid, q, ids, nameless, vectors) -> None:
    """All scores by Python's whole numbers, brought into the range of a long."""
    if not len(ids):
        return
    width = max(q.shape[1], vectors.shape[1])
    of = lambda x: np.array([[int(v) for v in row] for row in _wider(x, width)], dtype=object).reshape(len(x), width)
    right = of(vectors)
    for i in which.tolist():
        score = (right @ of(q[i : i + 1])[0]).tolist() if width else [0] * len(ids)
        score = np.array([min(max(int(s), -_LONG), _LONG) for s in score], np.int64)
        other = (ids != qid[i]) | nameless
        best.add(np.full(other.sum(), i), score[other], nameless[other], ids[other])


def _search(k: int, scale: int):
    def search(batches):
        group, have, held = None, [], None
        for batch in batches:
            key = np.stack([batch.column("_group").to_numpy(), batch.column("_kind").to_numpy()])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
                for at in range(lo, hi, CANDIDATES if key[1, lo] == 0 else QUERIES):
                    part = batch.slice(at, min(CANDIDATES if key[1, lo] == 0 else QUERIES, hi - at))
                    ids = part.column("vec_id")
                    named = (pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), whole(part.column("vector"), scale))
                    if key[1, lo] == 0:
                        if key[0, lo] != group:
                            group, have, held = key[0, lo], [], None
                        have.append(named)
                    elif key[0, lo] == group:
                        if held is None:
                            width = max(x.shape[1] for _, _, x in have)
                            held = Group(np.concatenate([x[0] for x in have]), np.concatenate([x[1] for x in have]), np.concatenate([_wider(x[2], width) for x in have]))
                            have = []
                        i, score, nameless, found = held.answer(named[0], named[2], k).rows
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), part.column("_q").take(pa.array(i)), pa.array(found, mask=nameless), pa.array(score)], names=["query_id", "_q", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the highest inner product with each row of queries.

    Components count as floor(scale * x); ties go to the smaller id, rows without id come last among them.
    Rows of the query's own id aren't its candidates; a repeated query row is one query; a repeated candidate
    is found as often as it stands there. Vectors that are null or hold null, NaN or infinite components take
    no part; a shorter vector is filled up with zeros (an empty one scores 0). Scores outside the range of a
    long count as its ends. Fewer than k candidates are all returned; no queries or no vectors give no rows.
    Ids are whole numbers. Other columns are not read.
    """
    spark = vectors.sparkSession
    keep = lambda df: df.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows, asked = keep(vectors), keep(queries).groupBy("vec_id", "vector").agg(F.xxhash64(F.first("vector")).alias("_q"))
    n, components = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-8 * components // GROUP_BYTES), min(partitions, -(-n // LEAST_GROUP)))
    turns = max(1, -(-asked.count() // TASK_QUERIES))
    # a row's number, not its id, deals it: no id or vector that is often repeated makes a group larger
    dealt = rows.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    dealt = dealt.select("vec_id", "vector", F.lit(None).cast("long").alias("_q"), F.lit(0).alias("_kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("_turn"), "_g")
    each = asked.select("vec_id", "vector", "_q", F.lit(1).alias("_kind"), F.pmod("_q", F.lit(turns)).cast("long").alias("_turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("_g"))
    met = dealt.unionByName(each).withColumn("_group", F.col("_g") * turns + F.col("_turn")).drop("_g", "_turn")
    found = met.repartition(groups * turns, "_group").sortWithinPartitions("_group", "_kind").mapInArrow(_search(k, scale), FOUND)
    order = Window.partitionBy("query_id", "_q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
