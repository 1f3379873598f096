"""Centroid clustering in whole numbers, the same at any number of partitions.

Vectors become blocks of whole numbers. A block's squared distances to all centroids are
|x|^2 - 2 x.c + |c|^2, one product of matrices of doubles where a bound on magnitudes shows that every
term stays below 2^53 (so that doubles are exact), whole numbers otherwise. Sums and counts of each round
are combined by treeAggregate; only the centroids, k times 64 numbers, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, written
from .topk import usable, whole

#: Vectors a block.
BLOCK = 4096
_LONG = (1 << 63) - 1


def _big(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python's whole numbers."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _by_bound(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each row: 0 where doubles are exact, 1 where longs are, else 2. Each term and sum is at most width * (|x| + |c|)^2."""
    most = max((abs(int(v)) for v in centroids.ravel()), default=0)
    reach = (np.abs(x).max(axis=1, initial=0) + float(most)) ** 2 * x.shape[1] * (1 + 1e-9)
    return (reach >= 2.0**53).astype(int) + (reach >= 2.0**62)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row (the smallest of equals) and the squared distance, held to the range of a long.

    x: doubles that are whole numbers; centroids: Python's whole numbers.
    """
    at, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    tier = _by_bound(x, centroids)
    for level in np.unique(tier):
        rows = np.flatnonzero(tier == level)
        if level == 0:
            own, c = x[rows], centroids.astype(np.float64)
            d = (own**2).sum(axis=1)[:, None] - 2 * (own @ c.T) + (c**2).sum(axis=1)
        elif level == 1:
            own, c = x[rows].astype(np.int64), centroids.astype(np.int64)
            d = np.stack([((own - row) ** 2).sum(axis=1) for row in c], axis=1)
        else:
            own = _big(x[rows])
            d = np.stack([((own - row) ** 2).sum(axis=1) for row in centroids], axis=1)
        best = np.array([min(range(len(centroids)), key=row.__getitem__) for row in d]) if level == 2 else d.argmin(axis=1)
        at[rows] = best
        distance[rows] = [min(int(v), _LONG) for v in d[np.arange(len(rows)), best]]
    return at, distance


def _block(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, width)


def _packed(scale: int):
    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([whole(batch.slice(lo, BLOCK).column("vector"), scale).astype("<f8").tobytes()], pa.binary())], names=["block"])

    return pack


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each cluster, as Python's whole numbers, and their counts."""
    if np.abs(x).max(initial=0) * len(x) < 2.0**53:
        member = (at == np.arange(k)[:, None]).astype(np.float64)
        total = _big(member @ x)
    else:
        own, total = _big(x), np.zeros((k, x.shape[1]), dtype=object)
        np.add.at(total, at, own)
    return total, np.bincount(at, minlength=k)


def _moved(blocks, centroids: np.ndarray) -> np.ndarray:
    """One round: assigned to the nearest, each centroid that has vectors becomes the floor of their mean."""
    k, width = centroids.shape

    def add(state, raw):
        x = _block(raw, width)
        total, count = _sums(x, nearest(x, centroids)[0], k)
        return state[0] + total, state[1] + count

    zero = (np.zeros((k, width), dtype=object), np.zeros(k, np.int64))
    total, count = blocks.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return np.array([[int(s) // int(n) for s in row] if n else own for row, n, own in zip(total, count, centroids.tolist(), strict=True)], dtype=object).reshape(k, width)


def _inertia(blocks, centroids: np.ndarray) -> list[int]:
    """The distances of each cluster, summed."""
    k, width = centroids.shape

    def add(state, raw):
        at, distance = nearest(_block(raw, width), centroids)
        return [s + sum(distance[at == i].tolist()) for i, s in enumerate(state)]

    return blocks.treeAggregate([0] * k, add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])


def starts(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest lowercase-hex SHA-256 of `seed:id`, in that order; equal ids by their components."""
    chosen = vectors.where(F.col("vec_id").isNotNull()).withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy("_hash", "vector").limit(k).collect()
    return _big(np.floor(np.array([r["vector"] for r in chosen], np.float64) * scale)) if chosen else np.zeros((0, 0), dtype=object)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors of `width` components, none null, NaN or infinite, take part, as floor(scale * x); a repeated row
    counts each time. Fewer than k of them are all centroids. A vector without id is clustered but starts no
    centroid; where no vector has an id there are no centroids and no rows, as in an empty table. Of centroids
    at equal distance the smaller number wins; one without vectors stays where it is. Distances and sums of
    them beyond a long are held to its end. Other columns are not read.
    """
    rows = vectors.where(usable(vector_col) & (F.size(vector_col) == width)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = starts(rows, k, seed, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    packed = written(rows.mapInArrow(_packed(scale), "block binary"), "blocks")
    blocks = packed.rdd.map(lambda r: bytes(r.block))
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)
    own = _inertia(blocks, centroids)
    forget(packed)
    total, own = min(sum(own), _LONG), np.array([min(x, _LONG) for x in own], np.int64)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]

    def assign(batches):
        for batch in batches:
            at, distance = nearest(whole(batch.column("vector"), scale, width), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), pa.array(at), pa.array(distance), pa.array(own[at]), pa.array(np.full(len(at), total, np.int64)), pa.array([digest[i] for i in at.tolist()], pa.string())],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(assign, schema)


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return clustered(table(spark, sf_dir, "embeddings"))
