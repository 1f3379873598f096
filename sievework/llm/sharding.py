"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Every row gets a global row number in [0, n); a keyed permutation of [0, n) gives its shuffled
position; shard = position mod shards, slot = position div shards. Neither a global sort nor a
state is needed, and position -> row number is computable by the inverse.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import mix

_U = np.uint64


def _halves(n: int) -> int:
    """Bits of a half, so that 2 halves hold 0 .. n - 1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    return mix(half + key) & _U((1 << bits) - 1)


def _keys(seed: int, rounds: int) -> np.ndarray:
    return mix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed % (1 << 64)))


def _feistel(x: np.ndarray, bits: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = _U((1 << bits) - 1)
    left, right = x >> _U(bits), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ _round(left, k, bits), left
        else:
            left, right = right, left ^ _round(right, k, bits)
    return (left << _U(bits)) | right


def permute(x: np.ndarray, n: int, seed: int = 0, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The permutation of [0, n) that seed names, or its inverse, at each x; walks on while outside [0, n)."""
    x = np.asarray(x).astype(_U)
    if n <= 1 or not len(x):
        return x.astype(np.int64)
    bits, keys = _halves(n), _keys(seed, rounds)
    out = _feistel(x, bits, keys, back)
    while len(far := np.flatnonzero(out >= _U(n))):
        out[far] = _feistel(out[far], bits, keys, back)
    return out.astype(np.int64)


def permuted(x: Column, n: Column, seed: int = 0) -> Column:
    """permute() as a column; n is the same in all rows."""

    @F.pandas_udf("long")
    def at(x: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        for m in n.unique():
            own = (n == m).to_numpy()
            out[own] = permute(x[own].to_numpy(), int(m), seed)
        return pd.Series(out)

    return at(x, n)


def numbered(rows: DataFrame, keys: list[str], number: str, total: str, bins: int = 1024) -> DataFrame:
    """Adds a global row number from 0 and the number of rows.

    The order is by a hash bin, then by keys. Equal rows count once with their multiplicity, so a row
    repeated any number of times stays one record through both shuffles and is unfolded last.
    The table of bins, `bins` rows at most, is the only thing broadcast.
    """
    from .tables import written

    # read once, then used twice: for the bins' sizes and for the numbers
    copies = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")), "rows")
    copies = copies.withColumn("_bin", F.pmod(F.xxhash64(*keys), F.lit(bins)).cast("int"))
    size = copies.groupBy("_bin").agg(F.sum("_copies").alias("_size"))
    every = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offset = size.select("_bin", F.coalesce(F.sum("_size").over(every), F.lit(0)).alias("_offset"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias(total))
    order = [F.col(k).asc_nulls_first() for k in keys]
    before = Window.partitionBy("_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = copies.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    out = out.join(F.broadcast(offset), "_bin")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return out.select(*keys, (F.col("_offset") + F.col("_before") + F.col("_copy")).alias(number), F.col(total))


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, shard and slot of every row of docs.

    Size is the text's UTF-8 bytes plus 1. Shards' row counts differ by one at most; slots are gapless
    from 0. A null text is an empty one (size 1, crc32 0); a text of any length counts whole; a null id is
    a value like others; repeated rows each get their own slot, and rows of equal id, size and crc32 are
    interchangeable; an empty table gives none. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = numbered(rows, ["doc_id", "size", "text_crc32"], "row", "_n")
    out = out.withColumn("_at", permuted(F.col("row"), F.col("_n"), seed))
    return out.select("doc_id", "size", "text_crc32", "row", F.pmod("_at", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_at") / shards).cast("long").alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
