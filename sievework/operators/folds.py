"""Folds over a key's rows in order, for rules whose next step depends on the one before: a key's rows stream past, no task holds them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def ordered_fold(
    df: DataFrame, key: str, fields: Mapping[str, Column], out: Sequence[str] | Mapping[str, str | DataType], step: Callable[..., Iterable[tuple]], end: Callable[[dict], Iterable[tuple]] | None = None
) -> DataFrame:
    """key and columns of `out`: what step(state, *fields) yields for each row, and end(state) after a key's last.

    fields: named columns, by which in turn a key's rows are sorted; together they should be unique where order matters.
    out: names of fields whose types stay, or names with types. state is an empty dict for each key; nulls are a key.
    One shuffle by key and one sort, which spills; a worker holds a batch of rows and one state.
    """
    rows = df.select(df[key], *(c.alias(f"_f{i}") for i, c in enumerate(fields.values())))
    names = [f"_f{i}" for i in range(len(fields))]
    if isinstance(out, Mapping):
        shape = StructType([rows.schema[0]])
        for name, kind in out.items():
            shape.add(name, kind)
    else:
        at = list(fields)
        shape = StructType([rows.schema[0], *(StructField(name, rows.schema[1 + at.index(name)].dataType) for name in out)])

    types = [to_arrow_type(f.dataType) for f in shape.fields[1:]]

    def told(found, kind):
        columns = zip(*(x for _, x in found), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], kind), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=shape.names)

    def run(batches):
        now, state, begun, kind = None, {}, False, None
        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or k != now:
                    if begun and end:
                        found += zip(repeat(now), end(state))
                    now, state, begun = k, {}, True
                found += zip(repeat(k), step(state, *values))
            if found:
                yield told(found, kind)
        if begun and end and (found := list(zip(repeat(now), end(state)))):
            yield told(found, kind)

    return rows.repartition(key).sortWithinPartitions(key, *names).mapInArrow(run, shape)
