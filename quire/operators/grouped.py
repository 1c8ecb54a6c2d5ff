"""Folds over groups in Arrow batches: many small groups share a batch, so no group pays for a call or a frame of its own."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def values(c: pa.Array) -> list:
    """The Python values of an Arrow array, as to_pylist gives them: numbers, truths and texts through NumPy, lists by their elements, all else one by one."""
    kind = c.type
    if pa.types.is_list(kind):
        flat, at, out = values(c.flatten()), 0, []
        for n in values(c.value_lengths()):
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_string(kind):
        return c.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return c.to_pylist()
    if not c.null_count:
        return c.to_numpy(zero_copy_only=False).tolist()
    filled = c.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
    for i in c.is_null().to_numpy(zero_copy_only=False).nonzero()[0]:
        filled[i] = None
    return filled


def by_group(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str, held: int = 4096) -> DataFrame:
    """fold(rows of one group, in order) for each group of df, as rows of `schema`.

    One exchange deals rows out by key and one sort puts groups side by side; a task then reads its groups in turn and holds the rows
    of one group at a time. fold gets named tuples and returns tuples. A document is such a group: its pages, lines or nodes.
    """
    kind = StructType.fromDDL(schema)
    names = [*keys, *(c for c in df.columns if c not in keys)]
    width = len(keys)

    def run(batches):
        arrow = to_arrow_schema(kind)
        row, group, out = namedtuple("Row", names, rename=True), [], []

        def told():
            columns = list(zip(*out)) or [()] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            out.clear()
            return batch

        for b in batches:
            for found in zip(*(values(c) for c in b.columns)):
                if group and found[:width] != group[0][:width]:
                    out.extend(fold(group))
                    group = []
                    if len(out) >= held:
                        yield told()
                group.append(row._make(found))
        if group:
            out.extend(fold(group))
        yield told()

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
