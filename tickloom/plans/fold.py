"""Ordered folds with constant memory.

Some recursions (smoothing, one position at a time, trailing floors) need the
state left by the row before. Rows are hashed by key and sorted within their
partition; Python then sees them in Arrow batches and keeps only the state of the
key at hand. A key of any length costs no memory, but it is one task's work, so
folds are put behind the aggregation that makes their input small.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrow types of the column types that folds return.
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}


def ordered_fold(df: DataFrame, key: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Iterator[tuple]], schema: str, finish: Callable[[Any], Iterator[tuple]] | None = None) -> DataFrame:
    """Rows of ``schema`` made by a fold over each key's rows in ``order``.

    ``start()`` makes a state, ``step(state, row)`` changes it and yields output
    tuples (row is a named tuple of all columns, None for null, structs as dicts),
    ``finish(state)`` may yield more behind the last row of a key. Null keys are a
    key of their own. ``schema`` uses the types of TYPES.
    """
    fields = [c.split() for c in schema.split(",")]
    columns, at = df.columns, [df.columns.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = namedtuple("Row", columns, rename=True)._make
        state, held = None, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(list(c), TYPES[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

        for batch in batches:
            out: list[tuple] = []
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                mine = [values[i] for i in at]
                if state is None or mine != held:
                    if state is not None and finish:
                        out.extend(finish(state))
                    state, held = start(), mine
                out.extend(step(state, make(values)))
            yield packed(out)
        if state is not None and finish:
            yield packed(list(finish(state)))

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
