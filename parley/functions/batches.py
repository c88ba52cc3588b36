"""Arrow batches in Python: only some rows at a time are Python objects, the rest of a batch stays in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are Python objects at a time.
ROWS = 256


def slices(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """The columns, some rows at a time; an empty batch is one slice."""
    for k in range(0, max(len(columns[0]), 1), ROWS):
        yield [c.slice(k, ROWS) for c in columns]


def mapped(function: Callable, kind: pa.DataType, column: pa.Array) -> pa.Array:
    """``function`` of each value, null for null."""
    return pa.concat_arrays([pa.array([None if v is None else function(v) for v in part.to_pylist()], kind) for (part,) in slices(column)])


def of_text(function: Callable[[str], str]):
    """A function from text to text, for columns."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return mapped(function, pa.string(), column)

    return run
