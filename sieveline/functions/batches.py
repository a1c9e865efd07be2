"""Arrow batches worked on in slices of bounded size, so that a task's Python never holds a batch's values as objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sieveline.session import ship

#: Most rows and bytes of a slice; a larger row is a slice of its own.
ROWS, BYTES = 256, 1 << 19


def slices(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows and, but for single rows, about ``size`` bytes."""
    waiting = [batch]
    while waiting:
        part = waiting.pop()
        if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > size):
            half = part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


def each_value(f: Callable, kind: T.DataType, *columns: Column) -> Column:
    """``f`` of the values of ``columns`` in each row, as a column of ``kind``."""
    ship(SparkSession.active())
    out = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            arrays = (arrays,) if isinstance(arrays, pa.Array) else arrays  # a single column comes as it is
            whole = pa.RecordBatch.from_arrays(list(arrays), names=[str(i) for i in range(len(arrays))])
            for part in slices(whole):
                yield pa.array([f(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)], out)
            if not whole.num_rows:
                yield pa.array([], out)

    return read(*columns)


def expanded(ids: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``ids``, value) for each of the ``values[starts[i]:starts[i + 1]]`` of each i of ``ids``."""
    lengths = starts[ids + 1] - starts[ids]
    place = np.repeat(np.arange(len(ids)), lengths)
    first = np.repeat(starts[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else ids, lengths)
    return place, values[first + np.arange(len(first))]
