"""Whole texts through Arrow, a few neighbours at a time, by a worker that a task makes for itself."""

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

#: Bytes of neighbouring texts that are worked on together.
SLICE = 1 << 20


def spans(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbours of together about ``most``; a larger one is alone."""
    at = 0
    while at < len(sizes):
        stop, held = at, 0
        while stop < len(sizes) and (stop == at or held + sizes[stop] <= most):
            held += sizes[stop]
            stop += 1
        yield at, stop
        at = stop


def by_slice(rows: DataFrame, columns: dict[str, Column], sized_by: int, schema: StructType, make: Callable, most: int = SLICE) -> DataFrame:
    """Rows of ``schema``: ``make()`` gives a task its worker, and ``worker(*arrays)`` the output arrays for the ``columns``
    of a few neighbouring rows, whose string column number ``sized_by`` is together about ``most`` bytes."""
    names = schema.names

    def run(batches):
        worker = make()
        for batch in batches:
            arrays = batch.columns
            for lo, hi in spans(pc.fill_null(pc.binary_length(arrays[sized_by]), 0).to_pylist(), most):
                yield pa.RecordBatch.from_arrays(worker(*[a.slice(lo, hi - lo) for a in arrays]), names=names)

    return rows.select(*[c.alias(f"_{i}") for i, c in enumerate(columns.values())]).mapInArrow(run, schema)
