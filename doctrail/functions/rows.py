"""Row-wise Python over Arrow batches, for what no built-in function expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Output rows held before a batch is handed on, and input bytes that are worked on at once.
FLUSH, BYTES = 2048, 4 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about BYTES bytes at most, a row at least."""
    for b in batches:
        step = max(1, b.num_rows * BYTES // max(1, b.nbytes))
        yield from (b.slice(k, step) for k in range(0, b.num_rows, step))


def flat_map(df: DataFrame, inputs: list[str], work: Callable[..., Iterable[tuple]], schema: str, keep: list[str] = ()) -> DataFrame:
    """``keep`` and the columns of ``schema``, a row for each tuple that ``work`` gives for the inputs of a row.

    Only the columns named are read. Batches are bounded on both sides, and what
    is worked on at once in bytes too, so memory does not follow the size of a
    partition.
    """
    out = StructType([df.schema[x] for x in keep] + StructType.fromDDL(schema).fields)
    fields = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)
            rows.clear()
            return made

        for b in _slices(batches):
            kept = list(zip(*(b.column(x).to_pylist() for x in keep), strict=True)) if keep else [()] * b.num_rows
            for k, given in zip(kept, zip(*(b.column(x).to_pylist() for x in inputs), strict=True), strict=True):
                rows += [(*k, *x) for x in work(*given)]
                if len(rows) >= FLUSH:
                    yield batch()
            if rows:
                yield batch()

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, out)


def row_map(df: DataFrame, inputs: list[str], work: Callable[..., Any], column: str, kind: str, keep: list[str] = ()) -> DataFrame:
    """``keep`` and one new column, computed from the inputs of each row."""
    return flat_map(df, inputs, lambda *x: [(work(*x),)], f"{column} {kind}", keep)
