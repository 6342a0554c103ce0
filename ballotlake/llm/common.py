"""Helpers shared by the operators: bounded batches, scratch tables, number tables summed over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.settle import settle

#: Bytes of text that a task works on at once; one longer document is a piece of its own.
PIECE_BYTES = 4 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the plan is cut, and its size is known.

    The folder is the one of ``functions.settle``: guarded on a cluster, and removed when the driver's JVM ends.
    """
    return settle(df, f"llm-{name}")


def of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dot in the name a field of a struct column."""
    column, _, field = name.partition(".")
    return batch.column(column).field(field) if field else batch.column(column)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = of(batch, text).cast(pa.binary())
    ends = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(sizes), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def offsets(counts) -> np.ndarray:
    """Where each of the consecutive groups starts, and the end of the last."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def summed_rows(df: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of (key, c0 ... c<width-1>) added up by key, partly before the shuffle."""
    return df.groupBy(key).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])


def number_rows(key: str, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """The rows ``summed_rows`` takes, from a matrix."""
    columns = [pa.array(keys.astype(np.int32))] + [pa.array(np.ascontiguousarray(values[:, i], np.float64)) for i in range(values.shape[1])]
    return pa.RecordBatch.from_arrays(columns, [key] + [f"c{i}" for i in range(values.shape[1])])


def number_schema(key: str, width: int) -> str:
    return f"{key} int, " + ", ".join(f"c{i} double" for i in range(width))


def matrix(df: DataFrame, key: str, rows: int, width: int) -> np.ndarray:
    """A table of ``summed_rows`` as a matrix; ``rows`` times ``width`` is its bound."""
    out = np.zeros((rows, width))
    table = df.toArrow()
    if table.num_rows:
        at = table.column(key).to_numpy()
        for i in range(width):
            out[at, i] = table.column(f"c{i}").to_numpy()
    return out


def with_row(docs: DataFrame) -> DataFrame:
    """The whole row as a struct, so that no clashing name can get in the way and no text travels twice."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
