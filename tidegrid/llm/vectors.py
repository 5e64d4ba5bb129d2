"""Vectors inside Arrow batches, and sums of matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a matrix that travel in one row of a partial sum.
CHUNK = 16


def width_of(df: DataFrame, vec_col: str) -> int:
    """The most frequent length of the vectors, of equally frequent ones the larger; 0 without vectors."""
    sizes = df.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).groupBy(F.size(vec_col).alias("width")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return top.width if top else 0


def matrix_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that are whole finite vectors of that length, those vectors as doubles)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    starts = np.cumsum(sizes) - sizes
    found = flat[starts[rows][:, None] + np.arange(width)] if len(rows) else np.empty((0, width))
    good = np.isfinite(found).all(axis=1)
    return rows[good], found[good]


def summed(df: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all tasks of a matrix that ``add`` fills from batches.

    Every task sends its own sum in short rows, which Spark adds up by place before and after the shuffle; the driver gets one
    matrix of that shape, whatever the number of rows and tasks.
    """
    n_rows, n_columns = shape
    chunks = -(-n_columns // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = np.zeros((n_rows, chunks * CHUNK)), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                add(own[:, :n_columns], batch)
        if seen:
            place = np.arange(n_rows * chunks)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, CHUNK, dtype=np.int32)), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), values], names=["place", "v"])

    parts = df.mapInArrow(run, "place long, v array<double>")
    out = np.zeros((n_rows * chunks, CHUNK))
    for row in parts.groupBy("place").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(CHUNK))).collect():
        out[row.place] = row[1:]
    return out.reshape(n_rows, chunks * CHUNK)[:, :n_columns]
