"""Long ordered series cut into pieces over range partitions.

A series may be longer than any task can hold. Its samples are dealt by ranges of (keys, order), so that neighbours stay together, and
packed into pieces of at most PIECE samples, each a row (keys, chunk, piece, n, arrays of values). Pieces of a series
are ordered by (chunk, piece); the table is written once, so that all later passes see the same cut. What a piece must know of those before
it (its place in the series, a filter's state, the last samples) is found from one small row for each piece, in two levels: first inside a
chunk, then over the chunks, which are as many as partitions; samples never leave their piece for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.sources.shared import written

#: Samples of a piece, at most.
PIECE = 65_536
PLACE = ("__chunk", "__piece")


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal keys in a sorted batch, and the number of rows."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(change), batch.num_rows)


def pack(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], partitions: int | None = None, size: int = PIECE) -> DataFrame:
    """(keys, __chunk, __piece, n, columns as arrays): pieces of each series in the order of ``order``, written."""
    kept = df.select(*keys, *order, *(c for c in columns if c not in {*keys, *order}))
    ranges = [*keys, *order]
    dealt = (kept.repartitionByRange(partitions, *ranges) if partitions else kept.repartitionByRange(*ranges)).sortWithinPartitions(*ranges)
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    layout = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("__chunk", T.IntegerType()), T.StructField("__piece", T.IntegerType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.ArrayType(kinds[c])) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = _runs(batch, keys)
            cuts = np.unique(np.concatenate([starts, *(np.arange(a, b, size) for a, b in zip(starts[:-1], starts[1:], strict=True))])).astype(np.int32)
            n = len(cuts) - 1
            at = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            first = pa.array(cuts[:-1])
            parts = [*(at(k).take(first) for k in keys), pa.array(np.full(n, chunk, np.int32)), pa.array(np.arange(piece, piece + n, dtype=np.int32)), pa.array(np.diff(cuts))]
            parts += [pa.ListArray.from_arrays(pa.array(cuts), at(c)) for c in columns]
            piece += n
            yield pa.RecordBatch.from_arrays(parts, names=[f.name for f in layout])

    return written(dealt.mapInArrow(run, layout), "pieces")


def same(keys: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """Join condition of two tables of pieces; null keys meet."""
    out = F.lit(True)
    for k in (*keys, *PLACE):
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def offsets(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, place, n, offset, total): how many samples of its series stand before each piece, and how many the series has."""
    facts = pieces.select(*keys, *PLACE, F.col("n").cast("long").alias("n"))
    chunks = facts.groupBy(*keys, "__chunk").agg(F.sum("n").alias("__own"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"__before": F.coalesce(F.sum("__own").over(before), F.lit(0)), "total": F.sum("__own").over(Window.partitionBy(*keys))}).drop("__own")
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    own = facts.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    on = F.lit(True)
    for k in (*keys, "__chunk"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = own.alias("a").join(chunks.alias("b"), on)
    return joined.select(*(f"a.{c}" for c in (*keys, *PLACE, "n")), (F.col("b.__before") + F.col("a.__inside")).alias("offset"), F.col("b.total").alias("total"))


def halo(pieces: DataFrame, keys: Sequence[str], column: str, k: int) -> DataFrame:
    """pieces with ``__halo``: the last k samples of the series before each piece (fewer at its start).

    Only the last k samples of every piece move: at most k pieces are looked back on, as each has a sample at least. A chunk's own
    tail stands for it to the chunks behind.
    """
    tails = pieces.select(*keys, *PLACE, F.slice(column, F.greatest(F.size(column) - k + 1, F.lit(1)), k).alias("__tail"))
    last = lambda x: F.slice(x, F.greatest(F.size(x) - k + 1, F.lit(1)), k)
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__piece")
    own = tails.withColumn("__in", F.flatten(F.collect_list("__tail").over(inside.rowsBetween(-k, -1))))
    ends = own.groupBy(*keys, "__chunk").agg(F.max_by(last(F.concat("__in", "__tail")), "__piece").alias("__end"))
    over = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(-k, -1)
    ends = ends.withColumn("__end", last(F.flatten(F.collect_list("__end").over(over))))
    on = F.lit(True)
    for c in (*keys, "__chunk"):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    found = own.alias("a").join(ends.alias("b"), on).select(*(f"a.{c}" for c in (*keys, *PLACE)), last(F.concat("b.__end", "a.__in")).alias("__halo"))
    return pieces.alias("a").join(found.alias("b"), same(keys)).select("a.*", "b.__halo")


def unpack(pieces: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each sample again."""
    zipped = F.explode(F.arrays_zip(*columns)).alias("__s")
    return pieces.select(*keys, zipped).select(*keys, *(F.col(f"__s.{c}").alias(c) for c in columns))
