"""Correlations of many channels: co-moment matrices by group.

Channels are the elements of an array column. A first aggregate gives each group's means; then every task adds up the products of its rows'
distances from these means as one matrix for each group, in Arrow batches, and the matrices of all tasks are added up place by place. Two
passes, no pair of channels written out, and no cancellation of large levels.

Defined results: rows with a null array, another length than ``width``, or a null or non-finite element don't count; a channel that doesn't vary has
null correlations; a group of no whole rows isn't returned; null keys are a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.expr import finite

CHUNK = 16
#: Numbers of a task's matrices before they are sent on.
STATE = 20_000_000


def _on(keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def co_moments(df: DataFrame, keys: Sequence[str], values: str, width: int) -> DataFrame:
    """(keys, n, i, __first, __c as an array of CHUNK): sums of products of distances of channel i and those from __first on."""
    keys = list(keys)
    whole = df.select(*keys, F.col(values).cast("array<double>").alias("x")).filter((F.size("x") == width) & F.forall("x", lambda v: F.coalesce(finite(v), F.lit(False))))
    means = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(width))).alias("mean"))
    joined = whole.alias("a").join(means.alias("b"), _on(keys)).select(*(f"a.{k}" for k in keys), "a.x", "b.mean", "b.n")
    chunks = -(-width // CHUNK)
    layout = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "n bigint", "i int", "__first int", "__c array<double>"])
    kinds = [f.type for f in df.limit(0).select(*keys).toArrow().schema] if keys else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        place = np.arange(width * chunks)

        def sent() -> Iterator[pa.RecordBatch]:
            for (*group, n), sums in held.items():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, CHUNK, dtype=np.int32)), pa.array(sums.ravel()))
                ends = [pa.array(np.full(len(place), n)), pa.array((place // chunks).astype(np.int32)), pa.array((place % chunks * CHUNK).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(place), t) for v, t in zip(group, kinds, strict=True)), *ends], names=[*keys, "n", "i", "__first", "__c"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            x, mean = (at[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("x", "mean"))
            d = x - mean
            rows: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*(at[c].to_pylist() for c in (*keys, "n")), strict=True)):
                rows.setdefault(g, []).append(i)
            for g, own in rows.items():
                if g not in held:
                    if (len(held) + 1) * width * chunks * CHUNK > STATE:
                        yield from sent()
                    held[g] = np.zeros((width, chunks * CHUNK))
                held[g][:, :width] += d[own].T @ d[own]
        yield from sent()

    parts = joined.mapInArrow(run, layout)
    return parts.groupBy(*keys, "n", "i", "__first").agg(F.array(*(F.sum(F.get("__c", F.lit(j))) for j in range(CHUNK))).alias("__c"))


def correlations(df: DataFrame, keys: Sequence[str], values: str, width: int) -> DataFrame:
    """(keys, n, i, j, correlation) of every two channels i < j."""
    keys = list(keys)
    sums = co_moments(df, keys, values, width)
    long = sums.select(*keys, "n", "i", "__first", F.posexplode("__c").alias("__at", "__v")).withColumn("j", F.col("__first") + F.col("__at")).filter((F.col("j") >= F.col("i")) & (F.col("j") < width))
    spread = long.filter("i = j").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "__v"))).alias("__own"))  # width numbers for each group
    joined = long.filter("i < j").alias("a").join(spread.alias("b"), _on(keys))
    unit = F.sqrt(F.col("b.__own")[F.col("a.i")] * F.col("b.__own")[F.col("a.j")])
    return joined.select(*(f"a.{k}" for k in keys), "a.n", "a.i", "a.j", F.try_divide(F.col("a.__v"), F.nullif(unit, F.lit(0.0))).alias("correlation"))


def smallest_correlation(df: DataFrame, keys: Sequence[str], values: str, width: int) -> DataFrame:
    """(keys, n, min_corr, n_pairs): the smallest correlation of two channels, and of how many pairs."""
    return correlations(df, keys, values, width).groupBy(*keys, "n").agg(F.min("correlation").alias("min_corr"), F.count("correlation").alias("n_pairs"))
