"""Exact quantiles of groups of any size from counted values.

The table is read once: equal values of a group are counted, in each task first, so that what is shuffled is at most one row for each distinct
value and task. The counted values are dealt by ranges of (keys, value), their running sums give the ranks that each value
holds, and a quantile is the value whose ranks hold the wanted one (``stats.running``). Values are neither sampled nor
gathered; a single group is spread over the tasks like many, and very many equal values are one row. The median distance is selected from
the same counts. One row for each group meets the counted values; it is broadcast only for at most MOST groups.

Defined results: null and NaN values aren't counted; a group without others has null quantiles; infinities are values; -0.0
counts as 0.0. Between two ranks values are interpolated, as ``percentile`` does. Null keys are a group.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.stats import running
from tidegrid.sources.shared import written

#: Groups whose figures are given to every task; those of more groups are joined.
MOST = 20_000
_FRACTION = float(1 << 52)


def order_code(x: Column) -> Column:
    """A long in the order of the doubles (null for null and NaN), from exponent and fraction."""
    a = F.abs(x)
    near = F.floor(F.log2(a))  # may be one off beside a power of two
    power = F.when(F.pow(F.lit(2.0), near) > a, near - 1).when(a / F.pow(F.lit(2.0), near) >= 2, near + 1).otherwise(near)
    normal = ((power + 1023) * (1 << 52)).cast("bigint") + ((a / F.pow(F.lit(2.0), power) - 1) * _FRACTION).cast("bigint")
    tiny = (a * 2.0**537 * 2.0**537).cast("bigint")  # below the normal numbers
    bits = F.when(a == 0, F.lit(0)).when(a < 2.0**-1022, tiny).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -bits - 1).otherwise(bits))


def from_code(code: Column) -> Column:
    """The double of an order code."""
    bits = F.when(code < 0, -code - 1).otherwise(code)
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    size = F.when(exponent == 2047, F.lit(float("inf"))).when(exponent == 0, fraction * 2.0**-537 * 2.0**-537).otherwise((fraction / _FRACTION + 1) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))
    return F.when(code < 0, -size).otherwise(size)


def _same(keys: Sequence[str]) -> Column:
    return functools.reduce(operator.and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.lit(True))


def _beside(points: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points with the columns of ``rows``, written and one for each group, beside their own."""
    side = F.broadcast(rows) if not keys or rows.count() <= MOST else rows
    return points.alias("a").join(side.alias("b"), _same(keys)).select("a.*", *(f"b.{c}" for c in rows.columns if c not in keys))


def _counted(df: DataFrame, keys: Sequence[str], value: Column, times: Column) -> DataFrame:
    """(keys, __v, __c), written: how often each value occurs; one row of a null value for null and NaN."""
    own = df.select(*keys, F.when(~F.isnan(value), value + F.lit(0.0)).alias("__v"), times.alias("__c"))
    return written(own.groupBy(*keys, "__v").agg(F.sum("__c").alias("__c")), "value-counts")


def _selected(points: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of counted values."""
    sizes = written(points.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))), F.lit(0)).alias("n")), "sizes")
    ranked = _beside(running(points.filter("__v is not null"), keys, "__v", ["__c"]), sizes, keys)
    place = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    holds = lambda rank: (F.col("__c_before") <= rank) & (rank < F.col("__c_before") + F.col("__c"))
    ends = [F.max(F.when(holds(side(h)), F.col("__v"))).alias(f"__{end}_{name}") for name, h in place.items() for end, side in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy(*keys).agg(*ends)

    def between(name: str) -> Column:
        low, high, h = F.col(f"__low_{name}"), F.col(f"__high_{name}"), place[name]
        return F.when(low == high, low).otherwise(low + (h - F.floor(h)) * (high - low))

    joined = sizes.alias("a").join(found.alias("b"), _same(keys), "left").select(*(f"a.{k}" for k in keys), "a.n", *(f"b.{c}" for c in found.columns if c not in keys))
    return joined.select(*keys, "n", *(between(name).alias(name) for name in probs))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """(keys, n, one column for each name in ``probs``): exact interpolated quantiles of each group; without keys one row."""
    keys = list(keys)
    return _selected(_counted(df, keys, F.col(value).cast("double"), F.lit(1).cast("bigint")), keys, probs)


def median_deviation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, median, mad): each group's median and the median distance from it. df is read once."""
    keys = list(keys)
    points = _counted(df, keys, F.col(value).cast("double"), F.lit(1).cast("bigint"))
    middle = written(_selected(points, keys, {"median": 0.5}), "medians")
    apart = _counted(_beside(points, middle, keys), keys, F.abs(F.col("__v") - F.col("median")), F.col("__c"))
    spread = _selected(apart, keys, {"mad": 0.5})
    return middle.alias("a").join(spread.alias("b"), _same(keys)).select(*(f"a.{k}" for k in keys), "a.n", "a.median", "b.mad")
