"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidegrid.config import JS_FLOOR, TINY


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def number(x: Column) -> Column:
    """The value as a double; null for what is no finite number."""
    value = x.try_cast("double")
    return F.when(finite(value), value)


def normalised(p: Column) -> Column:
    """Clipped below and scaled to sum 1."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(JS_FLOOR)))
    return F.transform(clipped, lambda x: x / total(clipped))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence to base 2 of two arrays of equal length."""
    sides = F.zip_with(normalised(p), normalised(q), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def step(sum_: Column, x: Column) -> Column:
        middle = (x["a"] + x["b"]) / 2
        return sum_ + x["a"] * F.log2(x["a"] / middle) / 2 + x["b"] * F.log2(x["b"] / middle) / 2

    return F.aggregate(sides, F.lit(0.0), step)


def log2_ratio(a: Column, b: Column) -> Column:
    return F.log2((a + TINY) / (b + TINY))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def average_rank(value: Column | str, by: Iterable[str] = ()) -> Column:
    """Rank within the partition, ties given their mean rank."""
    keys = [F.col(k) for k in by]
    value = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def joined_reasons(pairs: Iterable[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold, in order, joined by '; '."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs))), "; ")


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by a Chebyshev-fitted rational form (relative error below 1.2e-7)."""
    # Coefficients of the fit in t = 1 / (1 + x / 2), highest power first.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    poly = F.lit(0.0)
    for c in fit:
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def normal_two_sided(z: Column) -> Column:
    return F.when(z.isNotNull(), F.least(erfc(F.abs(z) / (2**0.5)), F.lit(1.0)))
