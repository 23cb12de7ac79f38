"""Percentile variants, guards and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.sequences import bound


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """Element round(q * (n - 1)), halves to even."""
    return F.get(sorted_values, F.bround(F.lit(q) * (F.size(sorted_values) - 1)).cast("int"))


def floor_rank(sorted_values: Column, q: float) -> Column:
    """Element floor(q * (n - 1))."""
    return F.get(sorted_values, F.floor(F.lit(q) * (F.size(sorted_values) - 1)).cast("int"))


def between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share with the first product and the sum rounded once
    (DuckDB's quantile_cont), so that a value next to a threshold lies on the same side."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low.cast("double"), 1 - share, high * share).cast("double")


def quantile(sorted_values: Column, q: float) -> Column:
    """Interpolated between the elements around q * (n - 1)."""
    place = F.lit(q) * (F.size(sorted_values) - 1)
    low, high = (F.get(sorted_values, c(place).cast("int")) for c in (F.floor, F.ceil))
    return F.when(F.size(sorted_values) > 0, between(low, high, place - F.floor(place)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is zero."""
    return F.try_divide(part, whole)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def quantise(x: Column, low: float, high: float, bins: int) -> Column:
    """Index of the nearest of bins uniform levels, halves to even, clamped."""
    raw = F.bround((x - low) / ((high - low) / (bins - 1)))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw.cast("int")))


def dequantise(index: Column, low: float, high: float, bins: int) -> Column:
    return F.lit(low) + index * F.lit((high - low) / (bins - 1))


def outside_bounds(x: Column, low: float | None, high: float | None) -> Column:
    """Strict bounds; a bound of zero or none is no bound."""
    inside = F.lit(True)
    if low:
        inside = inside & (x > low)
    if high:
        inside = inside & (x < high)
    return ~inside


def close_to(a: Column, b: float, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.lit(relative) * F.greatest(F.abs(a), F.lit(abs(b)))


def softmax(logits: Column) -> Column:
    raised = bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return bound(raised, lambda r: bound(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(r, lambda x: x / total)))


def entropy(shares: Column, least: float = 1e-12) -> Column:
    """In nats; shares below least count as that in the logarithm."""
    return -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log(F.greatest(p, F.lit(least))))


def largest(values: Column, k: int) -> Column:
    """The k largest as structs (value, position from 0), the first of equal ones first."""
    marked = F.transform(values, lambda v, i: F.struct(v.alias("value"), (-i).alias("back")))
    return F.transform(F.slice(F.reverse(F.array_sort(marked)), 1, k), lambda x: F.struct(x["value"].alias("value"), (-x["back"]).alias("position")))


def negative_log_likelihood(logits: Column, target: Column) -> Column:
    """Of the element at target, from 0; null outside the array."""
    total = lambda top: F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return bound(F.array_max(logits), lambda top: F.log(total(top)) + top) - F.get(logits, target).cast("double")
