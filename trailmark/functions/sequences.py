"""Kernels over ``array<double>`` columns, as higher-order functions.

A null array gives null; arrays are taken to hold no nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def at(x: Column, i) -> Column:
    """Element i from 0."""
    return F.get(x, i if isinstance(i, Column) else F.lit(i))


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is worked out once however often body names it; inside a lambda an
    expression is else worked out again for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def indexes(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))


def gradient(x: Column, step: float = 1.0) -> Column:
    """Central differences inside, one-sided at both ends; zero for a single element."""
    last = F.size(x) - 1

    def slope(i: Column) -> Column:
        lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i + 1, last)
        return F.when(hi > lo, (at(x, hi) - at(x, lo)) / ((hi - lo) * F.lit(step))).otherwise(F.lit(0.0))

    return F.transform(indexes(x), slope)


def differences(x: Column) -> Column:
    """x[i+1] - x[i]."""
    return bound(x, lambda x: F.transform(F.filter(indexes(x), lambda i: i > 0), lambda i: at(x, i) - at(x, i - 1)))


def moving_average(x: Column, window: int) -> Column:
    """Centred mean over window elements, edges repeated."""
    half, last = window // 2, F.size(x) - 1
    if window <= 1:
        return x
    steps = [F.lit(k - half) for k in range(window)]
    return F.transform(indexes(x), lambda i: sum((at(x, F.greatest(F.lit(0), F.least(last, i + k))) for k in steps), F.lit(0.0)) / window)


def running_sum(x: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(x, start, lambda a, v: F.struct((a["t"] + v).alias("t"), F.concat(a["out"], F.array(a["t"] + v)).alias("out")), lambda a: a["out"])


def half_turn_unwrap(x: Column) -> Column:
    """Angles less a whole turn for each jump of more than half of one, halves to even."""
    turns = running_sum(F.transform(differences(x), lambda d: F.bround(d / (2 * math.pi)).cast("double")))
    return bound(turns, lambda turns: F.transform(indexes(x), lambda i: at(x, i) - F.when(i > 0, at(turns, i - 1)).otherwise(F.lit(0.0)) * (2 * math.pi)))


def time_slice(x: Column, first: float, last: float, step: float) -> Column:
    """Samples from int(first / step) to the one at or after last."""
    start = int(first / step)
    return F.slice(x, start + 1, max(0, math.ceil(last / step) + 1 - start))


def assembled(start: int, said: Column, middle: list[int], moves: Column, end: int, offset: int) -> Column:
    """A completion's token ids: start, what was said, middle, moves shifted by offset, end."""
    fixed = lambda ids: F.array(*[F.lit(i).cast("long") for i in ids])
    return F.concat(fixed([start]), said.cast("array<long>"), fixed(middle), F.transform(moves, lambda t: t.cast("long") + offset), fixed([end]))


def tokens_before(ids: Column, end: int, offset: int, size: int) -> tuple[Column, Column]:
    """How many ids of [offset, offset + size) come before the first end, and whether there
    is one."""
    at_end = F.array_position(ids, F.lit(end).cast("long"))
    head = F.when(at_end > 0, F.slice(ids, 1, F.greatest(at_end - 1, F.lit(0)).cast("int"))).otherwise(ids)
    return F.size(F.filter(head, lambda t: (t >= offset) & (t < offset + size))), at_end > 0


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def angles(y: pa.Array, x: pa.Array) -> pa.Array:
    """atan2 of the elements of two arrays of one size, by the C library as in SQL engines. Java's
    differs in the last place for one angle in eight, which tells where a threshold is just met."""
    pairs = zip(y.flatten().to_pylist(), x.flatten().to_pylist())
    found = [None if a is None or b is None else math.atan2(a, b) for a, b in pairs]
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(y), 0))
    starts = pa.concat_arrays([pa.array([0], ends.type), ends])
    return pa.ListArray.from_arrays(starts, pa.array(found, pa.float64()), mask=y.is_null())


def turn_step(d: Column) -> Column:
    """A difference of angles brought into [-pi, pi), half-turns keep sign."""
    turn = 2 * math.pi
    m = F.pmod(d + F.lit(math.pi), F.lit(turn)) - F.lit(math.pi)
    m = F.when((m == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(m)
    return F.when(F.abs(d) < math.pi, d).otherwise(m)


def unwrap(x: Column) -> Column:
    """Angles without jumps: each step is brought into [-pi, pi), half-turns keep sign. The
    steps are summed up first and then added to the first angle."""
    steps = running_sum(F.transform(differences(x), turn_step))
    return bound(steps, lambda steps: F.transform(indexes(x), lambda i: at(x, 0) + F.when(i > 0, at(steps, i - 1)).otherwise(F.lit(0.0))))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, f: Column) -> Column:
        run = F.when(f, a["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(flags, zero, step, lambda a: a["best"])


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))


def first_position(x: Column, value: Column) -> Column:
    """Index from 0 of the first element equal to value."""
    return (F.array_position(x, value) - 1).cast("int")


def stop_event(speed: Column, dt: float, below: float = 0.5, seconds: float = 1.0, recovery: float = 2.0) -> Column:
    """Below a speed for long enough, and not above the recovery speed at the end."""
    need = max(1, math.ceil(seconds / dt))
    return (longest_run(F.transform(speed, lambda v: v < below)) >= need) & ~(at(speed, F.size(speed) - 1) > recovery)


def yield_event(speed: Column, drop: float = 0.3, low: float = 2.0, recovered: float = 0.5) -> Column:
    """A dip before the last sample that is made good by at least ``recovered`` of it."""
    dip = F.array_min(speed)
    return dipped(at(speed, 0), at(speed, F.size(speed) - 1), dip, first_position(speed, dip) < F.size(speed) - 1, drop, low, recovered)


def dipped(first: Column, last: Column, dip: Column, inside: Column, drop: float = 0.3, low: float = 2.0, recovered: float = 0.5) -> Column:
    """The same of the ends, the least and whether it is before the last sample."""
    amount = first - dip
    share = F.when(first > 1e-6, amount / first).otherwise(F.lit(0.0))
    return ((share > drop) | (dip < low)) & inside & (amount > 1e-6) & (F.try_divide(last - dip, amount) >= recovered)


def savgol_weights(window: int, order: int, deriv: int = 0, step: float = 1.0) -> list[list[float]]:
    """Weights of a local polynomial fit at each position of a window: the middle row for
    the inside, the others for the edges."""
    import numpy as np

    half = window // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    rows = []
    for p in t:
        powers = [math.prod(range(k - deriv + 1, k + 1)) * float(p) ** (k - deriv) if k >= deriv else 0.0 for k in range(order + 1)]
        rows.append((np.array(powers) @ fit / step**deriv).tolist())
    return rows


def savgol(x: Column, window: int = 7, order: int = 2, deriv: int = 0, step: float = 1.0) -> Column:
    """Savitzky-Golay smoothing or derivative; edges from the fit of the outermost window.
    Arrays shorter than the window give null."""
    half = window // 2
    weights = F.array(*[F.array(*[F.lit(w) for w in row]) for row in savgol_weights(window, order, deriv, step)])
    n = F.size(x)

    def value(i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - half, n - window))
        row = F.get(weights, (i - start).cast("int"))
        return F.aggregate(F.zip_with(F.slice(x, start + 1, window), row, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)

    return F.when(n >= window, F.transform(indexes(x), value))


def interpolate(xs: Column, ys: Column, grid: Column) -> Column:
    """Linear interpolation of (xs ascending, ys) at grid; clamped at both ends."""
    last = F.size(xs) - 1

    def value(q: Column) -> Column:
        before = F.greatest(F.size(F.filter(xs, lambda v: v <= q)) - 1, F.lit(0))
        lo = F.least(before, F.greatest(last - 1, F.lit(0)))
        hi = F.least(lo + 1, last)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(q - at(xs, lo), at(xs, hi) - at(xs, lo)), F.lit(0.0))))
        return at(ys, lo) + share * (at(ys, hi) - at(ys, lo))

    return F.transform(grid, value)
