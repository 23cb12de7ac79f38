"""Running values and frames over ordered groups of any size.

A window is one task per group, however large. Here a group of more than ``rows`` rows is
dealt by ranges of its order into tasks of about that many: each range's window gives its own
part, and what the ranges before (or after) it hold is carried in. Smaller groups keep the
plain window. Rows come out as they went in, with the new columns; null keys are a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailmark.session import kept

#: Rows that one task of a group handles.
ROWS = 1_000_000
#: Rows of a cell of framed().
LENGTH = 100_000


@dataclass(frozen=True)
class Scan:
    """A running value: within a range, a range's state by place, states before it (or, if
    ahead, after it) as one, and both together."""

    here: Callable[[WindowSpec], Column]
    state: Callable[[Column], Column]
    carry: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    ahead: bool = False


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _boxed(x: Column) -> Column:
    return F.struct(x.alias("v"))


def total(x: Column) -> Scan:
    """Sum of the values so far, null while there is none."""
    return Scan(lambda w: F.sum(x).over(_so_far(w)), lambda _: F.sum(x), F.sum, lambda a, b: F.coalesce(a + b, a, b))


def place() -> Scan:
    """Position in the group, from 0."""
    one = F.lit(1)
    return Scan(lambda w: F.count(one).over(_so_far(w)) - 1, lambda _: F.count(one), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def last(x: Column) -> Scan:
    """The last value so far that isn't null."""
    known = lambda at: F.max_by(x, F.when(x.isNotNull(), at))
    return Scan(lambda w: F.last(x, True).over(_so_far(w)), known, lambda s: F.last(s, True), lambda a, b: F.coalesce(a, b))


def first(x: Column) -> Scan:
    """The first value so far that isn't null."""
    known = lambda at: F.min_by(x, F.when(x.isNotNull(), at))
    return Scan(lambda w: F.first(x, True).over(_so_far(w)), known, lambda s: F.first(s, True), lambda a, b: F.coalesce(b, a))


def most(x: Column) -> Scan:
    """The largest value so far."""
    return Scan(lambda w: F.max(x).over(_so_far(w)), lambda _: F.max(x), F.max, lambda a, b: F.greatest(a, b))


def least(x: Column) -> Scan:
    """The smallest value so far."""
    return Scan(lambda w: F.min(x).over(_so_far(w)), lambda _: F.min(x), F.min, lambda a, b: F.least(a, b))


def previous(x: Column) -> Scan:
    """The row before's value in a struct v, null in the group's first row."""
    return Scan(lambda w: F.lag(_boxed(x)).over(w), lambda at: F.max_by(_boxed(x), at), lambda s: F.last(s, True), lambda a, b: F.coalesce(a, b))


def following(x: Column) -> Scan:
    """The next row's value in a struct v, null in the group's last row."""
    return Scan(lambda w: F.lead(_boxed(x)).over(w), lambda at: F.min_by(_boxed(x), at), lambda s: F.first(s, True), lambda a, b: F.coalesce(a, b), ahead=True)


def running(df: DataFrame, keys: list[str], order: list[Column], scans: dict[str, Scan], whole: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """df with a column per scan, and one per aggregate in whole, of its group.

    ``order`` (columns with a direction) should tell a group's rows apart: equal rows come in any order, as in a window,
    and stay in one range. df must give the same rows when read again. The names
    _cell and _place, and those of the scans with an underscore before them, are taken.
    """
    whole = whole or {}
    hot = kept(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows), "hot")
    count = hot.agg(F.sum("_n")).first()[0]
    if count is None:
        return _plain(df, keys, order, scans, whole)
    named = hot.select(*keys)
    out = _plain(by_keys(df, named, keys, "left_anti"), keys, order, scans, whole)
    return out.unionByName(_ranged(by_keys(df, named, keys, "left_semi"), keys, order, scans, whole, -(-count // rows)))


def _plain(df: DataFrame, keys: list[str], order: list[Column], scans: dict[str, Scan], whole: dict[str, Column]) -> DataFrame:
    group = Window.partitionBy(*keys)
    return df.select("*", *[s.here(group.orderBy(*order)).alias(n) for n, s in scans.items()], *[a.over(group).alias(n) for n, a in whole.items()])


def _ranged(df: DataFrame, keys: list[str], order: list[Column], scans: dict[str, Scan], whole: dict[str, Column], tasks: int) -> DataFrame:
    by = [*[F.col(k).asc() for k in keys], *order]
    at = F.monotonically_increasing_id()  # the partition's number, then 33 bits of place
    dealt = df.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select("*", F.shiftright(at, 33).alias("_cell"), at.alias("_place"))
    dealt = kept(dealt, "ranges")  # both passes must see the same ranges
    states = dealt.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_held"), *[s.state(F.col("_place")).alias(f"_{n}") for n, s in scans.items()])
    cells = Window.partitionBy(*keys).orderBy("_cell")  # a row per task
    before, after = cells.rowsBetween(Window.unboundedPreceding, -1), cells.rowsBetween(1, Window.unboundedFollowing)
    carried = states.select(*keys, "_cell", *[s.carry(F.col(f"_{n}")).over(after if s.ahead else before).alias(f"_{n}") for n, s in scans.items()])
    here = Window.partitionBy("_cell", *keys).orderBy("_place")
    out = dealt.select("*", *[s.here(here).alias(n) for n, s in scans.items()])
    out = by_keys(out, carried, [*keys, "_cell"], "inner")
    out = out.withColumns({n: s.both(F.col(n), F.col(f"_{n}")) for n, s in scans.items()})
    if whole:
        out = by_keys(out, dealt.groupBy(*keys).agg(*[a.alias(n) for n, a in whole.items()]), keys, "inner")
    return out.select(*df.columns, *scans, *whole)


def by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null equals null."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def framed(df: DataFrame, keys: list[str], index: str, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], length: int = LENGTH) -> DataFrame:
    """df with columns of windows that look at most before rows back and after rows ahead.

    ``index`` is a row's position in its group (see place). A group falls into cells of length
    rows; rows near an edge are copied into the neighbouring cell, and the copies dropped
    after the windows, so that a group is many tasks and each row is sent once or twice.
    """
    if max(before, after) > length:
        raise ValueError(f"a frame of {before} and {after} rows is longer than a cell of {length}")
    cell = lambda i: F.floor(i / F.lit(length))
    i = F.col(index)
    dealt = df.select("*", F.explode(F.sequence(cell(i - after), cell(i + before))).alias("_cell"))
    w = Window.partitionBy(*keys, "_cell").orderBy(index)
    out = dealt.select("*", *[make(w).alias(n) for n, make in columns.items()])
    return out.where(F.col("_cell") == cell(i)).drop("_cell")
