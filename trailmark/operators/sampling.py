"""Sampling, ranking and de-duplication in orders that reruns repeat."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.hashing import sample_order
from trailmark.operators import scans
from trailmark.session import kept as _kept


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def quota(df: DataFrame, stratum: str, key: str, n: int, seed: str = "quota") -> DataFrame:
    """n rows of each stratum in a seeded order (all of a smaller one)."""
    return top_per_group(df.withColumn("_order", sample_order(F.col(key), seed)), [stratum], [F.col("_order"), F.col(key)], n).drop("_order")


def shortfalls(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Strata with fewer than n rows, and how many they lack."""
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("available")).where(F.col("available") < n).withColumn("short", n - F.col("available"))


def redrawn(df: DataFrame, stratum: list[str], key: str, n: int, accept: Callable[[DataFrame], DataFrame], seed: str = "redraw") -> DataFrame:
    """df's first n accepted rows of each stratum in a seeded order, with their rank.

    ``accept`` (which may be costly) gets candidates with all columns and returns those that
    stand, judging each by itself. Where some fall, the stratum's next candidates are tried, twice as many
    each round, until it has n or its pool is spent; full strata try no more. Keys tell rows
    apart; null strata are one.
    """
    ordered = df.withColumn("_order", sample_order(F.col(key), seed))
    pool = _kept(scans.running(ordered, stratum, [F.col("_order").asc(), F.col(key).asc()], {"_i": scans.place()}), "pool")
    low, high, rest, taken = 0, n, pool, None
    while not rest.isEmpty():
        got = _kept(accept(rest.where(F.col("_i") < high)), "redraw")
        taken = got if taken is None else taken.unionByName(got)
        full = taken.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*stratum)
        low, high = high, 3 * high
        rest = scans.by_keys(pool.where(F.col("_i") >= low), full, stratum, "left_anti")
    if taken is None:
        return df.limit(0).withColumn("rank", F.lit(1))
    return top_per_group(taken, stratum, [F.col("_i").asc()], n).select(*df.columns, "rank")


def unmet(df: DataFrame, drawn: DataFrame, stratum: list[str], n: int) -> DataFrame:
    """Strata of df of which fewer than n rows were drawn, none included: drawn and short."""
    marks = df.select(*stratum, F.lit(0).alias("_n")).unionByName(drawn.select(*stratum, F.lit(1).alias("_n")))
    return marks.groupBy(*stratum).agg(F.sum("_n").alias("drawn")).where(F.col("drawn") < n).withColumn("short", n - F.col("drawn"))


def uniform(df: DataFrame, key: str, n: int, seed: str = "uniform") -> DataFrame:
    """n rows without replacement, the same ones on any cluster."""
    return df.orderBy(sample_order(F.col(key), seed), key).limit(n)


def unit(key: Column, seed: str) -> Column:
    """A number in (0, 1) from a key."""
    bits = F.conv(F.substring(sample_order(key, seed), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def weighted(df: DataFrame, key: str, weight: Column, n: int, seed: str = "weighted") -> DataFrame:
    """n rows without replacement, chances by weight: the least of exponential races."""
    race = -F.log(unit(F.col(key), seed)) / weight
    return df.where(weight > 0).withColumn("race", race).orderBy("race", key).limit(n)


def with_replacement(df: DataFrame, key: str, weight: str, draws: int, seed: str = "draws") -> DataFrame:
    """df's keys with times, about draws in all: each row is taken floor(expected) times,
    and once more with the chance of the rest. Only the weights' sum is shared."""
    total = df.agg(F.sum(weight).alias("_total"))
    expected = F.lit(float(draws)) * F.col(weight) / F.col("_total")
    out = df.crossJoin(F.broadcast(total)).withColumn("times", (F.floor(expected) + (unit(F.col(key), seed) < expected - F.floor(expected)).cast("long")).cast("long"))
    return out.where("times > 0").select(key, "times")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per_group(df, key, order, 1).drop("rank")


def ends(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The k first and the k last rows, by tagged top-k on each side (a row may be both)."""
    low = df.orderBy(*order).limit(k).withColumn("end", F.lit("low"))
    return low.unionByName(df.orderBy(*[F.desc(c) for c in order]).limit(k).withColumn("end", F.lit("high")))


#: Rows that a task of global_rank numbers.
ROWS_PER_TASK = 1_000_000


def global_rank(df: DataFrame, order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df with n, its position from 0 by a column without repeats.

    Rows are dealt by ranges into as many tasks as they need, numbered inside each by their
    place in it, and each range starts after those before it. The dealt rows are written to
    the shared folder, so that both passes see the same ranges.
    """
    tasks = max(1, -(-df.count() // rows_per_task))
    dealt = df.repartitionByRange(tasks, order).sortWithinPartitions(order)
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits of place
    dealt = _kept(dealt.withColumn("_cell", F.shiftright(place, 33)).withColumn("n", place.bitwiseAND(F.lit((1 << 33) - 1))), "rank")
    counts = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = counts.select("_cell", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_cell").withColumn("n", F.col("n") + F.col("_start")).drop("_cell", "_start")


def stride(df: DataFrame, order: str, rank: int, world: int) -> DataFrame:
    """Every world-th row of the order, from rank on."""
    return global_rank(df, order).where(F.col("n") % world == rank).drop("n")


#: As many undecided rows as keep_apart leaves to one task per group.
FEW = 100_000


def keep_apart(df: DataFrame, group: list[str], order: list[str], x: list[str], distance: float, few: int = FEW) -> DataFrame:
    """Rows in order, less those within distance of an earlier kept row in every listed
    coordinate pair; order columns tell a group's rows apart.

    While more than ``few`` rows are undecided, rounds over grid cells decide them: the
    earliest row of its own and the neighbouring cells stays, and what lies within distance
    of a new stayer goes. No cell sends more than its earliest row to its neighbours. What
    is left is settled in order, each group's rest by one task.
    """
    cell = F.array(*[F.floor(F.col(c) / distance) for c in x])
    rest = df.select(*df.columns, cell.alias("_cell"), F.struct(*order).alias("_at"))
    kept = None
    while True:
        rest = _kept(rest, "apart")
        if rest.count() <= few:
            break
        least = rest.groupBy(*group, "_cell").agg(F.min("_at").alias("_at"))
        near = _neighbours(least, len(x)).groupBy(*group, "_near").agg(F.min("_at").alias("_first"))
        best = least.join(near.withColumnRenamed("_near", "_cell"), [*group, "_cell"]).where("_at = _first").select(*group, "_cell", "_at")
        stay = _kept(rest.join(best, [*group, "_cell", "_at"], "left_semi"), "apart")
        kept = stay if kept is None else kept.unionByName(stay)
        mark = _neighbours(stay.select(*group, "_cell", "_at", *[F.col(c).alias(f"_{c}") for c in x]), len(x)).drop("_cell").withColumnRenamed("_at", "_by").withColumnRenamed("_near", "_cell")
        close = [F.sqrt((F.col(a) - F.col(f"_{a}")) ** 2 + (F.col(b) - F.col(f"_{b}")) ** 2) <= distance for a, b in zip(x[::2], x[1::2])]
        gone = rest.join(mark, [*group, "_cell"]).where(reduce(and_, close)).select(*group, "_at").distinct()
        rest = rest.join(gone, [*group, "_at"], "left_anti").select(*df.columns, "_cell", "_at")
    done = _in_order(rest.select(*df.columns), group, order, x, distance)
    return done if kept is None else done.unionByName(kept.select(*df.columns))


def _neighbours(cells: DataFrame, dimensions: int) -> DataFrame:
    """cells with _near: each cell itself and those around it."""
    shifts = F.array(*[F.array(*[F.lit(d).cast("long") for d in s]) for s in itertools.product((-1, 0, 1), repeat=dimensions)])
    return cells.withColumn("_near", F.explode(F.transform(shifts, lambda s: F.zip_with(F.col("_cell"), s, lambda a, b: a + b))))


def _in_order(df: DataFrame, group: list[str], order: list[str], x: list[str], distance: float) -> DataFrame:
    import numpy as np
    import pandas as pd

    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        points = pdf[x].to_numpy(float).reshape(len(pdf), -1, 2)
        cells: dict[tuple[int, int], list[int]] = {}
        kept = []
        for i, p in enumerate(points):
            cx, cy = (int(v) for v in np.floor(p[0] / distance))
            near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ())]
            if not near or not (np.hypot(*(points[near] - p).transpose(2, 0, 1)) <= distance).all(1).any():
                kept.append(i)
                cells.setdefault((cx, cy), []).append(i)
        return pdf.iloc[kept]

    return df.groupBy(*group).applyInPandas(run, schema)


def rebalanced(df: DataFrame, key: str, label: str, draws: int, most: int, thinned: dict[str, float] | None = None, seed: str = "balance") -> DataFrame:
    """df's keys and labels with times: about draws rows of each label by repeating its rows
    evenly, none more than most times; of the labels in thinned only that share is there
    to be drawn from. Only one count per label is shared."""
    thinned = thinned or {}
    share = F.lit(1.0)
    for name, part in thinned.items():
        share = F.when(F.col(label) == name, part).otherwise(share)
    pool = df.select(key, label).where(unit(F.col(key), f"{seed}-thin") < share)
    sizes = pool.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    expected = F.lit(float(draws)) / F.col("_n")
    times = F.floor(expected) + (unit(F.col(key), seed) < expected - F.floor(expected)).cast("long")
    return pool.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, label).select(key, label, F.least(F.lit(most), times).cast("long").alias("times")).where("times > 0")


def spread(df: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """The n - 2 rows of the largest values, the middle row and the last one, with their
    rank; just the n first for n of at most 2. Of equal values the least order comes first;
    of a key's rows the first one stays."""
    ranked = global_rank(df.withColumn("_by", F.struct((-F.col(value)).alias("v"), F.col(order).alias("o"))), "_by").drop("_by").withColumnRenamed("n", "rank")
    total = df.count()
    picks = range(n) if n <= 2 else [*range(n - 2), total // 2, total - 1]
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    return ranked.where(F.col("rank").isin(*picks)).withColumn("_k", place).where("_k = 1").drop("_k")
