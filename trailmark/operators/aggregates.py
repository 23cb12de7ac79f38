"""Grouped statistics and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import sequences as S
from trailmark.operators import scans


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n and its fraction of the group."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def spread(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation and range of each column."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("range", lambda c: F.max(c) - F.min(c)))])


def elementwise(df: DataFrame, group: list[str], values: str) -> DataFrame:
    """Mean, deviation, least and most of arrays position by position, over the group's
    arrays of its commonest length (of equally common ones the longest)."""
    sized = df.select(*group, F.size(values).alias("_length"), F.col(values).alias("_values"))
    lengths = sized.groupBy(*group, "_length").agg(F.count(F.lit(1)).alias("_n")).groupBy(*group).agg(F.max(F.struct("_n", "_length"))["_length"].alias("_length"))
    parts = sized.join(lengths, [*group, "_length"]).select(*group, F.posexplode("_values").alias("position", "_v"))
    return parts.groupBy(*group, "position").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def majority(df: DataFrame, group: list[str], value: str, order: list[Column]) -> DataFrame:
    """Each group's commonest value, of equally common ones the first seen."""
    w = Window.partitionBy(*group).orderBy(*order)
    seen = df.withColumn("_row", F.row_number().over(w))
    counts = seen.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first"))
    return counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "_first"))).where("_rank = 1").drop("_rank", "_first")


def most_common(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k commonest values of each group (ties by value), with n_unique and total."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    out = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), value))).withColumn("n_unique", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("n").over(w))
    return out.where(F.col("rank") <= k)


def leave_one_out(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each row with its distance to the mean of the others; null where it is alone."""
    w = Window.partitionBy(*group)
    n = F.count(value).over(w)
    return df.withColumn("others_mean", F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))).withColumn("deviation", F.abs(F.col(value) - F.col("others_mean")))


def medoid(pairs: DataFrame, group: list[str], a: str, b: str, distance: str) -> DataFrame:
    """The member with the least mean distance to the others (ties: the smallest)."""
    ends = F.explode(F.array(a, b)).alias("member")  # each pair is made once
    both = pairs.select(*group, ends, F.col(distance).alias("_d"))
    means = both.groupBy(*group, "member").agg(F.avg("_d").alias("mean_distance"))
    return means.groupBy(*group).agg(F.min(F.struct("mean_distance", "member")).alias("_m")).select(*group, "_m.member", "_m.mean_distance")


def medoid_within(df: DataFrame, group: list[str], member: str, value: str, distance: Callable[[Column, Column], Column]) -> DataFrame:
    """The same of a group's rows themselves, over all pairs of rows of different members: a
    group is gathered in an array, so that its pairs are never rows. For groups of bounded
    size, as in joins.pairs_within; the work is their square."""
    items = F.collect_list(F.struct(F.col(member).alias("m"), F.col(value).alias("v")))
    known = reduce(and_, [F.col(c).isNotNull() for c in [*group, member]])
    rows = df.where(known).groupBy(*group).agg(items.alias("_s"))

    def mean(m: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("n"))
        add = lambda a, d: F.when(d.isNull(), a).otherwise(F.struct((a["t"] + d).alias("t"), (a["n"] + 1).alias("n")))
        own = F.filter("_s", lambda x: x["m"] == m)
        total = lambda others: F.aggregate(own, start, lambda a, x: F.aggregate(others, a, lambda a, y: add(a, distance(x["v"], y["v"]).cast("double"))), lambda a: F.when(a["n"] > 0, a["t"] / a["n"]))
        return S.bound(F.filter("_s", lambda y: y["m"] != m), total)

    members = F.array_distinct(F.transform("_s", lambda x: x["m"]))
    best = F.array_min(F.transform("_members", lambda m: F.struct(mean(m).alias("mean_distance"), m.alias("member"))))
    rows = rows.withColumn("_members", members).where(F.size("_members") > 1)  # a lone member has no distance
    return rows.select(*group, best.alias("_m")).select(*group, "_m.member", "_m.mean_distance")


def gates(df: DataFrame, group: list[str], gates: dict[str, Column]) -> DataFrame:
    """How many rows qualify, and how many of the others fail each gate (a row may fail
    several)."""
    passes = F.lit(True)
    for g in gates.values():
        passes = passes & g
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(passes).alias("qualified"), *[F.count_if(~g).alias(f"failed_{name}") for name, g in gates.items()])


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """df, once it is known that no key is repeated."""
    bad = repeated_keys(df, key).limit(3).collect()
    if bad:
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in bad]}")
    return df


def inverse_frequency(df: DataFrame, bins: Column, n_bins: int) -> DataFrame:
    """Count and weight total / (n_bins * count) of each bin."""
    counts = df.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("weight", F.col("total") / (n_bins * F.col("n"))).drop("total")


def smoothed(df: DataFrame, group: list[str], order: list[str], value: str, alpha: float, start: float, low: float, high: float, chunk: int = 1000) -> DataFrame:
    """Exponential moving average in order, clamped at each step; one row per group.

    A run of such steps is itself one clamped linear step, so each chunk of a group's rows
    becomes one such step and only these meet.
    """
    rows = df.select(*group, *order, F.col(value).cast("double").alias("_v"))
    rows = scans.running(rows, group, [F.col(c) for c in order], {"_i": scans.place()})
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    step = lambda slope, shift, least, most: F.struct(slope.alias("slope"), shift.alias("shift"), least.alias("least"), most.alias("most"))
    none = step(F.lit(1.0), F.lit(0.0), F.lit(float("-inf")), F.lit(float("inf")))
    move = lambda x, v: x * (1 - alpha) + v * alpha
    grown = lambda s, r: step(s["slope"] * (1 - alpha), move(s["shift"], r["_v"]), clamp(move(s["least"], r["_v"])), clamp(move(s["most"], r["_v"])))
    parts = rows.groupBy(*group, F.floor(F.col("_i") / chunk).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_items"))
    parts = parts.select(*group, F.struct("_c", F.aggregate("_items", none, grown).alias("s")).alias("_part"))
    apply = lambda a, p: F.greatest(p["s"]["least"], F.least(p["s"]["most"], p["s"]["slope"] * a + p["s"]["shift"]))
    return parts.groupBy(*group).agg(F.sort_array(F.collect_list("_part")).alias("_parts")).select(*group, F.aggregate("_parts", F.lit(start), apply).alias("ema"))


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], kind: str = "linear", rows: int = scans.ROWS) -> DataFrame:
    """Each group's exact percentiles by name, nulls left out; null where no value is left.

    Rows are numbered in the order of value, large groups range by range (see scans), and
    the wanted positions picked: no task holds a group. ``kind`` is linear (between the two
    nearest positions), nearest (halves to the even one) or floor.
    """
    at = {name: F.lit(share) * (F.col("_n") - 1) for name, share in shares.items()}
    placed = scans.running(df.select(*group, F.col(value).alias("_v")), group, [F.col("_v").asc_nulls_last()], {"_i": scans.place()}, {"_n": F.count("_v")}, rows)
    pick = lambda position: F.max(F.when((F.col("_i") == position) & (F.col("_i") < F.col("_n")), F.col("_v")))
    if kind != "linear":
        whole = {"nearest": F.bround, "floor": F.floor}[kind]
        return placed.groupBy(*group).agg(*[pick(whole(a)).alias(name) for name, a in at.items()])
    ends = placed.groupBy(*group).agg(F.max("_n").alias("_n"), *[pick(f(a)).alias(f"_{side}_{name}") for name, a in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda name: F.col(f"_lo_{name}") + (at[name] - F.floor(at[name])) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return ends.select(*group, *[between(name).alias(name) for name in shares])
