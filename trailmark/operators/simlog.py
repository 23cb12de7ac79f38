"""Queries over a parsed simulator log: actors (id, type_id, role, created, destroyed) and
states (actor, frame, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import glob
from trailmark.operators import scans


def delta_times(frames: DataFrame, group: list[str], order: str, time: str) -> DataFrame:
    """Seconds since the frame before, to six digits; 0 for the first."""
    out = scans.running(frames, group, [F.col(order).asc()], {"_last": scans.previous(F.col(time))})
    return out.withColumn("delta", F.coalesce(F.bround(F.col(time) - F.col("_last")["v"], 6), F.lit(0.0))).drop("_last")


def actors_like(actors: DataFrame, pattern: str | None = None, role: str | None = None) -> DataFrame:
    out = actors if role is None else actors.where(F.col("role") == role)
    return out if pattern is None else out.where(glob(F.col("type_id"), pattern))


def alive(actors: DataFrame, last_frame: int) -> DataFrame:
    """First and last frame of each actor: until before it was destroyed, or the end."""
    return actors.withColumn("first_frame", F.col("created")).withColumn("last_frame", F.coalesce(F.col("destroyed") - 1, F.lit(last_frame)))


def states_between(actors: DataFrame, states: DataFrame, first: int, last: int, columns: list[str]) -> DataFrame:
    """A row for every actor and frame of the range, ends included; null where unknown."""
    dense = actors.select("actor", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("frame"))
    return dense.join(states.select("actor", "frame", *columns), ["actor", "frame"], "left")


def last_known(states: DataFrame, column: str) -> DataFrame:
    """states with the last known value of column at or before each frame."""
    return scans.running(states, ["actor"], [F.col("frame").asc()], {f"last_{column}": scans.last(F.col(column))})


def distances(states: DataFrame, pairs: DataFrame, floor: float = -10.0) -> DataFrame:
    """Distance of each pair (a, b) of actors by frame, where both are known and above the
    floor."""
    known = states.where((F.col("z") >= floor) & F.col("x").isNotNull())
    side = lambda s: known.select(F.col("actor").alias(s), "frame", *[F.col(c).alias(f"{c}_{s}") for c in "xyz"])
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "frame"])
    return both.select("a", "b", "frame", F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz")).alias("distance"))


def collisions(events: DataFrame, actor: int) -> DataFrame:
    """Frame and other actor of an actor's collisions; events: frame, actor, others."""
    return events.where(F.col("actor") == actor).select("frame", F.explode("others").alias("other"))
