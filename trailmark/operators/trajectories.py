"""Trajectory features and manoeuvre labels, all as column expressions.

Tracks are ``array<array<double>>`` (x ahead, y left) in the frame of their first
sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import sequences as S
from trailmark.operators import scans


@dataclass(frozen=True)
class Thresholds:
    # Fixed values.
    window: int = 3
    stop_speed: float = 0.5
    stop_seconds: float = 1.0
    stop_recovery: float = 2.0
    yield_drop: float = 0.30
    yield_speed: float = 2.0
    yield_recovery: float = 0.50
    turn_deg: float = 45.0
    lane_offset: float = 2.5
    lane_deg: float = 45.0
    accelerate: float = 0.5
    ambiguous: float = 0.10


def features(df: DataFrame, track: str, hz: float, native_accel: str | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """df with a struct ``features``. A native acceleration, where present, replaces the
    one derived from smoothed speed."""
    dt = 1.0 / hz
    xs, ys = F.transform(track, lambda p: p[0]), F.transform(track, lambda p: p[1])
    step1 = df.withColumn("_vx", S.gradient(xs, dt)).withColumn("_vy", S.gradient(ys, dt)).withColumn("_y", ys)
    step2 = step1.withColumn("_raw", F.zip_with("_vx", "_vy", lambda a, b: F.sqrt(a * a + b * b))).withColumn("_angle", S.angles("_vy", "_vx")).withColumn("_turn", S.unwrap(F.col("_angle")))
    step3 = step2.withColumn("_speed", S.moving_average(F.col("_raw"), t.window)).withColumn("_heading", S.moving_average(F.col("_turn"), t.window))
    derived = S.gradient(F.col("_speed"), dt)
    accel = F.coalesce(F.col(native_accel), derived) if native_accel else derived
    step4 = step3.withColumn("_accel", accel).withColumn("_slowing", F.transform(F.filter("_accel", lambda a: a < 0), lambda a: -a))
    speed, last = F.col("_speed"), F.size("_speed") - 1
    heading = F.degrees(S.at(F.col("_heading"), last) - S.at(F.col("_heading"), 0))
    out = F.struct(
        F.size(track).alias("n"),
        S.at(speed, 0).alias("initial_speed"),
        S.at(speed, last).alias("final_speed"),
        F.array_min(speed).alias("min_speed"),
        S.at(F.col("_y"), last).alias("lateral_offset"),
        heading.alias("heading_change"),
        S.mean(F.col("_accel")).alias("mean_acceleration"),
        F.coalesce(S.mean(F.col("_slowing")), F.lit(0.0)).alias("mean_deceleration"),
        F.coalesce(F.array_max("_slowing"), F.lit(0.0)).alias("max_deceleration"),
        S.stop_event(speed, dt, t.stop_speed, t.stop_seconds, t.stop_recovery).alias("stop_event"),
        S.yield_event(speed, t.yield_drop, t.yield_speed, t.yield_recovery).alias("yield_event"),
        F.lit("finite_difference").alias("accel_source") if not native_accel else F.when(F.col(native_accel).isNull(), "finite_difference").otherwise("native").alias("accel_source"),
    )
    return step4.withColumn("features", out).select(*df.columns, "features")


def label(f: Column, t: Thresholds = Thresholds()) -> Column:
    """The first rule that fits; lane_keep where none does."""
    heading, lateral = f["heading_change"], f["lateral_offset"]
    return (
        F.when(f["stop_event"], "stop")
        .when(F.abs(heading) > t.turn_deg, F.when(heading > 0, "turn_left").otherwise("turn_right"))
        .when((F.abs(lateral) > t.lane_offset) & (F.abs(heading) < t.lane_deg), F.when(lateral > 0, "lane_change_left").otherwise("lane_change_right"))
        .when(f["yield_event"], "yield")
        .when(f["mean_acceleration"] > t.accelerate, "proceed/accelerate")
        .otherwise("lane_keep")
    )


def margins(f: Column, t: Thresholds = Thresholds()) -> Column:
    """Signed relative distance to each rule's threshold."""
    tiny = F.lit(1e-6)
    relative = lambda value, threshold: (value - threshold) / threshold
    slow, turn = F.greatest(f["min_speed"], tiny), F.abs(f["heading_change"])
    return F.create_map(
        F.lit("stop_min_speed"), relative(F.lit(t.stop_speed), slow),
        F.lit("turn_heading"), relative(turn, F.lit(t.turn_deg)),
        F.lit("lane_change_lateral"), relative(F.abs(f["lateral_offset"]), F.lit(t.lane_offset)),
        F.lit("lane_change_heading"), relative(F.lit(t.lane_deg), F.greatest(turn, tiny)),
        F.lit("proceed_accel"), relative(f["mean_acceleration"], F.lit(t.accelerate)),
    )


def ambiguous(margins_: Column, t: Thresholds = Thresholds()) -> Column:
    return F.array_min(F.transform(F.map_values(margins_), F.abs)) <= t.ambiguous


def well_driven(track: Column, hz: float, most_speed: float = 45.0, most_change: float = 12.0) -> Column:
    """Speed and its change stay within physical bounds; three samples at least. One pass
    over the samples, with the largest of both so far."""
    fields = ("x", "y", "speed", "top", "change")
    start = F.struct(*[F.lit(None).cast("double").alias(n) for n in fields])

    def step(a: Column, p: Column) -> Column:
        dx, dy = p[0] - a["x"], p[1] - a["y"]
        speed = F.sqrt(dx * dx + dy * dy) * hz
        values = (p[0].cast("double"), p[1].cast("double"), speed, F.greatest(a["top"], speed), F.greatest(a["change"], F.abs(speed - a["speed"]) * hz))
        return F.struct(*[v.alias(n) for n, v in zip(fields, values)])

    fits = lambda a: (a["top"] <= most_speed) & (F.coalesce(a["change"], F.lit(0.0)) <= most_change)
    return (F.size(track) >= 3) & F.aggregate(track, start, step, fits)


def chunks(df: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Rows numbered by whole chunks of size in order; a short tail is dropped."""
    placed = scans.running(df, group, [F.col(order).asc()], {"_i": scans.place()}, {"_n": F.count(F.lit(1))})
    return placed.withColumn("chunk", F.floor(F.col("_i") / size)).where(F.col("chunk") < F.floor(F.col("_n") / size)).drop("_i", "_n")


def clamp_time(t0: Column, first: Column, last: Column, history: float, future: float) -> Column:
    """t0 brought to where history and future fit; null where the recording is too short."""
    low, high = first + history, last - future
    return F.when(low <= high, F.greatest(low, F.least(high, t0)))


def degrees_between(a: Column, b: Column) -> Column:
    d = F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi
    return F.degrees(d)
