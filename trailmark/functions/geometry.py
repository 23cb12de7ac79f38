"""Planar and rigid-body geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def mean_displacement(a: Column, b: Column) -> Column:
    """Mean planar distance of two ``array<array<double>>`` tracks over their common steps."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.slice(F.zip_with(a, b, lambda p, q: norm2(p[0] - q[0], p[1] - q[1])), 1, n), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(pairs) > 0, total / n)


def final_displacement(a: Column, b: Column) -> Column:
    p, q = F.try_element_at(a, F.lit(-1)), F.try_element_at(b, F.lit(-1))
    return norm2(p[0] - q[0], p[1] - q[1])


def bearing_sector(x: Column, y: Column) -> Column:
    """Where a point lies from the origin, x ahead and y to the left, in 45 degree sectors."""
    names = ["ahead", "ahead_left", "left", "behind_left", "behind", "behind_right", "right", "ahead_right"]
    sector = F.pmod(F.floor((F.degrees(F.atan2(y, x)) + 22.5) / 45), F.lit(8)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), sector + 1)


def quaternion_rotate(q: tuple[Column, ...], v: tuple[Column, ...], inverse: bool = False) -> tuple[Column, ...]:
    """v turned by the unit quaternion q = (x, y, z, w)."""
    x, y, z, w = q
    if inverse:
        x, y, z = -x, -y, -z
    a, b, c = v
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return a + w * tx + (y * tz - z * ty), b + w * ty + (z * tx - x * tz), c + w * tz + (x * ty - y * tx)


def slerp(a: tuple[Column, ...], b: tuple[Column, ...], share: Column) -> list[Column]:
    """Rotation between two unit quaternions, the shorter way; share is clamped to [0, 1]."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    dot = sum((p * q for p, q in zip(a, b)), F.lit(0.0))
    sign, angle = F.when(dot < 0, -1.0).otherwise(1.0), F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = F.sin(angle) < 1e-9
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return [wa * p + wb * q for p, q in zip(a, b)]


def lane_distance(px: Column, py: Column, cx: Column, cy: Column, fx: Column, fy: Column) -> Column:
    """Signed distance of a point from a lane centre with unit heading (fx, fy), left positive."""
    return fx * (py - cy) - fy * (px - cx)


def bicycle_step(x: Column, y: Column, yaw: Column, speed: Column, steer: Column, accel: Column, dt: float, front: float, rear: float) -> tuple[Column, ...]:
    """One step of the kinematic bicycle model: x, y, yaw, speed."""
    slip = F.atan(F.lit(rear / (front + rear)) * F.tan(steer))
    return x + speed * F.cos(yaw + slip) * dt, y + speed * F.sin(yaw + slip) * dt, yaw + speed / rear * F.sin(slip) * dt, F.greatest(F.lit(0.0), speed + accel * dt)


def box_axes(yaw, by=F) -> dict:
    """The directions that boxes_touch needs of a box, worked out once a box; by is np for arrays."""
    return {f"{n}{i}": getattr(by, n)(yaw + turn) for i, turn in enumerate((0.0, math.pi / 2)) for n in ("cos", "sin")}


def boxes_touch(a: dict, b: dict, absolute=F.abs):
    """Whether two upright boxes (x, y, length, width, yaw or its box_axes, and z, height)
    intersect: no axis of either parts them. Fields are columns, or with box_axes and np.abs
    arrays."""
    a, b = (box if "cos0" in box else box | box_axes(box["yaw"]) for box in (a, b))
    parted = absolute(a["z"] - b["z"]) > (a["height"] + b["height"]) / 2
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    for axes, i in ((a, 0), (a, 1), (b, 0), (b, 1)):
        ux, uy = axes[f"cos{i}"], axes[f"sin{i}"]
        reach = 0.0
        for box in (a, b):
            reach = reach + absolute(box["cos0"] * ux + box["sin0"] * uy) * box["length"] / 2 + absolute(-box["sin0"] * ux + box["cos0"] * uy) * box["width"] / 2
        parted = parted | (absolute(dx * ux + dy * uy) > reach)
    return ~parted


def fisheye_pixel(point: tuple[Column, ...], lens: tuple[float, ...], centre: tuple[float, float], size: tuple[int, int]) -> tuple[Column, Column, Column]:
    """(u, v, valid) of a point in the camera's frame: the lens polynomial gives the radius
    for the angle from the axis; valid are points before the camera and on the image."""
    x, y, z = point
    off = norm2(x, y)
    angle = F.atan2(off, z)
    radius = sum((F.lit(c) * F.pow(angle, F.lit(i)) for i, c in enumerate(lens)), F.lit(0.0))
    u, v = (F.lit(c) + p * radius / (off + 1e-8) for c, p in zip(centre, (x, y)))
    inside = lambda w, n: (w >= 0) & (w < n) & ~F.isnan(w)
    return u, v, (z > 0) & inside(u, size[0]) & inside(v, size[1])


def to_camera(point: tuple[Column, ...], rotation: tuple[Column, ...], position: tuple[Column, ...]) -> tuple[Column, ...]:
    """A point in the frame of a camera with this pose (quaternion x, y, z, w of any length)."""
    n = F.sqrt(sum(q * q for q in rotation))
    return quaternion_rotate(tuple(q / n for q in rotation), tuple(p - t for p, t in zip(point, position)), inverse=True)


def unicycle_path(accelerations: Column, curvatures: Column, speed: Column, dt: float) -> Column:
    """Where accelerations and curvatures lead from the origin: (x, y, heading, speed) after
    each step, positions by the trapezoid rule."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"), speed.cast("double").alias("speed"))
    start = F.struct(zero.alias("now"), F.array().cast("array<struct<x:double,y:double,heading:double,speed:double>>").alias("out"))

    def go(s: Column, c: Column) -> Column:
        now, a, k = s["now"], c["a"], c["k"]
        v = now["speed"] + a * dt
        heading = now["heading"] + k * now["speed"] * dt + k * a * (0.5 * dt * dt)
        x = now["x"] + (now["speed"] * F.cos(now["heading"]) + v * F.cos(heading)) * (0.5 * dt)
        y = now["y"] + (now["speed"] * F.sin(now["heading"]) + v * F.sin(heading)) * (0.5 * dt)
        new = F.struct(x.alias("x"), y.alias("y"), heading.alias("heading"), v.alias("speed"))
        return F.struct(new.alias("now"), F.concat(s["out"], F.array(new)).alias("out"))

    steps = F.zip_with(accelerations, curvatures, lambda a, k: F.struct(a.cast("double").alias("a"), k.cast("double").alias("k")))
    return F.aggregate(steps, start, go, lambda s: s["out"])


def local_frame(points: Column, origin: Column, yaw: Column) -> Column:
    """Planar points as seen from origin with this heading: moved, then turned back."""
    def turned(p: Column) -> Column:
        dx, dy = p[0] - origin[0], p[1] - origin[1]
        return F.array(F.cos(yaw) * dx + F.sin(yaw) * dy, F.cos(yaw) * dy - F.sin(yaw) * dx)

    return F.transform(points, turned)
