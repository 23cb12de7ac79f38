"""Which recorded things and routes count for labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least points on a vehicle, by kind, and how far behind is still beside.
POINTS, SCENARIO_POINTS, BEHIND = 15, 10, -1.5


def visible(points: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether one of the projected points lies strictly inside the image; null has none."""
    return F.coalesce(F.exists(points, lambda p: (p[0] > low[0]) & (p[0] < high[0]) & (p[1] > low[1]) & (p[1] < high[1])), F.lit(False))


def counts(v: dict[str, Column]) -> Column:
    """Whether a vehicle (lane_type, cuts_in, ahead, base_type, points, role) is one to speak
    of: not parked, unless it cuts in, not behind, and with enough points on it."""
    scenario = v["role"].contains("scenario")
    parked = (v["lane_type"] == "Parking") & ~v["cuts_in"]
    few = (~scenario & (v["base_type"] != "bicycle") & (v["points"] < POINTS)) | (scenario & (v["points"] < SCENARIO_POINTS))
    return ~parked & (v["ahead"] >= BEHIND) & ~few


def complete(progress: Column, statuses: Column, failed: tuple[str, ...]) -> Column:
    """Whether a route's result is whole: all of it driven, and no record failed."""
    driven = (F.size(progress) >= 2) & (F.get(progress, F.lit(0)) >= F.get(progress, F.lit(1)))
    return F.coalesce(driven & ~F.exists(statuses, lambda s: s.isin(*failed)), F.lit(False))
