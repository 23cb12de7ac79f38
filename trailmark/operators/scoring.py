"""Route scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an infraction leaves of the score.
PENALTIES = {"collisions_pedestrian": 0.5, "collisions_vehicle": 0.6, "collisions_layout": 0.65, "red_light": 0.7, "stop_infraction": 0.8, "scenario_timeouts": 0.7, "yield_emergency_vehicle_infractions": 0.7}


def penalty(infractions: Column, per_km: Column | None = None, values: dict[str, float] = PENALTIES) -> Column:
    """Product of each infraction's factor, to the power of its count (per km where the
    driven distance is given)."""
    out = F.lit(1.0)
    for name, factor in values.items():
        n = F.coalesce(F.size(infractions[name]), F.lit(0))
        n = F.greatest(n, F.lit(0))
        out = out * F.pow(F.lit(factor), n / per_km if per_km is not None else n)
    return out


def lane_penalty(percent: Column) -> Column:
    return 1 - percent / 100


def slow_penalty(percent: Column) -> Column:
    return 1 - (1 - 0.7) * (1 - percent / 100)


def succeeded(status: Column, infractions: Column, ignored: str = "min_speed_infractions") -> Column:
    """Perfect or completed, with no infraction but ignored ones."""
    clean = F.forall(F.map_keys(infractions), lambda k: (k == ignored) | (F.size(infractions[k]) == 0))
    return (status == "Perfect") | ((status == "Completed") & clean)


def merged(routes: DataFrame, status: str = "status", score: str = "score_composed", infractions: str = "infractions", expected: int | None = None) -> DataFrame:
    """One row: routes counted, mean score, success rate; crashed agents are left out."""
    valid = routes.where(~F.col(status).contains("Agent crashed"))
    out = valid.agg(F.count(F.lit(1)).alias("routes"), F.avg(score).alias("driving_score"), F.avg(succeeded(F.col(status), F.col(infractions)).cast("double")).alias("success_rate"))
    return out.withColumn("complete", F.col("routes") == expected) if expected else out


def ability_rates(results: DataFrame, scenario: str, success: str, abilities: DataFrame) -> DataFrame:
    """Success rate of each ability. abilities (scenario, ability) may name a pair twice:
    it then counts twice."""
    return results.join(F.broadcast(abilities), scenario).groupBy("ability").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(success).cast("double")).alias("rate"))
