"""Verdict tallies to rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.statistics import ratio, sigmoid


def precision(passed: Column, failed: Column) -> Column:
    """Share of decided claims that passed; null where none was decided."""
    return ratio(passed, passed + failed)


def trace_reward(atomic: Column, causal: Column, unparsed: Column, atomic_weight: float = 0.7, causal_weight: float = 0.3, penalty: float = 0.1) -> Column:
    """Weighted precision over what was decided, less a penalty for unparsed text, floored
    at 0; null where nothing was decided."""
    weight = F.when(atomic.isNotNull(), atomic_weight).otherwise(0.0) + F.when(causal.isNotNull(), causal_weight).otherwise(0.0)
    total = F.coalesce(atomic * atomic_weight, F.lit(0.0)) + F.coalesce(causal * causal_weight, F.lit(0.0))
    return F.when(weight > 0, F.greatest(F.lit(0.0), total / weight - penalty * unparsed))


def tally(df: DataFrame, group: list[str], kind: str, verdict: str) -> DataFrame:
    """Counts of each verdict, and precision over atomic and over causal claims."""
    count = lambda k, v: F.count_if((F.col(kind) == k) & (F.col(verdict) == v)).alias(f"{k}_{v.lower()}")
    out = df.groupBy(*group).agg(*[count(k, v) for k in ("atomic", "causal") for v in ("PASS", "FAIL", "ABSTAIN")])
    for k in ("atomic", "causal"):
        out = out.withColumn(f"{k}_precision", precision(F.col(f"{k}_pass"), F.col(f"{k}_fail")))
    return out


def blended(reward: Column, prior: Column, coverage: Column) -> Column:
    """The reward as far as it is covered, the prior for the rest."""
    return F.coalesce(reward, prior) * coverage + prior * (1 - coverage)


def soft_gate(x: Column, y: Column, x_mid: float, y_mid: float, slope: float) -> Column:
    """Product of two sigmoids around their midpoints."""
    return sigmoid((x - x_mid) * slope) * sigmoid((y - y_mid) * slope)


def fill_from_group(df: DataFrame, group: list[str], value: str, prior: Column) -> DataFrame:
    """NaN and null replaced by the mean of the group's decided values, or the prior."""
    from pyspark.sql import Window

    known = F.when(~F.isnan(value), F.col(value))
    return df.withColumn(value, F.coalesce(known, F.avg(known).over(Window.partitionBy(*group)), prior))


def judged(preferred: Column, swapped: Column, first_score: Column, second_score: Column) -> dict[str, Column]:
    """Undoes a blind swap: who is preferred, by what margin, and whether that agrees
    with the construction (null on ties)."""
    unswapped = F.when(preferred == "tie", "tie").when(swapped, F.when(preferred == "first", "rejected").otherwise("chosen")).otherwise(F.when(preferred == "first", "chosen").otherwise("rejected"))
    chosen, rejected = F.when(swapped, second_score).otherwise(first_score), F.when(swapped, first_score).otherwise(second_score)
    return {"preferred": unswapped, "margin": F.abs(chosen - rejected), "agrees": F.when(unswapped != "tie", unswapped == "chosen")}


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def margin_loss(anchor_positive: Column, anchor_negative: Column, margin: float) -> Column:
    return F.greatest(F.lit(0.0), margin - anchor_positive + anchor_negative)


# Width of the band of failed rewards, softness of the two gates.
FAILURE_BAND, REASONING_SOFTNESS, DISTANCE_SOFTNESS = 0.5, 0.05, 0.15


def covered(reward: Column, decided: Column, unparsed: Column, prior: Column, penalty: float = 0.1) -> Column:
    """Reasoning score in [-1, 0]: the reward as far as claims were decided, the prior for
    the rest; where none was, the prior less the penalty for unparsed text."""
    undecided = F.greatest(F.lit(0.0), prior - penalty * unparsed)
    return F.when(reward.isNull(), undecided).otherwise(decided * reward + (1 - decided) * prior) - 1


def failure_reward(distance: Column, reasoning: Column, most_distance: float, least_reasoning: float, said: Column) -> Column:
    """A failed rollout's place in the band from -1, by how near it came on both counts; -1
    where nothing was said."""
    near = F.when(distance > 0, F.least(F.lit(1.0), most_distance / distance)).otherwise(F.lit(1.0))
    reasoned = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (reasoning + 1) / (least_reasoning + 1)))
    return F.when(said, -1 + FAILURE_BAND * 0.5 * (near + reasoned)).otherwise(F.lit(-1.0))


def mixed_reward(distance: Column, comfort: Column, reasoning: Column, said: Column, most_distance: float, least_reasoning: float, weights: tuple[float, float, float]) -> Column:
    """Passing and failing reward, blended by the product of two soft gates. weights are
    those of distance, comfort and reasoning."""
    far, smooth, sound = weights
    passing = -far * (distance / most_distance) + smooth * comfort + sound * (1 - reasoning / least_reasoning)
    failing = failure_reward(distance, reasoning, most_distance, least_reasoning, F.lit(True))
    share = sigmoid((reasoning - least_reasoning) / REASONING_SOFTNESS) * sigmoid(-(distance - most_distance) / DISTANCE_SOFTNESS)
    return F.when(said, share * passing + (1 - share) * failing).otherwise(F.lit(-1.0))
