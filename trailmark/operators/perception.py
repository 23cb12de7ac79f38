"""Tracks of what was seen, and what claims about them are worth.

Tracks are long rows: key, track_id, label_class, ts, x (ahead), y (left).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.claims import ENTITY_CLASSES

# Classes that tracks may have.
LABEL_CLASSES = ("automobile", "person", "rider", "other_vehicle", "trailer", "protruding_object", "bus", "heavy_truck", "animal", "stroller", "train_or_tram_car")
# Entities whose words claim more than a class shows; they never pass.
UNSEEN_ATTRIBUTES = ("stopped_vehicle", "lead_vehicle", "cutin_vehicle", "cross_traffic", "oncoming_traffic", "workers")
# Limits of presence, corridor and approach, in metres.
PRESENCE, SAMPLES, CORRIDOR_HALF, CORRIDOR_AHEAD, APPROACH = 50.0, 2, 1.75, 40.0, 2.0
#: State -> the property of a track that shows it; other states can't be told from tracks.
STATE_PROPERTIES = {"ahead": "ahead", "crossing": "crossing", "approaching": "nearing", "pulling_away": "leaving", "blocking": "in_corridor", "encroaching": "in_corridor", "nearby": "there"}


def faults(tracks: DataFrame, key: str, frame: str | None = None) -> DataFrame:
    """(key, fault, detail): foreign reference frames, unknown classes, tracks of more than
    one class."""
    unknown = tracks.where(~F.col("label_class").isin(*LABEL_CLASSES) | F.col("label_class").isNull()).select(key, F.lit("unknown class").alias("fault"), F.col("label_class").alias("detail"))
    mixed = tracks.groupBy(key, "track_id").agg(F.countDistinct("label_class").alias("n")).where("n > 1").select(key, F.lit("mixed classes").alias("fault"), F.col("track_id").cast("string").alias("detail"))
    out = unknown.unionByName(mixed)
    if frame:
        out = out.unionByName(tracks.where(~F.col(frame).eqNullSafe("rig")).select(key, F.lit("foreign frame").alias("fault"), F.col(frame).alias("detail")))
    return out.distinct()


def load_tracks(tracks: DataFrame, key: str, strict: bool = False, frame: str | None = None) -> DataFrame:
    """Tracks that claims can be held against.

    Strict: any fault raises. Lenient: rows of unknown classes go, then tracks that still
    have more than one class; keys without a row left have no tracks at all. Foreign
    reference frames raise either way, since no distance would mean anything.
    """
    found = faults(tracks, key, frame)
    if not strict:
        found = found.where("fault = 'foreign frame'")
    if strict or frame:
        some = found.limit(5).collect()
        if some:
            raise ValueError("; ".join(f"{r[key]}: {r['fault']} {r['detail']}" for r in some))
    known = tracks.where(F.col("label_class").isin(*LABEL_CLASSES))
    track = Window.partitionBy(key, "track_id")
    marked = known.withColumn("_least", F.min("label_class").over(track)).withColumn("_most", F.max("label_class").over(track))
    return marked.where("_least = _most").drop("_least", "_most")


def present(tracks: DataFrame, key: str, window: tuple[Column, Column], most_distance: float = PRESENCE, least_samples: int = SAMPLES) -> DataFrame:
    """One row per track that was there within the window (ends included), with the
    properties that states ask for."""
    distance, at = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), F.col("ts")
    seen = tracks.where(at.between(*window)).groupBy(key, "track_id", "label_class")
    seen = seen.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(distance).alias("closest"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        (F.min_by("y", at) * F.max_by("y", at)).alias("sides"),
        (F.max_by(distance, at) - F.min_by(distance, at)).alias("gain"),
    )
    x, y = F.col("mean_x"), F.col("mean_y")
    shown = {
        "there": F.lit(True),
        "ahead": x > 0,
        "crossing": F.col("sides") < 0,
        "nearing": F.col("gain") <= -APPROACH,
        "leaving": F.col("gain") >= APPROACH,
        "in_corridor": (x > 0) & (x <= CORRIDOR_AHEAD) & (F.abs(y) <= CORRIDOR_HALF),
    }
    return seen.where((F.col("n") >= least_samples) & (F.col("closest") <= most_distance)).select(key, "track_id", "label_class", *[c.alias(n) for n, c in shown.items()])


def state_verdicts(claims: DataFrame, tracks: DataFrame, key: str, window: tuple[Column, Column], most_distance: float = PRESENCE, least_samples: int = SAMPLES) -> DataFrame:
    """claims (key, claim, detail: the state or null) with existence, state and verdict.

    A state holds if one track of the entity's classes shows it. FAIL of either part
    decides; entities without classes and states without a property abstain; entities
    whose words claim more than a class shows can fail, but abstain where they'd pass.
    """
    spark = claims.sparkSession
    classes = spark.createDataFrame([(e, c) for e, cs in ENTITY_CLASSES.items() for c in cs], "claim string, label_class string")
    properties = list(dict.fromkeys(STATE_PROPERTIES.values()))
    shown = present(tracks, key, window, most_distance, least_samples).join(F.broadcast(classes), "label_class").groupBy(key, "claim").agg(*[F.bool_or(p).alias(f"_{p}") for p in properties])
    out = claims.join(shown, [key, "claim"], "left")
    state = F.col("detail")
    holds = reduce(lambda rest, s: F.when(state == s, F.col(f"_{STATE_PROPERTIES[s]}")).otherwise(rest), STATE_PROPERTIES, F.lit(None).cast("boolean"))
    known, there = F.col("claim").isin(*ENTITY_CLASSES), F.coalesce("_there", F.lit(False))
    word = lambda c: F.when(c, "PASS").otherwise("FAIL")
    existence = F.when(~known, "ABSTAIN").otherwise(word(there))
    decided = known & there & state.isin(*STATE_PROPERTIES)
    stated = F.when(state.isNotNull(), F.when(decided, word(holds)).otherwise("ABSTAIN"))
    both = out.withColumn("existence", existence).withColumn("state", stated)
    passes = (F.col("existence") == "PASS") & (F.col("state").isNull() | (F.col("state") == "PASS")) & ~F.col("claim").isin(*UNSEEN_ATTRIBUTES)
    fails = (F.col("existence") == "FAIL") | F.coalesce(F.col("state") == "FAIL", F.lit(False))
    verdict = F.when(fails, "FAIL").when(passes, "PASS").otherwise("ABSTAIN")
    return both.withColumn("verdict", verdict).drop(*[f"_{p}" for p in properties])
