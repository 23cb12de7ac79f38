"""A simulator's recorder log as tables.

A log is text: a header, frames that begin with the word Frame, and a closing record. Each
frame is read as a record of its own, so a log of any length is split over tasks; inside a
frame a line of one space opens a section and lines of two belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What parts one record from the next.
FRAME = "Frame "


def records(spark: SparkSession, path: str) -> DataFrame:
    """log (the file's name) and text of each record."""
    return spark.read.option("lineSep", FRAME).text(path).select(F.col("_metadata.file_name").alias("log"), F.col("value").alias("text"))


def simulation(logs: DataFrame) -> DataFrame:
    """log, map, date, total_frames, duration: from a log's first and last records."""
    pick = lambda pattern: F.max(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")))
    out = logs.groupBy("log").agg(pick(r"(?m)^Map: (.*)$").alias("map"), pick(r"(?m)^Date: (.*)$").alias("date"), pick(r"(?m)^Frames: ([0-9]+)").alias("total_frames"), pick(r"(?m)^Duration: ([0-9.]+) seconds").alias("duration"))
    return out.withColumn("total_frames", F.col("total_frames").cast("long")).withColumn("duration", F.col("duration").cast("double"))


def lines(logs: DataFrame) -> DataFrame:
    """log, frame, elapsed, place, section and line, in one row per line of a frame."""
    head = r"^([0-9]+) at ([0-9.]+) seconds"
    frames = logs.where(F.col("text").rlike(head)).select("log", F.regexp_extract("text", head, 1).cast("long").alias("frame"), F.regexp_extract("text", head, 2).cast("double").alias("elapsed"), F.split("text", r"\n(?= [^ \n])").alias("sections"))
    # a section's lines lie together, so none are shuffled: a frame is cut before each line that opens one
    first = F.aggregate("sections", F.array(F.lit(0)), lambda at, s: F.concat(at, F.array(F.element_at(at, -1) + F.size(F.split(s, "\n")))))
    parts = frames.select("log", "frame", "elapsed", first.alias("first"), F.posexplode("sections").alias("k", "part"))
    opener = F.when(F.col("k") > 0, F.trim(F.substring_index("part", "\n", 1)))
    out = parts.select("log", "frame", "elapsed", F.get("first", "k").alias("first"), opener.alias("section"), F.posexplode(F.split("part", "\n")).alias("i", "line"))
    return out.select("log", "frame", "elapsed", (F.col("first") + F.col("i")).alias("place"), "line", "section")


def frames(told: DataFrame) -> DataFrame:
    """log, frame, elapsed, delta and platform_time."""
    stamp = F.when(F.col("line").startswith(" Current platform time"), F.element_at(F.split("line", " "), -1).try_cast("double"))
    out = told.groupBy("log", "frame").agg(F.first("elapsed").alias("elapsed"), F.max(stamp).alias("platform_time"))
    before = Window.partitionBy("log").orderBy("frame")  # a row per frame
    return out.withColumn("delta", F.coalesce(F.bround(F.col("elapsed") - F.lag("elapsed").over(before), 6), F.lit(0.0)))


def _word(indent: int, k: int) -> Column:
    """Word k from 0 of a line, without brackets, commas and colons around it."""
    return F.regexp_replace(F.get(F.split(F.substring("line", indent + 1, 1 << 20), " "), F.lit(k)), r"^\(|[,:)]+$", "")


def _number(indent: int, k: int) -> Column:
    return _word(indent, k).try_cast("double")


def actors(told: DataFrame) -> DataFrame:
    """log, actor, type_id, created, destroyed, parent and attributes (a map)."""
    line, actor = F.col("line"), _word(1, 1).try_cast("long")
    known = {
        "Create": {"type_id": _word(1, 2), "created": F.col("frame")},
        "Destroy": {"destroyed": F.col("frame")},
        "Parenting": {"parent": _word(1, 3).try_cast("long")},
    }
    kind = F.regexp_extract(line, r"^ (Create|Destroy|Parenting) ", 1)
    opener = F.regexp_extract("section", r"^Create ([0-9]+):", 1).try_cast("long")
    own = F.when(line.rlike("^  [^ ].* = "), F.struct(F.substring_index(F.trim(line), " = ", 1).alias("key"), F.regexp_replace(line, r"^.*? = ", "").alias("value")))
    fields = [F.when(kind == k, c).alias(n) for k, cs in known.items() for n, c in cs.items()]
    told = told.where(line.rlike("^ (Create|Destroy|Parenting) ") | F.col("section").startswith("Create "))
    rows = told.select("log", F.when(kind != "", actor).otherwise(opener).alias("actor"), *fields, F.when(opener.isNotNull() & (kind == ""), own).alias("own")).where("actor is not null")
    return rows.groupBy("log", "actor").agg(*[F.max(c).alias(c) for c in ("type_id", "created", "destroyed", "parent")], F.map_from_entries(F.array_distinct(F.collect_list("own"))).alias("attributes"))


def states(told: DataFrame) -> DataFrame:
    """log, frame, actor: pose (metres and degrees), control and velocity, each null where a
    frame doesn't tell."""
    places = {
        "Positions": {"x": (3, 100.0), "y": (4, 100.0), "z": (5, 100.0), "roll": (7, 1.0), "pitch": (8, 1.0), "yaw": (9, 1.0)},
        "Vehicle animations": {"steer": (3, 1.0), "throttle": (5, 1.0), "brake": (7, 1.0), "gear": (11, 1.0)},
        "Dynamic actors": {"velocity_x": (3, 1.0), "velocity_y": (4, 1.0), "velocity_z": (5, 1.0)},
    }
    inside = told.where(F.col("line").startswith("  ") & F.col("section").rlike("^(" + "|".join(places) + ")"))
    fields = [F.max(F.when(F.col("section").startswith(s), _number(2, k) / scale)).alias(n) for s, cs in places.items() for n, (k, scale) in cs.items()]
    return inside.groupBy("log", "frame", _word(2, 1).try_cast("long").alias("actor")).agg(*fields)


def collisions(told: DataFrame) -> DataFrame:
    """log, frame, actor and other of each collision."""
    hit = told.where(F.col("line").startswith(" Collision"))
    return hit.select("log", "frame", _word(1, 4).try_cast("long").alias("actor"), F.element_at(F.split("line", " "), -1).try_cast("long").alias("other"))


def criteria(df: DataFrame, column: str) -> DataFrame:
    """Of a map of criteria the three fields that a report needs, a row each."""
    out = df.select(*[c for c in df.columns if c != column], F.explode(column).alias("criterion", "_c"))
    return out.select(*[c for c in out.columns if c != "_c"], *[F.col(f"_c.{n}").alias(n) for n in ("test_status", "actual_value", "success_value")])
