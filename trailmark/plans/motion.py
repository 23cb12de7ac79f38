"""Turns, steps and sanity of motion, and the text helpers of its logs, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import geometry, sequences, text
from trailmark.operators import trajectories

from .registry import query


def _about(axis: tuple[float, float, float], angle):
    """Quaternion columns of a turn by angle about a unit axis."""
    return (*[F.sin(angle / 2) * a for a in axis], F.cos(angle / 2))


@query("""
    WITH v AS (SELECT o_orderkey, o_custkey / 100.0::DOUBLE AS a, o_totalprice / 100000 AS x, o_custkey % 3 AS y, 1.0::DOUBLE AS z FROM orders),
         d AS (SELECT *, (x + 2 * y + 2 * z) / 9 AS along FROM v)
    SELECT o_orderkey, round(x * cos(a) + (2 * z - 2 * y) / 3 * sin(a) + along * (1 - cos(a)), 6) + 0.0 AS x, round(y * cos(a) + (2 * x - z) / 3 * sin(a) + 2 * along * (1 - cos(a)), 6) + 0.0 AS y,
      round(z * cos(a) + (y - 2 * x) / 3 * sin(a) + 2 * along * (1 - cos(a)), 6) + 0.0 AS z FROM d""")
def quaternion_turns(load):
    """Points turned about an axis by unit quaternions."""
    q = _about((1 / 3, 2 / 3, 2 / 3), F.col("o_custkey") / 100.0)
    turned = geometry.quaternion_rotate(q, (F.col("o_totalprice") / 100000, (F.col("o_custkey") % 3).cast("double"), F.lit(1.0)))
    return load("orders").select("o_orderkey", *[(F.round(c, 6) + 0.0).alias(n) for n, c in zip("xyz", turned)])


@query("""
    WITH a AS (SELECT p_partkey, p_size / 40.0::DOUBLE AS a, p_size % 7 / 3.0::DOUBLE AS b, least(1, greatest(0, p_partkey % 13 / 10.0::DOUBLE - 0.1)) AS t FROM part)
    SELECT p_partkey, round(0.6 * sin((a + t * (b - a)) / 2), 6) + 0.0 AS qx, round(0.8 * sin((a + t * (b - a)) / 2), 6) + 0.0 AS qy, round(cos((a + t * (b - a)) / 2), 6) + 0.0 AS qw FROM a""")
def rotations_between(load):
    """Rotations between two turns about one axis, at shares inside and outside of [0, 1]."""
    a, b = F.col("p_size") / 40.0, F.col("p_size") % 7 / 3.0
    q = geometry.slerp(_about((0.6, 0.8, 0.0), a), _about((0.6, 0.8, 0.0), b), F.col("p_partkey") % 13 / 10.0 - 0.1)
    return load("part").select("p_partkey", *[(F.round(q[i], 6) + 0.0).alias(n) for i, n in ((0, "qx"), (1, "qy"), (3, "qw"))])


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS speed, l_tax * 10 AS yaw, l_discount * 5 AS steer, l_quantity - 30 AS acc FROM lineitem), k AS (SELECT *, atan(1.5 / (1.2 + 1.5) * tan(steer)) AS slip FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, round(speed * cos(yaw + slip) * 0.5, 6) + 0.0 AS x, round(speed * sin(yaw + slip) * 0.5, 6) + 0.0 AS y, round(yaw + speed / 1.5 * sin(slip) * 0.5, 6) AS yaw, greatest(0, speed + acc * 0.5) AS speed FROM k""")
def bicycle_steps(load):
    start = (F.lit(0.0), F.lit(0.0), F.col("l_tax") * 10, F.col("l_quantity"), F.col("l_discount") * 5, F.col("l_quantity") - 30)
    x, y, yaw, speed = geometry.bicycle_step(*start, 0.5, 1.2, 1.5)
    return load("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"), F.round(yaw, 6).alias("yaw"), speed.alias("speed"))


_ORDER = ("l_linenumber", "l_partkey", "l_quantity", "l_tax")


@query("""
    WITH s AS (SELECT l_orderkey, (list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity, l_tax))[3:5] AS part FROM lineitem GROUP BY 1)
    SELECT l_orderkey, coalesce(list_sum(part), 0) AS total, len(part) AS n FROM s""")
def time_windows(load):
    """Sum and length of the samples between two times, by index."""
    items = load("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("s"))
    part = sequences.time_slice(F.transform("s", lambda x: x["l_quantity"]), 0.25, 0.4, 0.1)
    return items.select("l_orderkey", F.aggregate(part, F.lit(0.0), lambda a, v: a + v).alias("total"), F.size(part).cast("long").alias("n"))


@query("""
    WITH d AS (SELECT l_orderkey, sqrt(power(l_quantity - lag(l_quantity) OVER w, 2) + power(l_tax * 100 - lag(l_tax * 100) OVER w, 2)) AS speed, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_tax)),
         c AS (SELECT *, abs(speed - lag(speed) OVER (PARTITION BY l_orderkey ORDER BY r)) AS change FROM d)
    SELECT l_orderkey, count(*) >= 3 AND coalesce(max(speed), 0) <= 40.5 AND coalesce(max(change), 0) <= 12.5 AS sane FROM c GROUP BY 1""")
def sane_tracks(load):
    """Whether an order's track stays within bounds of speed and its change."""
    items = load("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("s"))
    track = F.transform("s", lambda x: F.array(x["l_quantity"], x["l_tax"] * 100))
    return items.select("l_orderkey", F.coalesce(trajectories.well_driven(track, 1.0, 40.5, 12.5), F.lit(False)).alias("sane"))


@query("""
    SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace(coalesce(text, ''), '^\\s*', ''), '\\s*$', '') ELSE trim(coalesce(text, ''), ' ') END) AS inside FROM documents""")
def fenced_texts(load):
    """Texts, every other one inside a fenced block, with the fence stripped."""
    body = F.coalesce("text", F.lit(""))
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return load("documents").select("doc_id", F.md5(text.strip_fence(fenced)).alias("inside"))


@query("""
    SELECT event_id, date_trunc('second', ts::TIMESTAMP) + to_hours(CASE user_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 0 END) AS utc FROM events""")
def log_stamps(load):
    """Log stamps of three zones as UTC, null for others."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ("PDT", "PST", "UTC", "CET")]), (F.col("user_id") % 4 + 1).cast("int"))
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    return load("events").select("event_id", text.log_time(stamp, zone).cast("timestamp_ntz").alias("utc"))


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN false WHEN turn % 4 = 1 THEN true ELSE coalesce(regexp_replace(text, '\\s+', '', 'g'), '') = '' END AS degenerate FROM conversations""")
def degenerate_alternatives(load):
    """Alternatives forced or not, with no text, with a blank one or with a real one."""
    texts = F.when(F.col("turn") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("text"))
    forced = F.when(F.col("turn") % 4 != 0, F.struct(texts.alias("cot")))
    return load("conversations").select("conv_id", "turn", text.degenerate(forced, forced["cot"]).alias("degenerate"))
