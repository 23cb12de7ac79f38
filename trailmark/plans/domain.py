"""Trajectory and claim pipelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import geometry
from trailmark.operators import claims, trajectories

from .registry import query

#: Tracks of one order's items: x grows with quantity, y follows the discount.
_TRACKS = """t AS (SELECT l_orderkey, (row_number() OVER w - 1)::INT AS i, (count(*) OVER (PARTITION BY l_orderkey))::INT AS n, sum(l_quantity / 25) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount ROWS UNBOUNDED PRECEDING) AS x, (l_discount - 0.05) * 60 AS y
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount)),
    d AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN i = 0 THEN lead(x) OVER w - x WHEN i = n - 1 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS vx,
        CASE WHEN n = 1 THEN 0 WHEN i = 0 THEN lead(y) OVER w - y WHEN i = n - 1 THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2 END AS vy FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
    u AS (SELECT *, sqrt(vx * vx + vy * vy) AS raw, atan2(vy, vx) AS a, atan2(vy, vx) - lag(atan2(vy, vx)) OVER (PARTITION BY l_orderkey ORDER BY i) AS da FROM d),
    h AS (SELECT *, first_value(a) OVER w + coalesce(sum(CASE WHEN abs(da) < pi() THEN da ELSE da - 2 * pi() * floor((da + pi()) / (2 * pi())) END) OVER w, 0) AS turn FROM u WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
    s AS (SELECT *, (coalesce(lag(raw) OVER w, raw) + raw + coalesce(lead(raw) OVER w, raw)) / 3 AS speed, (coalesce(lag(turn) OVER w, turn) + turn + coalesce(lead(turn) OVER w, turn)) / 3 AS heading FROM h WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
    c AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN i = 0 THEN lead(speed) OVER w - speed WHEN i = n - 1 THEN speed - lag(speed) OVER w ELSE (lead(speed) OVER w - lag(speed) OVER w) / 2 END AS acc FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
    f AS (SELECT l_orderkey, any_value(n) AS n, arg_min(speed, i) AS v0, arg_max(speed, i) AS v1, min(speed) AS low, arg_max(y, i) AS lat, degrees(arg_max(heading, i) - arg_min(heading, i)) AS turned, avg(acc) AS acc, arg_min(i, (speed, i)) AS pos, bool_or(speed < 0.5) AS slow FROM c GROUP BY 1),
    e AS (SELECT *, slow AND NOT v1 > 2 AS stop, (CASE WHEN v0 > 1e-6 THEN (v0 - low) / v0 ELSE 0 END > 0.3 OR low < 2) AND pos < n - 1 AND v0 - low > 1e-6 AND coalesce((v1 - low) / nullif(v0 - low, 0) >= 0.5, false) AS yields FROM f),
    k AS (SELECT *, CASE WHEN stop THEN 'stop' WHEN abs(turned) > 45 THEN CASE WHEN turned > 0 THEN 'turn_left' ELSE 'turn_right' END WHEN abs(lat) > 2.5 AND abs(turned) < 45 THEN CASE WHEN lat > 0 THEN 'lane_change_left' ELSE 'lane_change_right' END
        WHEN yields THEN 'yield' WHEN acc > 0.5 THEN 'proceed/accelerate' ELSE 'lane_keep' END AS label FROM e)"""


def _labelled(load):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount").rowsBetween(Window.unboundedPreceding, 0)
    point = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", F.array(F.sum(F.col("l_quantity") / 25).over(w), (F.col("l_discount") - 0.05) * 60).alias("p"))
    tracks = load("lineitem").withColumn("s", point).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["p"]).alias("track"))
    out = trajectories.features(tracks, "track", 1.0)
    return out.withColumn("label", trajectories.label(F.col("features")))


@query(f"""WITH {_TRACKS} SELECT l_orderkey, label, round(v0, 5) AS initial_speed, round(turned, 4) + 0.0 AS heading_change, round(acc, 5) + 0.0 AS mean_acceleration, stop AS stop_event, yields AS yield_event FROM k""")
def manoeuvre_labels(load):
    """Features and label of each track."""
    f = F.col("features")
    return _labelled(load).select("l_orderkey", "label", F.round(f["initial_speed"], 5).alias("initial_speed"), (F.round(f["heading_change"], 4) + 0.0).alias("heading_change"), (F.round(f["mean_acceleration"], 5) + 0.0).alias("mean_acceleration"), f["stop_event"].alias("stop_event"), f["yield_event"].alias("yield_event"))


@query(f"""WITH {_TRACKS}, v AS (SELECT label, least(abs((0.5 - greatest(low, 1e-6)) / greatest(low, 1e-6)), abs((abs(turned) - 45) / 45), abs((abs(lat) - 2.5) / 2.5), abs((45 - greatest(abs(turned), 1e-6)) / greatest(abs(turned), 1e-6)), abs((acc - 0.5) / 0.5)) AS m FROM k)
    SELECT label, count(*) AS n, count(*) FILTER (m <= 0.1) AS ambiguous, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM v GROUP BY 1""")
def label_report(load):
    """Label counts with how many lie near a threshold."""
    from pyspark.sql import Window

    d = _labelled(load).withColumn("near", trajectories.ambiguous(trajectories.margins(F.col("features"))))
    out = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("near").alias("ambiguous"))
    return out.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9))


@query(f"""WITH {_TRACKS}, q AS (SELECT l_orderkey, unnest(['stop', 'yield', 'decelerate', 'accelerate', 'proceed', 'turn', 'keep_lane', 'enter']) AS claim, CASE WHEN l_orderkey % 3 = 0 THEN 'left' WHEN l_orderkey % 3 = 1 THEN 'right' END AS side FROM k)
    SELECT claim, CASE claim
        WHEN 'stop' THEN CASE WHEN stop THEN 'PASS' ELSE 'FAIL' END WHEN 'yield' THEN CASE WHEN stop OR yields THEN 'PASS' ELSE 'FAIL' END
        WHEN 'decelerate' THEN CASE WHEN stop OR yields OR v0 - low >= 1 THEN 'PASS' ELSE 'FAIL' END WHEN 'accelerate' THEN CASE WHEN acc >= 0.5 OR v1 - v0 >= 1 THEN 'PASS' ELSE 'FAIL' END
        WHEN 'proceed' THEN CASE WHEN NOT stop AND v1 >= 2 THEN 'PASS' ELSE 'FAIL' END WHEN 'turn' THEN CASE WHEN abs(turned) >= 45 AND CASE side WHEN 'left' THEN turned > 0 WHEN 'right' THEN turned < 0 ELSE true END THEN 'PASS' ELSE 'FAIL' END
        WHEN 'keep_lane' THEN CASE WHEN abs(lat) <= 0.5 AND abs(turned) < 45 THEN 'PASS' ELSE 'FAIL' END ELSE 'ABSTAIN' END AS verdict, count(*) AS n
    FROM k JOIN q USING (l_orderkey) GROUP BY 1, 2""")
def commitment_verdicts(load):
    names = F.array(*[F.lit(c) for c in ("stop", "yield", "decelerate", "accelerate", "proceed", "turn", "keep_lane", "enter")])
    side = F.when(F.col("l_orderkey") % 3 == 0, "left").when(F.col("l_orderkey") % 3 == 1, "right")
    c = _labelled(load).select("features", side.alias("side"), F.explode(names).alias("claim"))
    return c.select("claim", claims.commitment_verdict(F.col("claim"), F.col("side"), F.col("features")).alias("verdict")).groupBy("claim", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH b AS (SELECT user_id, date_trunc('day', ts) AS beat, list(CASE WHEN value > 60 THEN 'PASS' WHEN value < 10 THEN 'FAIL' ELSE 'ABSTAIN' END) FILTER (event_type <> 'error') AS fx, list(CASE WHEN value > 40 THEN 'PASS' ELSE 'FAIL' END) FILTER (event_type = 'error') AS cs FROM events GROUP BY 1, 2)
    SELECT user_id, beat, CASE WHEN coalesce(len(fx), 0) = 0 OR coalesce(len(cs), 0) = 0 THEN 'ABSTAIN' WHEN list_contains(fx, 'FAIL') OR len(list_filter(cs, lambda x: x <> 'FAIL')) = 0 THEN 'FAIL'
        WHEN len(list_filter(fx, lambda x: x <> 'PASS')) = 0 AND list_contains(cs, 'PASS') THEN 'PASS' ELSE 'ABSTAIN' END AS verdict FROM b""")
def causal_verdicts(load):
    v = F.col("value")
    effect = F.when(v > 60, "PASS").when(v < 10, "FAIL").otherwise("ABSTAIN")
    b = load("events").groupBy("user_id", F.date_trunc("day", "ts").alias("beat")).agg(F.collect_list(F.when(F.col("event_type") != "error", effect)).alias("fx"), F.collect_list(F.when(F.col("event_type") == "error", F.when(v > 40, "PASS").otherwise("FAIL"))).alias("cs"))
    return b.select("user_id", "beat", claims.causal_verdict(F.col("fx"), F.col("cs")).alias("verdict"))


@query("""
    SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'turn,left,effect;pedestrian,crossing,cause' WHEN 'view' THEN 'stop,,effect;signal,red,cause'
        WHEN 'error' THEN 'yield,,effect;cyclist,ahead,seen' WHEN 'purchase' THEN 'lane_change,right,effect;construction_cones,blocking,cause' ELSE 'accelerate,,effect' END AS claims FROM events""")
def parsed_claims(load):
    """Claims in a sentence for each event."""
    said = {"click": "Turn left because a pedestrian is crossing", "view": "Stop since the traffic light is red", "error": "yield; cyclist ahead", "purchase": "change lanes right due to cones blocking"}
    text = F.lit("Accelerate smoothly")
    for kind, words in said.items():
        text = F.when(F.col("event_type") == kind, words).otherwise(text)
    e = load("events").select("user_id", "event_id", claims.parsed(text).alias("c"))
    known = F.filter("c", lambda x: x["key"] != "lane")
    return e.select("user_id", "event_id", F.array_join(F.transform(known, lambda x: F.concat_ws(",", x["key"], F.coalesce(x["detail"], F.lit("")), x["role"])), ";").alias("claims"))


@query("""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax * 100 AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, ['ahead', 'ahead_left', 'left', 'behind_left', 'behind', 'behind_right', 'right', 'ahead_right'][((floor((degrees(atan2(y - 4, x - 25)) + 22.5) / 45)::INT % 8 + 8) % 8) + 1] AS sector FROM a""")
def bearing_sectors(load):
    return load("lineitem").select("l_orderkey", "l_linenumber", geometry.bearing_sector(F.col("l_quantity") - 25, F.col("l_tax") * 100 - 4).alias("sector"))


@query("""
    SELECT p_partkey, round(cos(p_size / 10) * (p_retailprice / 100 - 3) - sin(p_size / 10) * (p_size - 2), 6) AS distance FROM part""")
def lane_centre_distances(load):
    yaw = F.col("p_size") / 10
    return load("part").select("p_partkey", F.round(geometry.lane_distance(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(2.0), F.lit(3.0), F.cos(yaw), F.sin(yaw)), 6).alias("distance"))
