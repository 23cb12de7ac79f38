from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import aggregates, claims, joins, mining, sampling, scoring, simlog, trajectories


def straight(n=40, v=10.0):
    return [[v * 0.1 * i, 0.0] for i in range(n)]


def turning(rate, n=40, v=8.0):
    out, x, y, yaw = [], 0.0, 0.0, 0.0
    for _ in range(n):
        out.append([x, y])
        x, y, yaw = x + v * 0.1 * math.cos(yaw), y + v * 0.1 * math.sin(yaw), yaw + rate * 0.1
    return out


def speeds(profile):
    out, x = [], 0.0
    for v in profile:
        out.append([x, 0.0])
        x += v * 0.1
    return out


def ramp(a, b, n):
    return [a + (b - a) * i / (n - 1) for i in range(n)]


TRACKS = {
    "lane_keep": straight(),
    "stop": speeds(ramp(8, 0, 20) + [0.0] * 20),
    "lane_change_left": [[i * 1.0, 3.0 / (1 + math.exp(-(i - 20) / 3))] for i in range(40)],
    "lane_change_right": [[i * 1.0, -3.0 / (1 + math.exp(-(i - 20) / 3))] for i in range(40)],
    "turn_left": turning(0.4),
    "turn_right": turning(-0.4),
    "yield": speeds(ramp(10, 3, 15) + ramp(3, 8, 25)),
    "proceed/accelerate": speeds(ramp(5, 15, 40)),
}


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([(k, t, None) for k, t in TRACKS.items()] + [("native", straight(), [1.0] * 40)], "name string, track array<array<double>>, accel array<double>")
    return trajectories.features(df, "track", 10.0, "accel").withColumn("label", trajectories.label(F.col("features"))).cache()


def test_analytic_tracks_get_their_labels(labelled):
    got = {r.name: r.label for r in labelled.collect()}
    assert got == {k: k for k in TRACKS} | {"native": "proceed/accelerate"}
    sources = {r.name: r.features.accel_source for r in labelled.collect()}
    assert sources["native"] == "native" and sources["stop"] == "finite_difference"


def test_margins_and_sanity(labelled):
    rows = labelled.select("name", trajectories.margins(F.col("features")).alias("m"), trajectories.well_driven(F.col("track"), 10.0).alias("ok")).collect()
    by = {r.name: r for r in rows}
    assert by["turn_left"].m["turn_heading"] > 0 > by["lane_keep"].m["turn_heading"]
    assert all(r.ok for r in rows)


def test_commitments(labelled):
    said = {"stop": ("stop", None, "PASS"), "turn_left": ("turn", "left", "PASS"), "turn_right": ("turn", "left", "FAIL"), "yield": ("stop", None, "FAIL"), "lane_change_left": ("lane_change", "left", "PASS"), "lane_keep": ("keep_lane", None, "PASS"), "proceed/accelerate": ("enter", None, "ABSTAIN")}
    df = labelled.sparkSession.createDataFrame([(k, c, d, v) for k, (c, d, v) in said.items()], "name string, claim string, side string, want string")
    for r in labelled.join(df, "name").select("name", "want", claims.commitment_verdict(F.col("claim"), F.col("side"), F.col("features")).alias("got")).collect():
        assert r.got == r.want, r.name


def test_parser():
    def keys(text):
        return [(c["kind"][0], c["key"], c["detail"], c["role"], c["beat"]) for c in claims.parse(text)]

    assert keys("Turn left because a pedestrian is crossing; accelerate") == [("c", "turn", "left", "effect", 0), ("p", "pedestrian", "crossing", "cause", 0), ("c", "accelerate", None, "effect", 1)]
    assert keys("Stop at the right-turn lane since the lead vehicle stopped ahead")[0] == ("c", "stop", "right", "effect", 0)
    assert keys("Slow down and turn right for the cyclist, then proceed") == [("c", "decelerate", None, "effect", 0), ("c", "turn", "right", "effect", 0), ("p", "cyclist", None, "cause", 0), ("c", "proceed", None, "effect", 1)]
    assert keys("nothing of note") == [] and claims.parse(None) == []
    text = "Wait for the right‑turn signal"
    spans = claims.parse(text)
    assert [text[c["start"] : c["end"]] for c in spans] == ["Wait", "signal"]


def test_causal(spark):
    rows = [([], ["PASS"], "ABSTAIN"), (["PASS", "FAIL"], ["PASS"], "FAIL"), (["PASS"], ["FAIL", "FAIL"], "FAIL"), (["PASS"], ["FAIL", "PASS"], "PASS"), (["PASS", "ABSTAIN"], ["PASS"], "ABSTAIN"), (["PASS"], ["ABSTAIN"], "ABSTAIN")]
    df = spark.createDataFrame(rows, "fx array<string>, cs array<string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", claims.causal_verdict(F.col("fx"), F.col("cs"))).collect())


def test_presence(spark):
    c = spark.createDataFrame([("a", "pedestrian"), ("a", "cyclist"), ("a", "signal")], "clip string, claim string")
    tracks = [("a", 1, "person", t, 10.0, 0.0) for t in (1, 2, 3)] + [("a", 2, "rider", t, 90.0, 0.0) for t in (1, 2)] + [("a", 3, "rider", 1, 1.0, 0.0)]
    t = spark.createDataFrame(tracks, "clip string, track_id int, label_class string, ts int, x double, y double")
    got = {r.claim: r.verdict for r in claims.presence_verdicts(c, t, "clip", (F.lit(1), F.lit(2))).collect()}
    assert got == {"pedestrian": "PASS", "cyclist": "FAIL", "signal": "ABSTAIN"}


def test_asof_against_brute_force(spark):
    rng = random.Random(1)
    left = [(k, rng.randint(0, 60), i) for i, k in enumerate("ab" * 40)]
    right = [(k, rng.randint(0, 60), i) for i, k in enumerate("ab" * 15)]
    a, b = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, j long")
    for direction in ("backward", "forward"):
        for r in joins.asof(a, b, ["k"], "t", ["j"], direction, tie="j").collect():
            near = [(t, j) for k, t, j in right if k == r.k and (t <= r.t if direction == "backward" else t >= r.t)]
            want = max(near, default=(None, None)) if direction == "backward" else min(near, default=(None, None))
            assert (r.matched_t, r.j if direction == "backward" else None) == (want[0], want[1] if direction == "backward" else None)
    for r in joins.nearest(a, b, ["k"], "t", "j").collect():
        times = {j: t for k, t, j in right}
        assert abs(times[r.j] - r.t) == min(abs(t - r.t) for k, t, _ in right if k == r.k)


def test_range_join_counts_each_pair_once(spark):
    points = spark.createDataFrame([("a", float(t)) for t in range(20)], "k string, t double")
    ranges = spark.createDataFrame([("a", 2.0, 7.0), ("a", 0.0, 19.0), ("b", 0.0, 9.0)], "k string, lo double, hi double")
    for bucket in (1.0, 4.0, 100.0):
        assert joins.within_range(points, ranges, ["k"], "t", "lo", "hi", bucket).count() == 26


def test_greedy_keep(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.1, 0.1, 10.1, 10.0), (3, 0.25, 0.0, 10.0, 10.0), (4, 0.1, 0.0, 20.0, 10.0), (5, 0.05, 0.0, 10.0, 10.15)]
    df = spark.createDataFrame([("t", *r) for r in rows], "town string, i int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.i for r in sampling.keep_apart(df, ["town"], ["i"], ["x0", "y0", "x1", "y1"], 0.2).collect()) == [1, 3, 4]


def test_sampling_repeats_on_any_partitioning(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    a, b = (sorted(r.id for r in sampling.quota(d, "s", "id", 10).collect()) for d in (df, df.repartition(13)))
    assert a == b and len(a) == 30
    ranks = sampling.global_rank(df.repartition(7), "id", 8).collect()
    assert all(r.n == r.id for r in ranks)
    times = sum(r.times for r in sampling.with_replacement(df.withColumn("w", F.col("id") + 1), "id", "w", 10_000).collect())
    assert abs(times - 10_000) < 60


def test_unique_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="repeated"):
        aggregates.require_unique(df, ["k"])
    assert aggregates.require_unique(df.distinct(), ["k"]).count() == 2


def test_cross_distance_equals_all_pairs(spark):
    rng = random.Random(3)
    a = [("s", float(rng.randint(0, 9))) for _ in range(12)]
    b = [("s", float(rng.randint(0, 9))) for _ in range(7)]
    got = mining.cross_distance(spark.createDataFrame(a, "s string, v double"), spark.createDataFrame(b, "s string, v double"), "s", "v").first()
    assert got["cross"] == pytest.approx(sum(abs(x - y) for _, x in a for _, y in b) / 84)


def test_mining_separates_a_real_change(spark):
    rng = random.Random(4)
    clean = [(s, "c", i, rng.gauss(0, 0.05)) for s in ("real", "null") for i in range(10)]
    changed = [("real", 3 + rng.gauss(0, 0.05)) for _ in range(10)] + [("null", rng.gauss(0, 0.05)) for _ in range(10)]
    floors = mining.scene_floors(spark.createDataFrame(clean, "scene string, cluster string, i int, v double"), "scene", "cluster", "i", "v")
    cross = mining.cross_distance(floors.sparkSession.createDataFrame([(s, v) for s, _, _, v in clean], "scene string, v double"), spark.createDataFrame(changed, "scene string, v double"), "scene", "v")
    got = mining.qualified(floors, cross, "scene", "cluster").collect()
    assert [(r.scene, r.rank_in_cluster) for r in got] == [("real", 1)] and got[0].z > 10


def test_route_scores(spark):
    rows = [("Perfect", 100.0, {"min_speed_infractions": [], "collisions": []}), ("Completed", 90.0, {"min_speed_infractions": ["x"], "collisions": []}), ("Completed", 50.0, {"min_speed_infractions": [], "collisions": ["y"]}), ("Failed - Agent crashed", 0.0, {"collisions": []})]
    df = spark.createDataFrame(rows, "status string, score_composed double, infractions map<string,array<string>>")
    r = scoring.merged(df, expected=3).first()
    assert (r.routes, r.driving_score, r.success_rate, r.complete) == (3, 80.0, pytest.approx(2 / 3), True)


def test_simulator_log(spark):
    actors = spark.createDataFrame([(1, "vehicle.a", "ego", 0, None), (2, "walker.b", "x", 2, 5)], "actor int, type_id string, role string, created int, destroyed int")
    assert {(r.actor, r.first_frame, r.last_frame) for r in simlog.alive(actors, 9).collect()} == {(1, 0, 9), (2, 2, 4)}
    assert [r.actor for r in simlog.actors_like(actors, "vehicle.*", "ego").collect()] == [1]
    states = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0), (2, 2, 4.0, 4.0, 0.0), (2, 0, 0.0, 0.0, -50.0)], "actor int, frame int, x double, y double, z double")
    assert simlog.states_between(actors, states, 0, 2, ["x"]).count() == 6
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [(r.frame, r.distance) for r in simlog.distances(states, pairs).collect()] == [(2, 5.0)]
    hits = spark.createDataFrame([(3, 1, [2, 7]), (4, 2, [1])], "frame int, actor int, others array<int>")
    assert sorted((r.frame, r.other) for r in simlog.collisions(hits, 1).collect()) == [(3, 2), (3, 7)]


def test_majority_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("baab")], "g int, i int, v string")
    assert aggregates.majority(df, ["g"], "v", [F.col("i")]).first().v == "b"
