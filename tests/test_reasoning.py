from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import geometry, statistics
from trailmark.functions import sequences as S
from trailmark.operators import aggregates, claims, perception, perturbations, sampling


def test_unparsed_spans():
    text = "Turn left because the pedestrian is crossing quite fast; and then we stop"
    assert [text[a:b] for a, b in claims.unparsed(text)] == [" left because the ", " quite fast; and then we "]
    assert claims.unparsed("") == [] and claims.unparsed(None) == []
    assert claims.unparsed("and the") == [] and claims.unparsed("big gap") == [(0, 7)]


def test_beats_need_space_before_then():
    assert [b[:2] for b in claims.beats("stop, then go; wait.  Turn")] == [(0, 4), (10, 13), (14, 19), (22, 26)]
    assert len(claims.beats("stop-then go")) == 1


def test_cause_first(spark):
    want = {
        "Nudge left due to cones blocking the lane, then accelerate": ("Due to cones blocking the lane, nudge left, then accelerate", 1),
        "stop because, after a while, it rains; GO since open": ("because after a while, it rains, stop;Since open, GO", 2),
        "no cause": ("no cause", 0),
        None: ("", 0),
        "": ("", 0),
        "Halt after \U0001f6a6 turns red. Wait , because of it": ("After \U0001f6a6 turns red, halt. Because of it, wait ", 2),
        "\U0001f6a6 stop as needed": ("\U0001f6a6 stop as needed", 0),
        "; Since it rains; then for": ("; Since it rains; then for".replace(" Since it rains", "Since it rains, ").replace(" for", "for , "), 2),
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    for r in df.select("t", claims.cause_first(F.col("t")).alias("c")).collect():
        assert tuple(r.c) == want[r.t], r


def test_words_keep_their_case():
    assert [perturbations.recased("right", w) for w in ("left", "Left", "LEFT", "LeFt", "lEFT")] == ["right", "Right", "RIGHT", "Right", "right"]


def test_rule_changes():
    def made(text):
        return {c["kind"]: (c["original"], c["changed"], c["text"]) for c in perturbations.rule_changes(text)}

    got = made("Nudge LEFT since the Pedestrians ahead at 2.5 m are blocking")
    assert got["direction"] == ("LEFT", "RIGHT", "Nudge RIGHT since the Pedestrians ahead at 2.5 m are blocking")
    assert got["entity"][:2] == ("Pedestrians", "Cyclists") and got["quantity"][:2] == ("2.5 m", "25.0 m")
    assert "state" not in got  # the nearest state is "ahead", which has no opposite
    assert "entity" not in made("Stop for the scooter rider") and made("Stop for the scooter ahead")["entity"][1] == "pedestrian"
    assert "state" not in made("Wait, the gate was blocked") and made("Wait, the gate is closed")["state"][1] == "open"
    assert made("") == {} and perturbations.rule_changes(None) == []


def test_changes_are_validated():
    ok = perturbations.valid_change
    assert ok("a b a", "a", "c", "a b c") and ok("a b a", "a", "c", "c b a")
    assert not ok("a b a", "a", "c", "c b c") and not ok("a", "a", "a", "a") and not ok("a", "x", "y", "a")
    assert not ok("a", "a", "b c d e", "b c d e")


TRACKS = "clip string, track_id string, label_class string, ts long, x double, y double, frame string"


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [("a", "1", "person", t, 10.0 - 3 * t, 2.0 - t, "rig") for t in range(5)]
    rows += [("a", "2", "automobile", t, 20.0, 1.0, "rig") for t in range(5)] + [("a", "3", "bus", 0, 5.0, 0.0, "rig")]
    rows += [("b", "1", "rider", t, 60.0, 0.0, "rig") for t in range(5)]
    return spark.createDataFrame(rows, TRACKS)


def test_state_verdicts(spark, tracks):
    said = [
        ("a", "pedestrian", "crossing", "PASS"), ("a", "pedestrian", "approaching", "PASS"), ("a", "pedestrian", "pulling_away", "FAIL"), ("a", "pedestrian", None, "PASS"), ("a", "pedestrian", "red", "ABSTAIN"),
        ("a", "vehicle_generic", "blocking", "PASS"), ("a", "vehicle_generic", "crossing", "FAIL"), ("a", "stopped_vehicle", "ahead", "ABSTAIN"), ("a", "stopped_vehicle", "crossing", "FAIL"),
        ("a", "cyclist", "nearby", "FAIL"), ("b", "cyclist", "nearby", "FAIL"), ("a", "signal", "green", "ABSTAIN"), ("c", "workers", None, "FAIL"), (None, "pedestrian", None, "FAIL"),
    ]
    df = spark.createDataFrame(said, "clip string, claim string, detail string, want string")
    for r in perception.state_verdicts(df, tracks, "clip", (F.lit(0), F.lit(4))).collect():
        assert r.verdict == r.want, r
    late = perception.state_verdicts(df.where("claim = 'pedestrian' and detail is null and clip = 'a'"), tracks, "clip", (F.lit(4), F.lit(9))).collect()
    assert [r.verdict for r in late] == ["FAIL"]  # one sample is no presence
    assert perception.state_verdicts(df.limit(0), tracks, "clip", (F.lit(0), F.lit(4))).count() == 0


def test_strict_and_lenient_loading(spark, tracks):
    assert perception.load_tracks(tracks, "clip", strict=True, frame="frame").count() == tracks.count()
    bad = tracks.unionByName(spark.createDataFrame([("a", "2", "bus", 9, 0.0, 0.0, "rig"), ("b", "1", "ghost", 9, 0.0, 0.0, "rig"), ("c", "1", None, 0, 0.0, 0.0, "rig")], TRACKS))
    with pytest.raises(ValueError, match="ghost|mixed"):
        perception.load_tracks(bad, "clip", strict=True)
    left = {(r.clip, r.track_id): r["count"] for r in perception.load_tracks(bad, "clip").groupBy("clip", "track_id").count().collect()}
    assert left == {("a", "1"): 5, ("a", "3"): 1, ("b", "1"): 5}
    world = tracks.withColumn("frame", F.lit("world"))
    with pytest.raises(ValueError, match="foreign frame"):
        perception.load_tracks(world, "clip", frame="frame")


def test_gate(spark):
    rows = [("a", True, 0.9, 0.9), ("a", False, 0.4, 0.4), ("b", True, 0.9, 0.9), ("b", False, 0.6, 0.6), ("c", True, 0.6, 0.6), ("d", True, 1.2, 1.2), ("e", True, 0.9, 0.5), ("f", False, 0.1, 0.1), ("g", True, float("nan"), 0.9)]
    df = spark.createDataFrame(rows, "scene string, positive boolean, score double, total double")
    got = {r.scene: (r.passed, r.failures) for r in perturbations.gate(df, "scene", F.col("positive"), F.col("score"), F.array("total")).collect()}
    assert got == {"a": (True, []), "b": (False, ["wrong case too high"]), "c": (False, ["positive too low"]), "d": (False, ["over budget"]), "e": (False, ["parts differ"]), "f": (False, ["positive too low"]), "g": (False, ["missing score", "positive too low"])}


def test_wrong_tracks(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.0], [1.0, 3.0]],), ([[2.0, 2.0]],), ([],)], "track array<array<double>>")
    rows = df.select(perturbations.unreacting_track(F.col("track")).alias("on"), perturbations.tells_apart(F.col("track"), perturbations.unreacting_track(F.col("track"))).alias("apart")).collect()
    assert [r.on for r in rows] == [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], [[2.0, 2.0]], []] and [r.apart for r in rows] == [True, False, False]


def test_distributions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1000.0],)], "l array<double>")
    p = statistics.softmax(F.col("l"))
    r = df.select(p.alias("p"), statistics.entropy(p).alias("h"), statistics.largest(p, 2).alias("two"), statistics.negative_log_likelihood(F.col("l"), F.lit(1)).alias("nll"), statistics.negative_log_likelihood(F.col("l"), F.lit(9)).alias("none")).first()
    e = [math.exp(-2), 1, 1, 0]
    want = [x / sum(e) for x in e]
    assert r.p == pytest.approx(want) and r.h == pytest.approx(-sum(x * math.log(max(x, 1e-12)) for x in want))
    assert [t.position for t in r.two] == [1, 2] and r.nll == pytest.approx(-math.log(want[1])) and r.none is None


def test_ids_and_slices(spark):
    df = spark.createDataFrame([([5, 6], [0, 1], [7, 10, 3, 11, 7], [0.0, 0.1, 0.2, 0.3])], "said array<long>, moves array<long>, ids array<long>, x array<double>")
    n, ended = S.tokens_before(F.col("ids"), 3, 10, 5)
    n2, ended2 = S.tokens_before(F.col("ids"), 99, 10, 5)
    r = df.select(S.assembled(1, F.col("said"), [2, 3], F.col("moves"), 4, 100).alias("a"), n.alias("n"), ended.alias("e"), n2.alias("n2"), ended2.alias("e2"), S.time_slice(F.col("x"), 0.1, 0.2, 0.1).alias("s")).first()
    assert r.a == [1, 5, 6, 2, 3, 100, 101, 4] and (r.n, r.e, r.n2, r.e2) == (1, True, 2, False) and r.s == [0.1, 0.2]


def test_poses(spark):
    half = math.sqrt(0.5)
    q = tuple(F.lit(v) for v in (0.0, 0.0, 2 * half, 2 * half))  # a quarter turn, not of unit length
    moved = geometry.to_camera((F.lit(1.0), F.lit(2.0), F.lit(3.0)), q, (F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    path = geometry.unicycle_path(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.5)), F.lit(2.0), 1.0)
    r = spark.range(1).select(F.array(*moved).alias("m"), path.alias("p")).first()
    assert r.m == pytest.approx([1.0, 0.0, 2.0])
    assert (r.p[0].x, r.p[0].y) == (2.0, 0.0) and r.p[1].heading == pytest.approx(1.0) and r.p[1].x == pytest.approx(2 + 1 + math.cos(1.0))


def greedy(rows, distance):
    kept = []
    for g, _, *p in sorted(rows, key=lambda r: (r[0], r[1])):
        if not any(k[0] == g and all(math.hypot(k[1][i] - p[i], k[1][i + 1] - p[i + 1]) <= distance for i in (0, 2)) for k in kept):
            kept.append((g, p))
    return len(kept), {(g, *p) for g, p in kept}


@pytest.mark.parametrize("few", [20, 100_000])
def test_keep_apart_in_rounds_equals_in_order(spark, few):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, *(round(rng.uniform(0, 3), 2) for _ in range(4))) for i in range(500)]
    rows += [("a", 500 + i, 1.0, 1.0, 1.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "town string, n int, a double, b double, c double, d double")
    got = sampling.keep_apart(df, ["town"], ["n"], ["a", "b", "c", "d"], 0.7, few).collect()
    n, want = greedy(rows, 0.7)
    assert len(got) == n and {(r.town, r.a, r.b, r.c, r.d) for r in got} == want


def test_global_rank_over_many_tasks(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 100_003).alias("v"))
    rows = sampling.global_rank(df, "v", rows_per_task=600).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.v)] == list(range(5000))
    assert sampling.global_rank(df.limit(0), "v").count() == 0


def test_smoothed_in_chunks(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.random()) for g in "ab" for i in range(257)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    for chunk in (1, 7, 1000):
        got = {r.g: r.ema for r in aggregates.smoothed(df, ["g"], ["i"], "v", 0.3, 0.6, 0.35, 0.8, chunk).collect()}
        for g in "ab":
            a = 0.6
            for h, _, v in rows:
                if h == g:
                    a = max(0.35, min(0.8, a * 0.7 + v * 0.3))
            assert got[g] == pytest.approx(a, abs=1e-12)


def test_rebalanced(spark):
    rows = [(i, "rare" if i < 10 else "common" if i < 4000 else "thin") for i in range(8000)]
    out = sampling.rebalanced(spark.createDataFrame(rows, "k long, c string"), "k", "c", 1000, 5, {"thin": 0.05}).collect()
    total = {c: sum(r.times for r in out if r.c == c) for c in ("rare", "common", "thin")}
    assert total["rare"] == 50 and abs(total["common"] - 1000) < 80 and abs(total["thin"] - 1000) < 120 and max(r.times for r in out) <= 5


def test_polynomials_and_phrases(spark):
    from trailmark.functions import text

    df = spark.createDataFrame([("0.0 + 931.87·th + 28.17·th² - 66.33·th³ +\n20.03·th⁴", "Stop here", None), ("- (3.90e-08)·th² + 1.5", "stop here", " "), (None, None, "x")], "p string, said string, cot string")
    rows = df.select(text.polynomial(F.col("p"), "th").alias("p"), text.rephrased(F.col("said"), {"Stop": ["Halt"]}, F.lit("1")).alias("s"), text.blank(F.col("cot")).alias("b")).collect()
    assert rows[0].p == [0.0, 931.87, 28.17, -66.33, 20.03] and rows[1].p == [1.5, 0.0, -3.9e-08, 0.0, 0.0]
    assert [r.s for r in rows] == ["Halt here", "halt here", None] and [r.b for r in rows] == [False, True, False]
