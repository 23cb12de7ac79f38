from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import geometry, hashing, sequences, statistics, text
from trailmark.operators import rewards

RNG = np.random.default_rng(2)
SERIES = [RNG.normal(5, 4, n).round(3).tolist() for n in (2, 3, 5, 8, 21, 64)]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(SERIES)], "i int, x array<double>")


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_gradient(series):
    for got, x in zip(values(series, sequences.gradient(F.col("x"), 0.1)), SERIES):
        assert got == pytest.approx(np.gradient(x, 0.1))


def test_moving_average(series):
    for w in (1, 3, 4, 5):
        for got, x in zip(values(series, sequences.moving_average(F.col("x"), w)), SERIES):
            padded = np.pad(x, w // 2, mode="edge")
            assert got == pytest.approx(np.convolve(padded, np.ones(w) / w, "valid")[: len(x)])


def test_unwrap_and_running_sum(series):
    for got, x in zip(values(series, sequences.unwrap(F.col("x"))), SERIES):
        assert got == pytest.approx(np.unwrap(x))
    for got, x in zip(values(series, sequences.running_sum(F.col("x"))), SERIES):
        assert got == pytest.approx(np.cumsum(x))


def test_longest_run(series):
    def brute(x):
        best = run = 0
        for v in x:
            run = run + 1 if v < 5 else 0
            best = max(best, run)
        return best

    assert values(series, sequences.longest_run(F.transform("x", lambda v: v < 5))) == [brute(x) for x in SERIES]


def test_savgol(series):
    for deriv in (0, 1, 2):
        for got, x in zip(values(series, sequences.savgol(F.col("x"), 7, 2, deriv, 0.5)), SERIES):
            if len(x) < 7:
                assert got is None
                continue
            want = []
            for i in range(len(x)):
                a = max(0, min(i - 3, len(x) - 7))
                fit = np.polynomial.Polynomial.fit(np.arange(7) * 0.5, x[a : a + 7], 2).deriv(deriv) if deriv else np.polynomial.Polynomial.fit(np.arange(7) * 0.5, x[a : a + 7], 2)
                want.append(fit((i - a) * 0.5))
            assert got == pytest.approx(want, abs=1e-8)


def test_interpolation_clamps(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 3.0], [0.0, 10.0, 0.0], [-1.0, 0.0, 0.5, 2.0, 3.0, 9.0])], "i int, x array<double>, y array<double>, q array<double>")
    got = values(df, sequences.interpolate(F.col("x"), F.col("y"), F.col("q")))[0]
    assert got == pytest.approx(np.interp([-1, 0, 0.5, 2, 3, 9], [0, 1, 3], [0, 10, 0]))


def test_stop_and_yield(spark):
    tracks = {"stop": [5.0] * 3 + [0.1] * 12, "recovers": [5.0] * 3 + [0.1] * 12 + [6.0], "dip": [10.0, 8.0, 3.0, 6.0, 9.0], "falls": [10.0, 8.0, 3.0]}
    df = spark.createDataFrame([(k, v) for k, v in tracks.items()], "i string, x array<double>")
    got = {r.i: (r.s, r.y) for r in df.select("i", sequences.stop_event(F.col("x"), 0.1).alias("s"), sequences.yield_event(F.col("x")).alias("y")).collect()}
    assert got == {"stop": (True, False), "recovers": (False, True), "dip": (False, True), "falls": (False, False)}


def test_digest_splits(spark):
    df = spark.range(300).select(F.concat(F.lit("clip-"), F.col("id").cast("string")).alias("k"))
    for r in df.select("k", hashing.md5_mod(F.col("k"), 1000).alias("m"), hashing.hash_split(F.col("k"), 0.05).alias("s"), hashing.owner(F.col("k"), 7).alias("o"), hashing.swap_parity(F.col("k")).alias("p")).collect():
        m = int(hashlib.md5(r.k.encode()).hexdigest(), 16)
        assert (r.m, r.o) == (m % 1000, m % 7) and r.s == ("val" if m % 1000 < 50 else "train")
        assert r.p == (int(hashlib.sha256(r.k.encode()).hexdigest()[:8], 16) % 2 == 1)


def test_percentile_variants(series):
    s = F.sort_array("x")
    for got, x in zip(values(series, statistics.nearest_rank(s, 0.9)), SERIES):
        assert got == sorted(x)[round(0.9 * (len(x) - 1))]
    for got, x in zip(values(series, statistics.floor_rank(s, 0.9)), SERIES):
        assert got == sorted(x)[int(0.9 * (len(x) - 1))]


def test_quantiser_and_bounds(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-9, 0, 0.5, 1.5, 2.5, 9])], "i int, x double")
    assert values(df, statistics.quantise(F.col("x"), 0.0, 4.0, 5)) == [0, 0, 0, 2, 2, 4]
    assert values(df, statistics.outside_bounds(F.col("x"), 0, 9)) == [False] * 5 + [True]


def test_text_helpers(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("v")).first().v
    assert row(text.normalise, "right‑turn “x”") == 'right-turn "x"'
    assert row(text.beats, "Stop; then go, then wait. Turn ;") == ["Stop", "go", "wait", "Turn"]
    assert row(text.strip_fence, "```json\n{1}\n```") == "{1}" and row(text.strip_fence, " x ") == "x"
    assert row(text.only_integer, "score 7 of") == 7 and row(text.only_integer, "7 of 10") is None
    assert row(lambda c: text.nth_number(c, 2), "at 3.5 and -4") == -4.0
    assert row(text.safe_key, "a b/ü-1") == "a_b_ü_1"
    assert row(lambda c: text.glob(c, "vehicle.*.v?"), "vehicle.ford.v2") and not row(lambda c: text.glob(c, "vehicle.?"), "vehicle.ab")
    assert row(lambda c: text.first_connective(c, ["because", "as"], ["for"]), "wait for it because") == "because"
    assert row(lambda c: text.scene_parts(c)[0], "a_b_12") == "a_b" and row(lambda c: text.scene_parts(c)[1], "a_b_12") == 12
    assert str(row(lambda c: text.log_time(c, F.lit("PST")), "2024-01-01 20:00:00"))[:16] == "2024-01-02 04:00"


def test_rotations(spark):
    half = math.sqrt(0.5)
    q = [F.lit(v) for v in (0.0, 0.0, half, half)]
    one = spark.range(1)
    x, y, z = one.select(*geometry.quaternion_rotate(q, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))).first()
    assert (x, y, z) == pytest.approx((-2, 1, 3))
    back = one.select(*geometry.quaternion_rotate(q, tuple(F.lit(v) for v in (x, y, z)), inverse=True)).first()
    assert tuple(back) == pytest.approx((1, 2, 3))
    mid = one.select(*geometry.slerp([F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)], q, F.lit(0.5))).first()
    assert tuple(mid) == pytest.approx((0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)))


def test_boxes_touch(spark):
    names = ("x", "y", "z", "length", "width", "height", "yaw")
    box = lambda *v: {k: F.lit(float(x)) for k, x in zip(names, v)}
    a = box(0, 0, 0, 4, 2, 2, 0)
    got = spark.range(1).select(*[geometry.boxes_touch(a, b).alias(f"c{i}") for i, b in enumerate([box(3, 0, 0, 4, 2, 2, 0), box(5, 0, 0, 4, 2, 2, 0), box(0, 2.4, 0, 4, 2, 2, math.pi / 2), box(2.4, 1.6, 0, 2, 2, 2, math.pi / 4), box(0, 0, 3, 4, 2, 2, 0), box(3.3, 1.9, 0, 2, 2, 2, math.pi / 4)])]).first()
    assert tuple(got) == (True, False, True, True, False, False)


def test_displacements_and_bicycle(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [3.0, 4.0]], [[0.0, 0.0], [0.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    r = df.select(geometry.mean_displacement(F.col("a"), F.col("b")).alias("m"), geometry.final_displacement(F.col("a"), F.col("b")).alias("f")).first()
    assert (r.m, r.f) == (2.5, 5.0)
    x, y, yaw, v = df.select(*geometry.bicycle_step(*[F.lit(v) for v in (0.0, 0.0, 0.0, 10.0, 0.0, 1.0)], 0.1, 1.0, 1.5)).first()
    assert (x, y, yaw, v) == pytest.approx((1.0, 0.0, 0.0, 10.1))


def test_rewards(spark):
    one = spark.range(1)
    nothing = F.lit(None).cast("double")
    got = one.select(
        rewards.trace_reward(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("both"),
        rewards.trace_reward(F.lit(0.5), nothing, F.lit(1.0)).alias("atomic"),
        rewards.trace_reward(nothing, nothing, F.lit(0.0)).alias("none"),
        rewards.trace_reward(F.lit(0.0), nothing, F.lit(1.0)).alias("floor"),
        rewards.blended(nothing, F.lit(0.6), F.lit(0.5)).alias("prior"),
        rewards.margin_loss(F.lit(0.9), F.lit(0.8), 0.3).alias("loss"),
    ).first()
    assert got.none is None
    assert (got.both, got.atomic, got.floor, got.prior, got.loss) == pytest.approx((0.7, 0.4, 0.0, 0.6, 0.2))
