from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from trailmark.functions.geometry import boxes_touch
from trailmark.operators import boxes, sampling

FIELDS = boxes.FIELDS


def test_touching_equals_all_pairs(spark):
    """Sizes from a tenth of a cell to many cells, edges on cell borders, copies."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        size = rng.choice([0.4, 2.0, 4.0, 30.0, 150.0])
        rows.append((i % 3, i, rng.choice([rng.uniform(-60, 60), 8.0 * rng.randrange(-8, 8)]), rng.uniform(-60, 60), rng.uniform(0, 2), size, rng.uniform(0.2, 1) * size, 1.5, rng.choice([0.0, math.pi / 2, rng.uniform(-4, 4)])))
    rows += [(0, 900 + k, 4.0 * k, 0.0, 0.0, 4.0, 4.0, 1.0, 0.0) for k in range(4)] + [(0, 950, 4.0, 0.0, 0.0, 4.0, 4.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "scene int, box int, " + ", ".join(f"{c} double" for c in FIELDS)).repartition(4)
    a, b = (df.select("scene", F.col("box").alias(f"box_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in FIELDS]) for s in "ab")
    plain = a.join(b, "scene").where("box_a < box_b").where(boxes_touch(*[{c: F.col(f"{c}_{s}") for c in FIELDS} for s in "ab"]))
    want = sorted(tuple(r) for r in plain.select("scene", "box_a", "box_b").collect())
    for cell in (0.5, 4.0, 1000.0):
        assert sorted(tuple(r) for r in boxes.touching(df, ["scene"], "box", cell).collect()) == want
    assert (0, 900, 901) in want and (0, 901, 950) in want and (0, 900, 902) not in want


def test_boxes_without_a_place(spark):
    good = (0, 1, 0.0, 0.0, 0.0, 2.0, 2.0, 1.0, 0.0)
    bad = [(0, 2, None, *good[3:]), (0, 3, float("nan"), *good[3:]), (0, 4, 0.0, 0.0, 0.0, float("inf"), 2.0, 1.0, 0.0)]
    df = spark.createDataFrame([good, *bad], "scene int, box int, " + ", ".join(f"{c} double" for c in FIELDS))
    assert boxes.touching(df, ["scene"], "box").count() == 0 and boxes.touching(df.limit(0), ["scene"], "box").count() == 0


def test_redraw(spark):
    rows = [(k, i) for i, k in enumerate(["a"] * 300 + ["b"] * 40 + [None] * 50 + ["c"] * 3)]
    df = spark.createDataFrame(rows, "s string, k int").repartition(3)
    asked = []

    def accept(c):
        asked.append({r.k for r in c.collect()})
        return c.where("k % 7 = 0 and coalesce(s, '') <> 'c'")

    out = sampling.redrawn(df, ["s"], "k", 8, accept)
    got = out.orderBy("s", "rank").collect()
    place = {r.k: r.o for r in df.select("k", sampling.sample_order(F.col("k"), "redraw").alias("o")).collect()}
    for s in ("a", "b", None, "c"):
        fits = sorted((k for t, k in rows if t == s and k % 7 == 0 and s != "c"), key=lambda k: place[k])[:8]
        assert [(r.k, r["rank"]) for r in got if r.s == s] == [(k, i + 1) for i, k in enumerate(fits)]
    assert len(asked) > 2 and sum(map(len, asked)) == len(set().union(*asked)) < len(rows)  # none twice, not all
    short = {r.s: (r.drawn, r.short) for r in sampling.unmet(df, out, ["s"], 8).collect()}
    assert short["c"] == (0, 8) and "a" not in short
    assert sampling.redrawn(df.limit(0), ["s"], "k", 8, lambda c: c).count() == 0


def test_axes_are_not_worked_out_pair_by_pair(spark):
    df = spark.createDataFrame([(0, k, 1.0 * k, 0.0, 0.0, 2.0, 2.0, 1.0, 0.3) for k in range(4)], "scene int, box int, " + ", ".join(f"{c} double" for c in FIELDS))
    out = boxes.touching(df, ["scene"], "box")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join Inner, " in line and "_small" in line)
    assert "COS(" not in joined and out.count() == 5


def crowd(spark, n):
    """Boxes of three sizes at one place, in two scenes and one unknown, keys as text."""
    rng = random.Random(5)
    rows = [(rng.choice(["s", "t", None]), k % 2, f"k{k % (n - 5):03}", rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(0, 2), *rng.choice([(2.0, 1.0), (6.0, 2.0), (20.0, 3.0)]), 1.5, rng.uniform(-4, 4)) for k in range(n)]
    return spark.createDataFrame(rows, "scene string, half int, box string, " + ", ".join(f"{c} double" for c in FIELDS))


def test_blocks_of_crowded_cells_hold_every_pair(spark):
    df, group = crowd(spark, 150), ["scene", "half"]
    a, b = (df.select(*group, F.col("box").alias(f"box_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in FIELDS]) for s in "ab")
    plain = a.join(b, group).where("box_a < box_b").where(boxes_touch(*[{c: F.col(f"{c}_{s}") for c in FIELDS} for s in "ab"]))
    want = sorted(map(tuple, plain.select(*group, "box_a", "box_b").collect()))
    for rows in (3, 20, 1000):
        assert sorted(map(tuple, boxes.touching(df, group, "box", rows=rows).collect())) == want
    assert len(want) > 200


def test_a_key_does_not_touch_itself(spark):
    rows = [(0, 7, 0.0, 0.0, 0.0, 2.0, 2.0, 1.0, 0.0), (0, 7, 0.0, 0.0, 0.0, 9.0, 9.0, 1.0, 0.0), (0, 8, 1.0, 0.0, 0.0, 2.0, 2.0, 1.0, 0.0)]
    out = boxes.touching(spark.createDataFrame(rows, "scene int, box int, " + ", ".join(f"{c} double" for c in FIELDS)), ["scene"], "box")
    assert sorted(map(tuple, out.collect())) == [(0, 7, 8), (0, 7, 8)]


def test_cells_are_joined_and_not_boxes(spark):
    rows = [(0, k, 0.01 * k, 0.0, 0.0, 2.0, 2.0, 1.0, 0.3) for k in range(60)]
    out = boxes.touching(spark.createDataFrame(rows, "scene int, box int, " + ", ".join(f"{c} double" for c in FIELDS)), ["scene"], "box")
    assert out.count() == 60 * 59 // 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") >= 2
