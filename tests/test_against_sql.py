"""Queries against their SQL on small tables made for one hard case each."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from trailmark.plans import registry


def rows_of(spark, folder, name, **tables):
    """The query's rows and those of its SQL over the tables, both sorted."""
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register("_frame", frame)
        con.execute(f"COPY _frame TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    names = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {names} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("name", ["manoeuvre_labels", "label_report"])
def test_a_turn_of_just_45_degrees(spark, tmp_path, name):
    # (atan 1.875 - 2 atan 4 - atan 1) / 3 is -45 degrees but for how steps are added up
    steps = [(1, 17101, 2.0, 0.0), (2, 18163, 15.0, 0.04), (3, 8775, 45.0, 0.04), (4, 3821, 15.0, 0.03), (6, 3149, 15.0, 0.02), (7, 6455, 16.0, 0.08), (7, 12933, 32.0, 0.08)]
    items = pd.DataFrame([(16376, *s) for s in steps], columns=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"])
    got, want = rows_of(spark, tmp_path, name, lineitem=items)
    assert got == want


@pytest.mark.parametrize("name", ["manoeuvre_labels", "label_report", "commitment_verdicts"])
def test_turns_of_45_degrees_but_for_the_last_place_of_an_angle(spark, tmp_path, name):
    tracks = {
        131: [(25, 0.08), (12, 0.1), (48, 0.04), (40, 0.0), (23, 0.0)],
        148: [(1, 0.02), (33, 0.0), (27, 0.01), (42, 0.04), (19, 0.04)],
        266: [(6, 0.09), (21, 0.08), (3, 0.01), (28, 0.1), (42, 0.08)],
    }
    rows = [(order, i, i, float(quantity), discount) for order, track in tracks.items() for i, (quantity, discount) in enumerate(track, 1)]
    got, want = rows_of(spark, tmp_path, name, lineitem=pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"]))
    assert got == want


def test_angles_of_arrays(spark):
    from trailmark.functions import sequences

    rows = [([1.0, -1.0, 0.0], [1.0, 0.0, -2.0]), (None, None), ([], []), ([-0.0, None], [-1.0, 1.0])]
    got = spark.createDataFrame(rows, "y array<double>, x array<double>").coalesce(1).select(sequences.angles("y", "x")).collect()
    assert [r[0] for r in got] == [[math.pi / 4, -math.pi / 2, math.pi], None, [], [-math.pi, None]]


def scenes(clean, changed):
    """lineitem of scenes of one cluster: (flag, quantity) of each, by scene."""
    rows = [(8 * k, i, 4 * i, flag, float(v)) for k, (a, b) in enumerate(zip(clean, changed)) for i, (flag, v) in enumerate([*(("N", v) for v in a), *(("R", v) for v in b)])]
    return pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity"])


@pytest.mark.parametrize("name", ["mined_pairs", "ranked_pairs"])
@pytest.mark.parametrize(("clean", "changed"), [([0, 1, 20], [27, 27, 27, 27, 26]), ([0, 2, 31], [42, 42, 42, 41, 41]), ([0, 7, 20], [28, 28, 28, 27, 27])])
def test_distances_that_just_equal_a_floor(spark, tmp_path, name, clean, changed):
    got, want = rows_of(spark, tmp_path, name, lineitem=scenes([clean] * 3, [changed] * 3))
    assert got == want


@pytest.mark.parametrize("values", [[30.0, 48.0, 1.0, 2.0, 3.0], [14.0, 17.0, 2.0], [9.0, 13.0], [18.0, 28.0, 0.0, 1.0, 2.0], [5.0]])
def test_floors_are_those_of_sql(spark, values):
    from trailmark.functions.statistics import quantile
    from pyspark.sql import functions as F

    want = duckdb.execute("SELECT quantile_cont(x, 0.9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchone()[0]
    got = spark.createDataFrame([(values,)], "v array<double>").select(quantile(F.sort_array("v"), 0.9)).first()[0]
    assert got == want


def test_similarities_equal_those_of_all_pairs(spark, sf):
    from pyspark.sql import functions as F

    from trailmark.operators import joins, rewards

    vectors = [[1.0, 2.0, 2.0], [0.0, 0.0, 0.0], None, [1.0, None, 3.0], [3.0], [], [-1.0, 0.5, 0.25], [0.1, 0.7, 1e-3]]
    left = spark.createDataFrame(list(enumerate(vectors * 3)), "id int, v array<float>")
    right = left.select(F.col("id").cast("string").alias("of"), F.col("v").alias("w"))
    plain = joins.all_pairs(left, right).select("id", "of", rewards.cosine(F.col("v"), F.col("w")).alias("similarity"))
    got = joins.similarities(left, right, "v", "w", rows=5)
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    plan = registry.QUERIES["search_similarities"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan  # no vector is gone through pair by pair


def test_boxes_that_share_a_key(spark, tmp_path):
    rng = np.random.default_rng(11)
    n = 500
    items = pd.DataFrame({"l_orderkey": rng.integers(0, 30, n), "l_linenumber": rng.integers(1, 5, n), "l_partkey": rng.integers(0, 7, n), "l_suppkey": rng.integers(0, 2, n) * 20 + rng.integers(0, 2, n)})
    items = items.assign(l_extendedprice=rng.integers(0, 800, n) / 100, l_quantity=rng.integers(1, 51, n) * 1.0, l_discount=rng.integers(0, 11, n) / 100, l_returnflag=rng.choice(["R", "R", "N"], n))
    items = pd.concat([items, items[:20]])  # whole rows twice
    got, want = rows_of(spark, tmp_path, "touching_boxes", lineitem=items)
    assert got == want and len(want) > 400


def test_similarities_copy_no_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trailmark.operators import joins

    monkeypatch.setattr(joins, "PAIRS", 50, raising=False)
    left = spark.range(60).select("id", F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    right = spark.range(30).select(F.col("id").cast("string").alias("of"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("w")).repartition(3)
    got = joins.similarities(left, right, "v", "w", rows=7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan
    assert got.rdd.getNumPartitions() == 36
    assert got.count() == got.select("id", "of").distinct().count() == 60 * 30
    assert joins.similarities(left, right.limit(0), "v", "w").count() == joins.similarities(left.limit(0), right, "v", "w").count() == 0
