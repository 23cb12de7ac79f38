"""Running values and frames of groups that are dealt over many tasks equal plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import aggregates, joins, scans

ORDER = ["t", "j"]


def order():
    return [F.col(c).asc() for c in ORDER]


@pytest.fixture(scope="module")
def series(spark):
    """A key of half the rows, one null key, ties in t and null values."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(40), j, None if rng.random() < 0.2 else rng.randrange(-50, 50)) for j, k in enumerate([1] * 600 + [None] * 300 + [2] * 90 + [3])]
    return spark.createDataFrame(rows, "k int, t int, j int, v long").repartition(5)


def every():
    return {
        "sum": scans.total(F.col("v")),
        "i": scans.place(),
        "known": scans.last(F.col("v")),
        "opened": scans.first(F.col("v")),
        "high": scans.most(F.col("v")),
        "low": scans.least(F.col("v")),
        "prev": scans.previous(F.col("v")),
        "next": scans.following(F.col("v")),
    }


def test_ranges_give_what_plain_windows_give(series):
    whole = {"n": F.count(F.lit(1)), "top": F.max("v")}
    want = {tuple(r) for r in scans.running(series, ["k"], order(), every(), whole).collect()}
    got = scans.running(series, ["k"], order(), every(), whole, rows=50)
    assert got.columns == [*series.columns, *every(), *whole]
    rows = got.collect()
    assert len(rows) == 991 and {tuple(r) for r in rows} == want
    down = [F.col("t").desc(), F.col("j").desc()]
    a, b = (scans.running(series, ["k"], down, every(), rows=n).collect() for n in (10, 10_000))
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


def test_against_a_loop(series):
    got = scans.running(series, ["k"], order(), every(), rows=50).where("k = 1").orderBy(*ORDER).collect()
    total = known = None
    for i, r in enumerate(got):
        total = total if r["v"] is None else (total or 0) + r["v"]
        known = known if r["v"] is None else r["v"]
        assert (r["i"], r["sum"], r["known"]) == (i, total, known)
        assert (r["prev"] and r["prev"]["v"]) == (got[i - 1]["v"] if i else None) and (r["prev"] is None) == (i == 0)
        assert (r["next"] is None) == (i == len(got) - 1)


def test_a_hot_key_is_many_tasks(series, tmp_path):
    out = scans.running(series, ["k"], order(), {"i": scans.place()}, rows=50)
    ranges = [f for f in out.inputFiles() if "ranges" in f]
    assert len(ranges) >= 15  # 900 rows of two hot keys, 50 a range
    sizes = [n for (n,) in out.sparkSession.read.parquet(*ranges).groupBy("_cell").count().select("count").collect()]
    assert max(sizes) < 3 * 50


def test_one_tie_and_empty_tables(spark, series):
    tied = series.withColumn("t", F.lit(1)).withColumn("j", F.lit(1))
    assert sorted(r["i"] for r in scans.running(tied, ["k"], order(), {"i": scans.place()}, rows=50).where("k = 2").collect()) == list(range(90))
    assert scans.running(series.limit(0), ["k"], order(), every(), rows=5).count() == 0


def test_frames(series):
    placed = scans.running(series, ["k"], order(), {"i": scans.place()})
    columns = {"least": lambda w: F.min("v").over(w.rowsBetween(-2, 3)), "back": lambda w: F.lag("v", 2).over(w), "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-2, 3))}
    plain = Window.partitionBy("k").orderBy("i")
    want = {tuple(r) for r in placed.select("*", *[make(plain).alias(n) for n, make in columns.items()]).collect()}
    for length in (3, 7, 100_000):
        rows = scans.framed(placed, ["k"], "i", 2, 3, columns, length).collect()
        assert len(rows) == 991 and {tuple(r) for r in rows} == want
    with pytest.raises(ValueError):
        scans.framed(placed, ["k"], "i", 2, 3, columns, 2)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_of_a_hot_key(series, direction):
    left, right = series.where("j % 3 = 0").select("k", "t", "j"), series.where("j % 3 > 0").select("k", "t", F.col("j").alias("r"), "v")
    a, b = (joins.asof(left, right, ["k"], "t", ["r", "v"], direction, tie="r", rows=n).collect() for n in (40, 1_000_000))
    assert len(a) == left.count() and {tuple(r) for r in a} == {tuple(r) for r in b}
    known = [tuple(r) for r in right.where("k = 1").select("t", "r").collect()]
    for r in a:
        if r["k"] == 1:
            fits = [x for x in known if (x[0] <= r["t"] if direction == "backward" else x[0] >= r["t"])]
            best = max(fits, default=(None, None)) if direction == "backward" else min(fits, key=lambda x: (x[0], -x[1]), default=(None, None))
            assert r["matched_t"] == best[0]


def test_nearest_of_a_hot_key(series):
    left, right = series.where("j % 3 = 0").select("k", "t", "j"), series.where("j % 9 = 1").dropDuplicates(["k", "t"]).select("k", "t", F.col("j").alias("r"))
    right = right.persist()  # which of equal rows stays isn't defined
    a, b = (joins.nearest(left, right, ["k"], "t", "r", rows=n).collect() for n in (40, 1_000_000))
    assert {tuple(r) for r in a} == {tuple(r) for r in b}
    right.unpersist()


@pytest.mark.parametrize("kind", ["linear", "nearest", "floor"])
def test_percentiles_of_hot_groups(series, kind):
    import numpy as np

    shares = {"low": 0.0, "mid": 0.5, "p90": 0.9, "top": 1.0}
    got = {r["k"]: r for r in aggregates.percentiles(series, ["k"], "v", shares, kind, rows=40).collect()}
    values: dict = {}
    for r in series.collect():
        values.setdefault(r["k"], []).extend([] if r["v"] is None else [r["v"]])
    assert set(got) == set(values)
    for k, v in values.items():
        for name, share in shares.items():
            want = None
            if v:
                at = share * (len(v) - 1)
                want = float(np.percentile(v, share * 100)) if kind == "linear" else sorted(v)[round(at) if kind == "nearest" else int(at)]
            assert got[k][name] == (want if want is None else pytest.approx(want))
