"""Mining ranks, seeded and expiring stream state, pickled buckets, Parquet in bytes."""

from __future__ import annotations

import collections
import datetime
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import mining
from trailmark.sources import pickles, tables
from trailmark.streaming import events as streams


def clamped(values, n=0, ema=0.6):
    for v in values:
        ema = min(0.8, max(0.35, ema * 0.98 + v * 0.02))
        n += 1
    return n, pytest.approx(ema)


def test_cross_distances_equal_all_pairs(spark):
    rng = random.Random(5)
    clean = [(rng.choice("ab"), float(rng.randint(0, 9))) for _ in range(60)]
    changed = [(rng.choice("abz"), rng.choice(["p", "q"]), float(rng.randint(0, 9))) for _ in range(80)]
    want = {}
    for s in "ab":
        for c in "pq":
            d = [abs(v - w) for t, v in clean if t == s for u, k, w in changed if u == s and k == c]
            want[s, c] = pytest.approx(sum(d) / len(d))
    got = mining.cross_distances(spark.createDataFrame([*clean, ("a", None)], "s string, v double"), spark.createDataFrame(changed, "s string, c string, v double"), "s", "c", "v")
    assert {(r.s, r.c): r.cross for r in got.collect()} == want  # z has no clean samples


def test_ranks_of_a_hot_cluster_are_those_of_a_window(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i % 90, "hot" if i % 3 else str(i % 7), str(i), None if i % 11 == 0 else float(rng.randint(-3, 3)), float(rng.randint(0, 4))) for i in range(600)]
    spark.createDataFrame(rows, "scene int, cluster string, condition string, z double, cross double").write.parquet(str(tmp_path / "pairs"))
    got = mining.ranked(spark.read.parquet(str(tmp_path / "pairs")), "scene", "cluster", "condition", rows=50).collect()
    order = sorted(rows, key=lambda r: (-(r[3] or 0.0), -r[4], r[0], r[2]))
    seen, want = collections.Counter(), {}
    for scene, cluster, condition, *_ in order:
        seen["c", cluster] += 1
        seen["s", scene] += 1
        want[condition] = (seen["s", scene], seen["c", cluster])
    assert {r.condition: (r.rank_within_scene, r.rank_within_cluster) for r in got} == want
    assert len(got) == 600


def as_stream(spark, folder, batches, schema):
    """Each list of rows a file, and a micro-batch of its own, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*.parquet"):
            if not f.name.startswith("part-x"):
                f.rename(folder / f"part-x{i}.parquet")
                os.utime(folder / f"part-x{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return streams.stream(spark, str(folder), spark.read.parquet(str(folder)).schema, files_per_trigger=1)


def test_averages_resume_from_a_table(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), i, rng.random()) for i in range(120)]
    early, late = rows[:50], [rows[50:80], rows[80:90], rows[90:]]
    values = {k: [v for u, _, v in rows if u == k] for k in "abc"}
    seed = [(k, *clamped([v for u, _, v in early if u == k])) for k in "ab"]
    seed = spark.createDataFrame([(k, n, e.expected) for k, n, e in seed] + [("idle", 3, 0.7)], "k string, n long, ema double")
    values["c"] = [v for u, i, v in rows if u == "c" and i >= 50]  # not in the seed
    df = as_stream(spark, tmp_path / "in", [[*b, ("a", 10_000 + i, None)] for i, b in enumerate(late)], "k string, i long, v double")
    out = streams.to_table(streams.seeded_averages(df, "k", "i", "v", 0.02, 0.6, 0.35, 0.8, seed=seed), str(tmp_path / "out"), str(tmp_path / "state"), "update").collect()
    last = {r.k: r for r in sorted(out, key=lambda r: r.n)}
    assert {k: (r.n, r.ema) for k, r in last.items()} == {k: clamped(values[k]) for k in "abc"}
    assert not any(r.expired for r in out) and sum(r.k == "a" for r in out) == 3


def test_idle_state_expires(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    batches = [[("a", 1, 0.9, at(0)), ("b", 2, 0.9, at(1))], [("b", 3, 0.9, at(50))], [("b", 4, 0.9, at(100))], [("a", 5, 0.9, at(101)), ("b", 6, 0.9, at(101))]]
    df = as_stream(spark, tmp_path / "in", batches, "k string, i long, v double, t timestamp")
    averages = streams.seeded_averages(df, "k", "i", "v", 0.02, 0.6, 0.35, 0.8, time="t", idle_seconds=3600, late="1 minute")
    out = streams.to_table(averages, str(tmp_path / "out"), str(tmp_path / "state"), "update").collect()
    assert [(r.n, r.ema) for r in out if r.k == "a" and r.expired] == [clamped([0.9])]
    assert [(r.n, r.ema) for r in out if r.k == "a" and not r.expired] == [clamped([0.9])] * 2  # begins again
    assert sorted(r.n for r in out if r.k == "b") == [1, 2, 3, 4]


def test_buckets_go_round(spark, tmp_path):
    rows = [(f"b{i % 3}", None if i == 5 else f"m{i}") for i in range(100)] + [("b0", "m0")]
    pickles.write_buckets(spark.createDataFrame(rows, "bucket string, member string").repartition(3), str(tmp_path / "o"), "bucket", "member", rows=10)
    assert sorted(map(str, pickles.read_buckets(spark, str(tmp_path / "o")).collect())) == sorted(map(str, spark.createDataFrame(rows, "bucket string, member string").collect()))
    files = list((tmp_path / "o").glob("*.pkl"))
    assert len(files) > 9 and not list((tmp_path / "o").glob("_*"))
    assert all(sum(map(len, pickle.loads(f.read_bytes()).values())) <= 10 for f in files)


@pytest.mark.parametrize("protocol", range(6))
def test_plain_values_are_read_as_pickle_reads_them(protocol):
    shared = ["x", "y"]
    value = {"a": shared, "b": shared, "c": (), "d": (1,), "e": (1, 2, 3, 4), "f": [None, True, False, -7, 2**80, 1.5, "ä" * 300], "g": {"h": [[]]}}
    assert pickles.plain(pickle.dumps(value, protocol)) == value
    assert pickles.plain(pickle.dumps({"a": "x"}, protocol)) == {"a": "x"}


class Calls:
    def __reduce__(self):
        return (os.mkdir, ("/tmp/trailmark-should-not-exist",))


@pytest.mark.parametrize("data", [pickle.dumps({"a": [Calls()]}, p) for p in (0, 2, 4)] + [pickle.dumps(collections.OrderedDict(a=1)), b"", b"N", b"garbage", b"0.", b"]a.", b"(.", b"](a.", b"NN.", pickle.dumps([1])[:-1]])
def test_anything_else_is_refused(data):
    with pytest.raises(pickles.Refused):
        pickles.plain(data)
    assert not os.path.exists("/tmp/trailmark-should-not-exist")


def test_parquet_in_bytes_and_defaults(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"t{i}", float(i)) for i in range(50)]
    spark.createDataFrame(rows, "id long, t string, extra double").repartition(3).write.parquet(str(tmp_path / "p"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "p")).select("content").unionByName(spark.createDataFrame([(None,)], "content binary"))
    got = tables.parquet_in_bytes(files, "content", "t string, id long", rows=4)
    assert sorted((r.id, r.t) for r in got.collect()) == [(i, t) for i, t, _ in rows]
    out = tables.projected(got, {"id": None, "t": "none", "lost": 0, "gone": None}).orderBy("id").first()
    assert (out.id, out.t, out.lost, out.gone) == (0, "none", 0, None)
