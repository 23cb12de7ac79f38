from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from trailmark.sources import archives, tables
from trailmark.streaming import events


def test_json_lines_counts_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "x": "a"}\n\n{"k": 2, "x": "b"}\n{"k": 3, "x"\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"k": 4}\nnot json\n')
    rows, bad = tables.json_lines(spark, f"{tmp_path}/*.jsonl*", "k int, x string")
    assert sorted((r.k, r.x or "") for r in rows.collect()) == [(1, "a"), (2, "b"), (4, "")]
    assert sorted(r.value for r in bad.collect()) == ['not json', '{"k": 3, "x"']


def test_json_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "scene_1.json").write_text(json.dumps({"v": 1}, indent=1))
    (tmp_path / "in/scene_2.json").write_text(json.dumps({"v": 2}))
    (tmp_path / "broken.json").write_text('{"v": ')
    assert sorted((r.stem, r.v) for r in tables.json_files(spark, str(tmp_path), "v int").collect()) == [("scene_1", 1), ("scene_2", 2)]
    assert [r.path.rpartition("/")[2] for r in tables.broken_json_files(spark, str(tmp_path)).collect()] == ["broken.json"]


def test_marked_lines(spark):
    lines = spark.createDataFrame([("x MARK {\"a\": 1}",), ("noise",), ("MARK {\"a\": ",), ("t MARK {\"a\": 1}",)], "value string")
    rows, bad = tables.marked_lines(lines, "MARK", "a int")
    assert [r.a for r in rows.collect()] == [1, 1] and bad.first().bad == 1


def test_reports_and_routes(spark, tmp_path):
    (tmp_path / "r.md").write_text("# top\n## One\ntext\n> said a\n> said b\n## Two\n> c\n")
    got = [(r.position, r.title, r["quote"]) for r in tables.quoted_reports(spark, f"{tmp_path}/r.md").orderBy("position").collect()]
    assert got == [(1, "One", "said a\nsaid b"), (2, "Two", "c")]
    (tmp_path / "r.xml").write_text('<routes><route id="7" town="T1"><waypoints><position x="1" y="2" z="3"/><position x="4" y="5" z="6"/></waypoints></route></routes>')
    r = tables.routes(spark, f"{tmp_path}/r.xml").first()
    assert (r.route_id, r.town, [(p.x, p.y) for p in r.waypoints]) == ("7", "T1", [(1.0, 2.0), (4.0, 5.0)])


def test_event_cells(spark):
    cells = [None, "None", "[]", '[{"event_start_timestamp": 5, "coc": "a"}]', "broken"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    assert [len(r.e) for r in df.select("i", tables.events_cell(F.col("cell")).alias("e")).orderBy("i").collect()] == [0, 0, 0, 1, 0]


def test_fallback_and_resume(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/origin")
    assert tables.first_of(spark, f"{tmp_path}/mirror", f"{tmp_path}/origin").count() == 5
    assert tables.parquet(spark, f"{tmp_path}/origin", ["id"]).columns == ["id"]
    assert sorted(r.id for r in tables.remaining(spark.range(5), spark.range(3), ["id"]).collect()) == [3, 4]
    tables.append_json(spark.range(2), f"{tmp_path}/out")
    tables.append_json(spark.range(1), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


def test_tar_shards_round_trip(spark, tmp_path):
    members = [(s, f"clip{i:03d}", e, f"{i}{e}".encode() * 50) for i in range(130) for s in ("train" if i % 4 else "val",) for e in ("mp4", "json")]
    df = spark.createDataFrame(members, "split string, clip string, extension string, data binary").repartition(6)
    manifest = archives.write_tar(df, f"file://{tmp_path}/shards", per_shard=10, cells=4)
    rows = manifest.collect()
    assert sum(r.members for r in rows) == 260 and max(r.clips for r in rows) <= 10
    back = archives.read_tar(spark, f"file://{tmp_path}/shards")
    assert {(r.clip, r.extension, bytes(r.data)) for r in back.collect()} == {(c, e, d) for _, c, e, d in members}
    one = archives.read_tar(spark, f"file://{tmp_path}/shards").where("clip = 'clip007'")
    assert sorted(r.extension for r in one.collect()) == ["json", "mp4"]
    index = archives.clip_index(spark, f"file://{tmp_path}/shards")
    assert index.count() == 130 and index.agg(F.min("members")).first()[0] == 2
    reader = archives.TarReader(f"file://{tmp_path}/shards", True)
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("clip",), "clip007")])) == []
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 2


@pytest.fixture
def feed(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string, user long, v double").select("id", F.to_timestamp("t").alias("ts"), "user", "v")
    df.where("id < 15").coalesce(1).write.parquet(f"{tmp_path}/feed")
    df.where("id >= 12").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    return events.stream(spark, f"{tmp_path}/feed", df.schema, 1), df


def test_stream_equals_batch(feed, spark, tmp_path):
    stream, df = feed
    once = events.once(stream, ["id"], "ts")
    assert events.to_end(once, checkpoint=f"{tmp_path}/c1").count() == 30
    wide = events.to_end(events.tumbling(stream, "ts", "10 minutes", ["user"], "v"), "complete")
    assert wide.agg(F.sum("n")).first()[0] == 33
    assert events.sessions(df, "ts", "3 minutes", ["user"]).count() == 2


def test_state_outlives_batches(feed):
    stream, _ = feed
    got = events.to_end(events.moving_averages(stream, "user", "id", "v", 0.5, 0.0, 0.0, 10.0), "update").collect()
    last = {u: max((r.n, r.ema) for r in got if r.user == u) for u in (0, 1)}
    assert {u: n for u, (n, _) in last.items()} == {0: 17, 1: 16} and all(e <= 10.0 for _, e in last.values())


def test_append_new_is_idempotent(feed, spark, tmp_path):
    stream, _ = feed
    for k in range(2):
        events.append_new(stream, f"{tmp_path}/table", f"{tmp_path}/c{k}", ["id"])
    assert spark.read.parquet(f"{tmp_path}/table").count() == 30


@pytest.fixture
def parts(spark, sf, tmp_path):
    """Events in several part files, the newest first, over more than 60 days."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    old = e.withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.col("ts") - F.expr("interval 200 days"))
    for rows in (e, old):
        rows.repartition(2).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("files", [1, 1000])
def test_streams_read_every_file(spark, parts, monkeypatch, files):
    from trailmark.plans import registry

    monkeypatch.setattr(events.stream, "__defaults__", (files,))
    e = spark.read.parquet(f"{parts}/events.parquet")
    want = e.groupBy("user_id", "event_type").count()
    assert sorted(registry.QUERIES["streamed_once"](spark, parts).collect()) == sorted(want.collect())
    days = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    got = registry.QUERIES["streamed_windows"](spark, parts).select(F.to_date("window_start"), "event_type", "n", F.round("total", 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, days.collect()))


def test_streamed_once_leaves_no_rows_on_the_driver(spark, sf, monkeypatch):
    from trailmark.plans import registry

    monkeypatch.delattr(events, "to_end")
    assert registry.QUERIES["streamed_once"](spark, sf).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_arrow_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from trailmark.session import ARROW_BYTES

    df = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 1000000) as text")
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["id"]) for b in batches), "id long").collect()
    assert len(sizes) > 5 and max(r.id for r in sizes) < 2 * ARROW_BYTES


LOG = """Version: 1
Map: Town04
Date: 07/01/20 10:00:00

Frame 1 at 0 seconds
 Create 25: vehicle.tesla.model3 (1) at (100, -200, 50)
  role_name = hero
  number_of_wheels = 4
 Create 26: walker.pedestrian.0001 (2) at (0, 0, 0)
 Parenting 26 with 25 (parent)
 Positions: 2
  Id: 25 Location: (100.5, -200, 50) Rotation (1, 2, 90)
  Id: 26 Location: (0, 0, 0) Rotation (0, 0, 0)
 Vehicle animations: 1
  Id: 25 Steering: -0.5 Throttle: 0.75 Brake: 0 Handbrake: 0 Gear: 2
 Dynamic actors: 1
  Id: 25 Velocity: (1, 2.5, 0) Angular: (0, 0, 1)
 Current platform time: 12.5

Frame 2 at 0.05 seconds
 Destroy 26
 Collision id 1 between 25 (hero) with 30
 Positions: 1
  Id: 25 Location: (200, -200, 50) Rotation (1, 2, 91)

Frames: 2
Duration: 0.05 seconds
"""


def test_recorder_log(spark, tmp_path):
    from trailmark.sources import recorder

    (tmp_path / "a.log").write_text(LOG)
    logs = recorder.records(spark, str(tmp_path))
    told = recorder.lines(logs).cache()
    head = recorder.simulation(logs).first()
    assert (head.map, head.date, head.total_frames, head.duration) == ("Town04", "07/01/20 10:00:00", 2, 0.05)
    assert [(r.frame, r.elapsed, r.delta, r.platform_time) for r in recorder.frames(told).orderBy("frame").collect()] == [(1, 0.0, 0.0, 12.5), (2, 0.05, 0.05, None)]
    a = {r.actor: r for r in recorder.actors(told).collect()}
    assert (a[25].type_id, a[25].created, a[25].destroyed, a[25].attributes) == ("vehicle.tesla.model3", 1, None, {"role_name": "hero", "number_of_wheels": "4"})
    assert (a[26].destroyed, a[26].parent, a[26].attributes) == (2, 25, {})
    s = {(r.frame, r.actor): r for r in recorder.states(told).collect()}
    assert len(s) == 3 and (s[1, 25].x, s[1, 25].yaw, s[1, 25].steer, s[1, 25].throttle, s[1, 25].gear, s[1, 25].velocity_y) == (1.005, 90.0, -0.5, 0.75, 2.0, 2.5)
    assert (s[2, 25].x, s[2, 25].throttle) == (2.0, None)
    assert [(r.frame, r.actor, r.other) for r in recorder.collisions(told).collect()] == [(2, 25, 30)]


def test_criteria(spark):
    from trailmark.sources import recorder

    df = spark.createDataFrame([(1, {"speed": ("OK", 3.0, 4.0, "x")})], "route int, c map<string, struct<test_status: string, actual_value: double, success_value: double, name: string>>")
    assert [tuple(r) for r in recorder.criteria(df, "c").collect()] == [(1, "speed", "OK", 3.0, 4.0)]
