"""Steps whose tasks or files would grow with the input: medoids, tracks, logs, shards, routes."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from trailmark.operators import aggregates, joins, perception
from trailmark.plans import registry
from trailmark.sources import archives, recorder, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medoids_make_no_pairs(spark, sf):
    rows = [("a", 1, 5.0), ("a", 2, 6.0), ("a", 2, 8.0), ("a", 3, 20.0), ("a", None, 1.0), ("tie", 4, 1.0), ("tie", 3, 2.0), ("lone", 1, 1.0), ("lone", 1, 2.0), (None, 1, 1.0), (None, 2, 2.0), ("hole", 1, 3.0), ("hole", 2, None), ("hole", 3, 4.0)]
    df = spark.createDataFrame(rows, "g string, m int, v double")
    pairs = joins.pairs_within(df, ["g"], "m", ["v"]).withColumn("d", F.abs(F.col("v_a") - F.col("v_b")))
    by_pairs = sorted(map(tuple, aggregates.medoid(pairs, ["g"], "m_a", "m_b", "d").collect()))
    own = aggregates.medoid_within(df, ["g"], "m", "v", lambda a, b: F.abs(a - b))
    assert sorted(map(tuple, own.collect())) == by_pairs and [r[0] for r in by_pairs] == ["a", "hole", "tie"]
    assert by_pairs[0][1:] == (1, 19 / 3) and by_pairs[2][1:] == (3, 1.0)
    assert "Join" not in _plan(registry.QUERIES["medoids"](spark, sf))


def test_lenient_tracks_shuffle_rows_once(spark):
    rows = [("a", "1", "bus"), ("a", "1", "bus"), ("a", "2", "bus"), ("a", "2", "person"), ("a", "3", "ghost"), ("a", "4", None), ("b", "1", "ghost"), ("b", "1", "rider")]
    left = perception.load_tracks(spark.createDataFrame(rows, "clip string, track_id string, label_class string"), "clip")
    assert "Join" not in _plan(left) and _plan(left).count("Exchange") == 1
    assert sorted(map(tuple, left.collect())) == [("a", "1", "bus"), ("a", "1", "bus"), ("b", "1", "rider")]


def test_log_lines_are_not_shuffled(spark, tmp_path):
    text = "header\nFrame 7 at 0.5 seconds\n Create 3: x (1) at (1, 2, 3)\n  role_name = hero\n \n\n  color = 1\n Positions: 1\n  Id: 3\n\nFrame 8 at 1 seconds\n"
    (tmp_path / "a.log").write_text(text)
    told = recorder.lines(recorder.records(spark, str(tmp_path)))
    opener = "Create 3: x (1) at (1, 2, 3)"
    want = [(0, "7 at 0.5 seconds", None), (1, f" {opener}", opener), (2, "  role_name = hero", opener), (3, " ", opener), (4, "", opener), (5, "  color = 1", opener), (6, " Positions: 1", "Positions: 1"), (7, "  Id: 3", "Positions: 1"), (8, "", "Positions: 1"), (9, "", "Positions: 1")]
    assert [(r.place, r.line, r.section) for r in told.where("frame = 7").orderBy("place").collect()] == want
    assert "Exchange" not in _plan(told) and told.where("frame = 8").count() == 2
    assert [(r.actor, r.attributes) for r in recorder.actors(told).collect()] == [(3, {"role_name": "hero", "color": "1"})]


def test_tasks_read_many_shards(spark, tmp_path):
    members = spark.range(900).select(F.lit("train").alias("split"), F.format_string("clip%03d", "id").alias("clip"), F.lit("txt").alias("extension"), F.col("id").cast("string").cast("binary").alias("data"))
    archives.write_tar(members, f"file://{tmp_path}/shards", per_shard=5, cells=4)
    files = len(glob.glob(f"{tmp_path}/shards/train/*.tar"))
    reader = archives.TarReader(f"file://{tmp_path}/shards", True)
    dealt = reader.partitions()
    assert files >= 180 and len(dealt) <= 2 * archives.TASKS and sum(len(p.uris) for p in dealt) == len({u for p in dealt for u in p.uris}) == files
    assert sorted(int(bytes(r.data)) for r in archives.read_tar(spark, f"file://{tmp_path}/shards").collect()) == list(range(900))
    (tmp_path / "none").mkdir()
    assert archives.TarReader(f"file://{tmp_path}/none", True).partitions() == []


def test_route_files_are_bounded(spark, tmp_path, monkeypatch):
    """The writer of xml_route_scan bounds a file's routes, since one task reads a file."""
    rows = spark.range(120_001).select(F.col("id").alias("l_orderkey"), F.lit(1.0).alias("l_quantity"), F.lit(0.01).alias("l_tax")).coalesce(1)
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    read = []
    routes = tables.routes
    monkeypatch.setattr(tables, "routes", lambda session, path: read.append(path) or routes(session, path))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert registry.QUERIES["xml_route_scan"](spark, str(tmp_path)).count() == 120_001
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = [r.n for r in spark.read.text(read[0]).where("trim(value) like '<route %'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sorted(files) == [20_001, 50_000, 50_000]
