from __future__ import annotations

import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from trailmark.sources import archives, versions, zips


@pytest.fixture
def archive(tmp_path):
    path = f"{tmp_path}/big.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(40):
            z.writestr(f"clip{i:02}/video.mp4", os.urandom(100_000))
            z.writestr(f"clip{i:02}/meta.json", f'{{"i": {i}}}')
    return path


def test_only_the_directory_and_wanted_members_are_read(archive):
    opened = []

    class Reader(zips.ZipReader):
        def opened(self, uri):
            opened.append(super().opened(uri))
            return opened[-1]

    reader = Reader(f"file://{archive}", True)
    other = EqualTo(("archive",), "big.zip")
    assert list(reader.pushFilters([StringStartsWith(("member",), "clip17/"), EqualTo(("member",), "clip17/meta.json"), other])) == [other]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["member"], r["data"]) for r in rows] == [("clip17/meta.json", b'{"i": 17}')]
    assert sum(f.bytes_read for f in opened) < 20_000 < os.path.getsize(archive) // 100


def test_members_are_dealt_to_stripes_once(spark, archive, monkeypatch):
    monkeypatch.setattr(zips, "STRIPE", 1 << 20)
    reader = zips.ZipReader(f"file://{archive}", False)
    parts = reader.partitions()
    names = [r["member"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 4 and sorted(names) == sorted(zipfile.ZipFile(archive).namelist())
    got = zips.read_zip(spark, f"file://{archive}").where("member like 'clip0%.json'").orderBy("member").collect()
    assert [r.data for r in got] == [f'{{"i": {i}}}'.encode() for i in range(10)]


def test_broken_members_and_archives_say_so(spark, archive, tmp_path):
    with zipfile.ZipFile(archive) as z:
        at = z.getinfo("clip03/video.mp4").header_offset
    with open(archive, "r+b") as f:
        f.seek(at + 200)
        f.write(b"xxxx")
    (tmp_path / "no.zip").write_bytes(b"not a zip")
    (tmp_path / "empty.zip").write_bytes(b"")
    rows = zips.read_zip(spark, f"file://{tmp_path}").collect()
    broken = {(r.archive, r.member): r.error for r in rows if r.error}
    assert set(broken) == {("big.zip", "clip03/video.mp4"), ("no.zip", None), ("empty.zip", None)}
    assert "CRC" in broken["big.zip", "clip03/video.mp4"] and len(rows) == 82


def test_clips_are_looked_up_by_one_seek_each(spark, tmp_path):
    clips = spark.range(60).select(F.lit("train").alias("split"), F.format_string("clip%03d", "id").alias("clip"), F.explode(F.array(F.lit("json"), F.lit("mp4"))).alias("extension"))
    members = clips.withColumn("data", F.when(F.col("extension") == "mp4", F.repeat(F.col("clip"), F.lit(5000))).otherwise(F.col("clip")).cast("binary"))
    archives.write_tar(members, f"file://{tmp_path}/shards", per_shard=30, cells=2)
    index = archives.clip_index(spark, f"file://{tmp_path}/shards")
    wanted = spark.createDataFrame([("clip007", 1, None), ("clip007", 2, "x"), ("clip059", 3, "y"), ("none", 4, "z")], "clip string, n int, shard string")
    got = archives.lookup(wanted, index)
    assert got.columns == ["clip", "n", "shard", "extension", "data"]
    rows = sorted((r.n, r.extension, bytes(r.data)) for r in got.collect())
    assert rows == [(n, e, (c * 5000 if e == "mp4" else c).encode()) for n, c in ((1, "clip007"), (2, "clip007"), (3, "clip059")) for e in ("json", "mp4")]
    assert archives.lookup(wanted.where("n > 9"), index).count() == 0

    class Counted:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def read(self, n):
            out = self.file.read(n)
            self.read_bytes += len(out)
            return out

        def seek(self, *a):
            return self.file.seek(*a)

        def tell(self):
            return self.file.tell()

    where = index.where("clip = 'clip059'").first()
    file = Counted(archives.opened(where.uri))
    found = dict(archives.clip_members(file, where.offset, where.members))
    assert found == {"json": b"clip059", "mp4": b"clip059" * 5000} and file.read_bytes < 40_000


def test_a_versioned_table_is_old_or_new(spark, tmp_path):
    path = f"file://{tmp_path}/manifest"
    old = spark.range(10).select("id", F.lit("old").alias("v"))
    versions.overwrite(old, path)
    before = versions.read(spark, path)

    def fail(batches):
        for b in batches:
            yield b
            raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        versions.overwrite(spark.range(1000).select("id", F.lit("bad").alias("v")).repartition(3).mapInArrow(fail, "id long, v string"), path)
    assert {r.v for r in versions.read(spark, path).collect()} == {"old"}
    versions.overwrite(spark.range(5).select("id", F.lit("new").alias("v")).repartition(4), path)
    assert sorted(r.id for r in versions.read(spark, path).collect()) == list(range(5))
    assert before.count() in (5, 10)  # whole, whichever version it was planned on
    assert versions.sweep(path) >= 1 and versions.read(spark, path).count() == 5
    versions.overwrite(spark.range(0).select("id", F.lit("none").alias("v")), path)
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path).columns == ["id", "v"]
    with pytest.raises(Exception, match="overwritten"):
        spark.range(1).write.format("versioned").mode("append").save(path)


def test_files_of_repeated_attempts_are_in_no_list(tmp_path):
    schema = pa.schema([("id", pa.int64())])
    writer = versions.VersionWriter(f"file://{tmp_path}/t", schema)
    batch = pa.record_batch([pa.array([1, 2])], schema=schema)
    writer.write(iter([batch]))  # an attempt whose message is lost
    writer.commit([writer.write(iter([batch])), writer.write(iter([])), None])
    reader = versions.VersionReader(f"file://{tmp_path}/t")
    rows = [r["id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows == [1, 2]
    stopped = versions.VersionWriter(f"file://{tmp_path}/t", schema)
    stopped.write(iter([batch]))
    stopped.abort([])
    assert len(versions.VersionReader(f"file://{tmp_path}/t").partitions()) == 1
