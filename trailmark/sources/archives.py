"""Tar shards: a data source that walks headers, and a sharded writer.

Members are named ``<clip>.<extension>`` and a clip's members are contiguous.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "shard string, clip string, extension string, offset long, bytes long, data binary, uri string"


def _at(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


#: Bytes of shards that a task reads at most (a longer shard is a task of its own), what
#: opening one counts as, and tasks among which fewer bytes are dealt.
TASK_BYTES, OPEN_BYTES, TASKS = 32 << 20, 64 << 10, 32
#: Members that a task writes, about: small ones cost time rather than bytes.
WRITE_MEMBERS = 20_000


class Shards(InputPartition):
    def __init__(self, uris: list[str]):
        super().__init__(uris)
        self.uris = uris


class TarSource(DataSource):
    """``spark.read.format("tar_shards")``: a row per member. Options: path; data=false
    leaves the contents null. Filters on clip and extension are taken over."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"], self.options.get("data", "true") == "true")


class TarReader(DataSourceReader):
    def __init__(self, path: str, data: bool):
        self.path, self.data = path, data
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("clip", "extension") and isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _at(self.path)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        found = sorted((i.path, i.size + OPEN_BYTES) for i in infos if i.type == fs.FileType.File and i.path.endswith(".tar"))
        scheme = self.path.partition("://")[0] if "://" in self.path else "file"
        share = min(TASK_BYTES, sum(s for _, s in found) // TASKS)
        dealt, held = [], 0
        for name, size in found:
            if not dealt or held + size > share:
                dealt.append([])
                held = 0
            dealt[-1].append(f"{scheme}://{name}")
            held += size
        return [Shards(uris) for uris in dealt]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for uri in partition.uris:
            for row in self._members(uri):
                rows.append(row)
                size += 200 + len(row[5] or b"")
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, uri: str) -> Iterator[tuple]:
        system, path = _at(uri)
        with system.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            for m in tar:  # seeks from header to header
                tar.members.clear()  # else it keeps each header
                clip, _, extension = m.name.rpartition("/")[2].partition(".")
                if not m.isfile() or any(v not in w for v, w in ((clip, self.wanted.get("clip")), (extension, self.wanted.get("extension"))) if w is not None):
                    continue
                yield path.rpartition("/")[2], clip, extension, m.offset, m.size, tar.extractfile(m).read() if self.data else None, uri


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def read_tar(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarSource)
    return spark.read.format("tar_shards").option("data", str(data).lower()).load(path)


def clip_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each clip begins: uri, shard, clip, its first member's offset, members and bytes."""
    return read_tar(spark, path, data=False).groupBy("uri", "shard", "clip").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"))


def opened(uri: str):
    """A seekable file."""
    system, path = _at(uri)
    return system.open_input_file(path)


def clip_members(file, offset: int, members: int) -> Iterator[tuple[str, bytes]]:
    """(extension, data) of a clip's members, which follow each other from offset on."""
    file.seek(offset)
    with tarfile.open(fileobj=file, mode="r:") as tar:  # begins where the file stands
        for _ in range(members):
            m = tar.next()
            yield m.name.rpartition("/")[2].partition(".")[2], tar.extractfile(m).read()


def lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """The members of wanted clips: requests' columns, extension, data. requests has ``clip``
    (and any other columns but uri, offset, members, extension, data); index is
    ``clip_index``, perhaps stored. Requests of clips that aren't there give no row, repeated ones
    a row each time.

    A shard's requests are sorted by offset and read by as many tasks as they are dealt to,
    one seek a clip; nothing else of a shard is read.
    """
    kept = [c for c in requests.columns if c not in ("uri", "offset", "members", "extension", "data")]
    found = requests.select(*kept).join(index.select("clip", "uri", "offset", "members"), "clip")
    placed = found.repartitionByRange("uri", "offset").sortWithinPartitions("uri", "offset")

    def fetch(batches):
        file, name = None, None
        for batch in batches:
            rows, extensions, data, size = [], [], [], 0
            for i, (uri, offset, members) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uri", "offset", "members")))):
                if uri != name:
                    if file:
                        file.close()
                    file, name = opened(uri), uri
                for extension, own in clip_members(file, offset, members):
                    rows.append(i), extensions.append(extension), data.append(own)
                    size += len(own)
                if size > 8 << 20:
                    yield _fetched(batch, kept, rows, extensions, data)
                    rows, extensions, data, size = [], [], [], 0
            if rows:
                yield _fetched(batch, kept, rows, extensions, data)
        if file:
            file.close()

    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in kept)
    return placed.mapInArrow(fetch, f"{kinds}, extension string, data binary")


def _fetched(batch, kept: list[str], rows: list[int], extensions: list[str], data: list[bytes]) -> pa.RecordBatch:
    own = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), pa.array(extensions, pa.string()), pa.array(data, pa.binary())], [*kept, "extension", "data"])


def write_tar(members: DataFrame, path: str, per_shard: int = 50, cells: int = 16) -> DataFrame:
    """Writes (split, clip, extension, data) as shards of per_shard clips, members in
    alphabetical order; returns the manifest (split, shard, clips, members, bytes).

    Clips are numbered within hashed cells of their split, so no task sees them all. The
    manifest is written beside the shards and names the attempt's own files.
    """
    clips = members.select("split", "clip").distinct().withColumn("cell", F.pmod(F.xxhash64("clip"), F.lit(cells)))
    number = F.row_number().over(Window.partitionBy("split", "cell").orderBy("clip")) - 1
    placed = clips.withColumn("part", F.floor(number / per_shard)).select("split", "clip", F.concat_ws("_", "cell", "part").alias("shard"))
    rows = members.join(placed, ["split", "clip"]).select("split", "shard", "clip", "extension", "data")

    def save(batches):
        done, key, out = [], None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["split"], r["shard"]) != key:
                    if out:
                        done.append(_closed(key, out, path))
                    key, out = (r["split"], r["shard"]), [io.BytesIO(), 0, set()]
                    out.append(tarfile.open(fileobj=out[0], mode="w"))
                info = tarfile.TarInfo(f"{r['clip']}.{r['extension']}")
                info.size = len(r["data"] or b"")
                out[3].addfile(info, io.BytesIO(r["data"] or b""))
                out[1] += 1
                out[2].add(r["clip"])
        if out:
            done.append(_closed(key, out, path))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["split", "shard", "clips", "members", "bytes"])

    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // WRITE_MEMBERS))
    dealt = rows.repartition(tasks, "split", "shard").sortWithinPartitions("split", "shard", "clip", "extension")
    manifest = dealt.mapInArrow(save, "split string, shard string, clips long, members long, bytes long")
    manifest.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")
    return members.sparkSession.read.parquet(f"{path.rstrip('/')}/_manifest")


def _closed(key: tuple[str, str], out: list, path: str) -> tuple:
    out[3].close()
    name = f"{key[0]}/shard_{key[1]}-{uuid.uuid4().hex[:12]}.tar"
    system, at = _at(f"{path.rstrip('/')}/{name}")
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(out[0].getvalue())
    return key[0], name, len(out[2]), out[1], out[0].tell()
