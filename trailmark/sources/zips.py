"""Members of zip archives, read by ranges.

A task reads an archive's central directory and then only the members it wants, each at its
own offset, so an archive of any size is never read whole.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

SCHEMA = "archive string, member string, bytes long, data binary, error string"
#: Bytes of an archive whose members one task reads.
STRIPE = 64 << 20


def _at(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Ranged:
    """A seekable file that counts the bytes read of it."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0

    def read(self, n: int = -1) -> bytes:
        out = self.file.read(None if n is None or n < 0 else n)
        self.bytes_read += len(out)
        return out

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            self.file.seek(offset, whence)
        except pa.ArrowInvalid as fault:  # before the file's start
            raise OSError(str(fault)) from fault
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True


class Stripe(InputPartition):
    """Members that begin in [start, end) of an archive."""

    def __init__(self, uri: str, start: int, end: int):
        super().__init__((uri, start))
        self.uri, self.start, self.end = uri, start, end


class ZipSource(DataSource):
    """``spark.read.format("zip_members")``: a row per member. Options: path (an archive or
    a folder of them); data=false leaves the contents null. Filters on member (equal, in, starts
    with) are taken over: other members aren't read. A member that can't be unpacked has null
    data and says why in error; an archive without a readable directory is one such row."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], self.options.get("data", "true") == "true")


class ZipReader(DataSourceReader):
    def __init__(self, path: str, data: bool):
        self.path, self.data = path, data
        self.names: frozenset | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("member",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.names = values if self.names is None else self.names & values
            elif isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _at(self.path)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        scheme = self.path.partition("://")[0] if "://" in self.path else "file"
        found = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(".zip"))
        return [Stripe(f"{scheme}://{p}", at, at + STRIPE) for p, size in found for at in range(0, max(size, 1), STRIPE)]

    def opened(self, uri: str):
        system, path = _at(uri)
        return Ranged(system.open_input_file(path))

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        archive = partition.uri.rpartition("/")[2]
        file, rows, size = self.opened(partition.uri), [], 0
        try:
            directory = zipfile.ZipFile(file)
        except (zipfile.BadZipFile, OSError, EOFError) as fault:
            if partition.start == 0:
                yield _batch([(archive, None, None, None, f"{type(fault).__name__}: {fault}")])
            return
        for m in sorted(directory.infolist(), key=lambda m: m.header_offset):
            if not partition.start <= m.header_offset < partition.end or m.is_dir():
                continue
            if self.names is not None and m.filename not in self.names or not all(map(m.filename.startswith, self.prefixes)):
                continue
            data = fault = None
            if self.data:
                try:
                    data = directory.read(m)
                except (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError) as e:
                    fault = f"{type(e).__name__}: {e}"
            rows.append((archive, m.filename, m.file_size, data, fault))
            size += len(data or b"") + 200
            if size > 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def read_zip(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("data", str(data).lower()).load(path)


def write_zip(members: DataFrame, path: str) -> DataFrame:
    """Writes (archive, member, data), an archive by one task and streamed to its file;
    returns the manifest (archive, file, members). An attempt writes files of its own, and
    a reader of the manifest's files never sees those of a lost one."""
    import uuid

    def save(batches):
        done, key, out = [], None, None

        def closed():
            out[1].close()
            out[0].close()
            done.append((key, out[2], out[3]))

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or r["archive"] != key:
                    if out:
                        closed()
                    key = r["archive"]
                    name = f"{key}-{uuid.uuid4().hex[:12]}.zip"
                    system, at = _at(f"{path.rstrip('/')}/{name}")
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(at)
                    out = [stream, zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_DEFLATED), name, 0]
                out[1].writestr(zipfile.ZipInfo(r["member"]), r["data"] or b"", zipfile.ZIP_DEFLATED)
                out[3] += 1
        if out:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["archive", "file", "members"])

    dealt = members.select("archive", "member", "data").repartition("archive").sortWithinPartitions("archive", "member")
    manifest = f"{path.rstrip('/')}/_manifest"
    dealt.mapInArrow(save, "archive string, file string, members long").write.mode("overwrite").parquet(manifest)
    return members.sparkSession.read.parquet(manifest)


class _Forward:
    """An output stream that can only be written on."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass

    def seekable(self) -> bool:
        return False
