"""A small table that is replaced as a whole: a data source with a committing writer.

Tasks write files of their own into a new version's folder and report their names. Only
when all tasks are done the driver writes the version's list of files and moves a pointer
onto it, in one rename. A reader follows the pointer once, so it sees the old table or the
new one; files of lost or repeated attempts are in no list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

POINTER = "_current"


def _at(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return system, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class VersionedTable(DataSource):
    """``df.write.format("versioned").mode("overwrite")`` and ``spark.read.format("versioned")``
    with the option path. Only overwriting is offered."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        system, path, files = _files(self.options["path"])
        return from_arrow_schema(pq.read_schema(f"{path}/{files[0]}", filesystem=system))

    def reader(self, schema) -> VersionReader:
        return VersionReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> VersionWriter:
        if not overwrite:
            raise ValueError("a versioned table can only be overwritten")
        from pyspark.sql.pandas.types import to_arrow_schema

        return VersionWriter(self.options["path"], to_arrow_schema(schema))


def _files(uri: str):
    system, path = _at(uri)
    with system.open_input_stream(f"{path}/{POINTER}") as f:
        version = json.loads(f.read())
    return system, path, version["files"]


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: pa.Schema):
        self.uri, self.schema, self.version = uri, schema, uuid.uuid4().hex

    def _save(self, name: str, batches) -> None:
        system, path = _at(self.uri)
        system.create_dir(f"{path}/{self.version}", recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out, pq.ParquetWriter(out, self.schema) as writer:
            for batch in batches:
                writer.write_table(pa.Table.from_batches([batch]).cast(self.schema))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"{self.version}/part-{uuid.uuid4().hex}.parquet"
        first = next(iterator, None)
        if first is None:
            return Written(None)

        def batches():
            yield first
            yield from iterator

        self._save(name, batches())
        return Written(name)

    def commit(self, messages) -> None:
        files = sorted(m.file for m in messages if m is not None and m.file)
        if not files:  # an empty table still has columns
            files = [f"{self.version}/part-empty.parquet"]
            self._save(files[0], [])
        system, path = _at(self.uri)
        with system.open_output_stream(f"{path}/{self.version}/{POINTER}") as f:
            f.write(json.dumps({"version": self.version, "files": files}).encode())
        system.move(f"{path}/{self.version}/{POINTER}", f"{path}/{POINTER}")

    def abort(self, messages) -> None:
        system, path = _at(self.uri)
        if system.get_file_info(f"{path}/{self.version}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.version}")


class Part(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class VersionReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        return [Part(f) for f in _files(self.uri)[2]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, path = _at(self.uri)
        with pq.ParquetFile(f"{path}/{partition.file}", filesystem=system) as f:
            yield from f.iter_batches(batch_size=8192)


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces the table at path; the versions before stay until they are swept."""
    df.sparkSession.dataSource.register(VersionedTable)
    df.write.format("versioned").mode("overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VersionedTable)
    return spark.read.format("versioned").load(path)


def sweep(path: str) -> int:
    """Deletes all versions but the current one; to be called when no reader is left on
    them. Returns how many went."""
    system, at, files = _files(path)
    current = files[0].partition("/")[0]
    old = [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory and i.base_name != current]
    for p in old:
        system.delete_dir(p)
    return len(old)
