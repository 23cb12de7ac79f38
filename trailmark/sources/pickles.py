"""Buckets kept as pickled dictionaries of lists, read without running anything.

A pickle is a program, and one from elsewhere may call what it likes. Here the opcodes are
walked one by one and only those that build plain values (texts, numbers, None, booleans,
lists, tuples, sets, dictionaries) are known; a file with any other is refused.
"""

from __future__ import annotations

import pickle
import pickletools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trailmark.sources.versions import _at

#: Opcodes whose argument is the value.
_VALUES = {"BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "UNICODE", "INT", "BININT", "BININT1", "BININT2", "LONG", "LONG1", "LONG4", "FLOAT", "BINFLOAT", "BINBYTES", "SHORT_BINBYTES", "BINBYTES8"}
_CONSTANTS = {"NONE": None, "NEWTRUE": True, "NEWFALSE": False}
_EMPTY = {"EMPTY_LIST": list, "EMPTY_DICT": dict, "EMPTY_TUPLE": tuple, "EMPTY_SET": set}
_FRAMES = {"PROTO", "FRAME"}
_MARK = object()


class Refused(ValueError):
    """The pickle holds more than plain values."""


def plain(data: bytes) -> object:
    """The value of a pickle of plain containers; Refused for anything else."""
    stack: list = []
    memo: dict[int, object] = {}

    def marked() -> list:
        taken: list = []
        while (top := stack.pop()) is not _MARK:
            taken.append(top)
        return taken[::-1]

    def single() -> object:
        if stack[-1] is _MARK:
            raise Refused("a mark where a value should be")
        return stack.pop()

    try:
        for op, arg, _ in pickletools.genops(data):
            name = op.name
            if name in _VALUES:
                stack.append(arg)
            elif name in _CONSTANTS:
                stack.append(_CONSTANTS[name])
            elif name in _EMPTY:
                stack.append(_EMPTY[name]())
            elif name == "MARK":
                stack.append(_MARK)
            elif name == "MEMOIZE":
                memo[len(memo)] = stack[-1]
            elif name in ("PUT", "BINPUT", "LONG_BINPUT"):
                memo[arg] = stack[-1]
            elif name in ("GET", "BINGET", "LONG_BINGET"):
                stack.append(memo[arg])
            elif name in ("LIST", "TUPLE"):
                items = marked()
                stack.append(items if name == "LIST" else tuple(items))
            elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
                stack.append(tuple([single() for _ in range(int(name[-1]))][::-1]))
            elif name == "APPEND":
                item = single()
                stack[-1].append(item)
            elif name == "APPENDS":
                items = marked()
                stack[-1].extend(items)
            elif name == "ADDITEMS":
                items = marked()
                stack[-1].update(items)
            elif name in ("SETITEM", "SETITEMS", "DICT"):
                flat = [single(), single()][::-1] if name == "SETITEM" else marked()
                if name == "DICT":
                    stack.append({})
                stack[-1].update(zip(flat[::2], flat[1::2], strict=True))
            elif name == "STOP":
                value = single()
                if stack:
                    raise Refused("values are left over")
                return value
            elif name not in _FRAMES:
                raise Refused(f"opcode {name} does more than build plain values")
    except (IndexError, KeyError, TypeError, AttributeError, ValueError) as fault:
        raise fault if isinstance(fault, Refused) else Refused(f"not a pickle of plain values: {fault}") from fault
    raise Refused("the pickle does not end")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """bucket, member of all pickled dictionaries under path; a file is one task's at most.
    Keys and members are put as texts; an empty bucket has no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                buckets = plain(data.as_py())
                if not isinstance(buckets, dict) or not all(isinstance(v, (list, tuple, set)) for v in buckets.values()):
                    raise Refused("not a dictionary of lists")
                for bucket, members in buckets.items():
                    texts = [None if m is None else str(m) for m in members]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([str(bucket)] * len(texts), pa.string()), "member": pa.array(texts, pa.string())})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pkl").load(path)
    return files.select("content").mapInArrow(read, "bucket string, member string")


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class PickledBuckets(DataSource):
    """``df.write.format("pickled_buckets").mode("append")`` of (bucket, member) with the
    options path and rows (members of a file at most, 100,000). Files show up under names
    ending in .pkl only when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "pickled_buckets"

    def schema(self) -> str:
        return "bucket string, member string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("buckets can only be appended")
        return _Writer(self.options["path"], int(self.options.get("rows", 100_000)))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        held: dict[str, list] = defaultdict(list)
        count, names = 0, []

        def put() -> None:
            name = f"buckets-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{path}/_{name}") as out:
                out.write(pickle.dumps(dict(held), protocol=4))
            names.append(name)
            held.clear()

        for batch in iterator:
            for bucket, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[bucket].append(member)
                count += 1
                if count % self.rows == 0:
                    put()
        if held:
            put()
        return _Files(names)

    def commit(self, messages: list[_Files | None]) -> None:
        system, path = _at(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{path}/_{name}", f"{path}/{name}.pkl")

    def abort(self, messages: list[_Files | None]) -> None:
        system, path = _at(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.delete_file(f"{path}/_{name}")


def write_buckets(df: DataFrame, path: str, bucket: str, member: str, rows: int = 100_000) -> None:
    """Appends (bucket, member) rows to path as pickled dictionaries of lists."""
    df.sparkSession.dataSource.register(PickledBuckets)
    texts = df.select(df[bucket].cast("string").alias("bucket"), df[member].cast("string").alias("member"))
    texts.write.format("pickled_buckets").mode("append").option("path", path).option("rows", rows).save()
