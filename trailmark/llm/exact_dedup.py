"""Grace hash deduplication of whole texts.

Records are dealt by a 64-bit hash of their content. Each task streams its records
into an open-addressing table that compares complete contents; when the table's
budget is full, the table and the rest of the stream are partitioned by further hash
bits to spill files, and each file is worked off in the same way, as deep as needed.
Before the shuffle each map task collapses the copies it sees with the same table,
so a content that fills a third of the corpus reaches its reducer as about one record
per map task.

Spill files are scratch of one running task, like Spark's own spills: in the
executor's local folder, gone when the task ends, read by nobody else. If an executor
is lost its tasks simply run again elsewhere.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_slice, text_or_empty

FANOUT_BITS = 4
MEMORY = 96 << 20
_MASK = (1 << 64) - 1


def weight(value) -> int:
    """About the bytes that a record's other columns take as Python objects."""
    if value is None:
        return 0
    if isinstance(value, (str, bytes)):
        return 80 + 2 * len(value)
    if isinstance(value, dict):
        return 200 + sum(80 + weight(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return 80 + sum(16 + weight(v) for v in value)
    return 32


class ContentTable:
    """Open addressing with linear probing; one entry per different content."""

    def __init__(self, slots: int = 1 << 12):
        self.slots = [-1] * slots
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, fp: int, content: str, key: int | None, rows: int, n_keep: int, rest) -> None:
        """Counts rows copies whose largest key is key, held by n_keep rows."""
        mask = len(self.slots) - 1
        at = (fp * 0x9E3779B97F4A7C15 & _MASK) >> 20 & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == fp and entry[1] == content:
                entry[3] += rows
                if key == entry[2]:
                    entry[4] += n_keep
                elif entry[2] is None or (key is not None and key > entry[2]):
                    self.bytes += weight(rest) - weight(entry[5])
                    entry[2], entry[4], entry[5] = key, n_keep, rest
                return
            at = at + 1 & mask
        self.slots[at] = len(self.entries)
        self.entries.append([fp, content, key, rows, n_keep, rest])
        self.bytes += 2 * len(content) + 400 + weight(rest)
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, entry in enumerate(self.entries):
            at = (entry[0] * 0x9E3779B97F4A7C15 & _MASK) >> 20 & mask
            while self.slots[at] >= 0:
                at = at + 1 & mask
            self.slots[at] = e


def grace(records: Iterable[tuple], memory: int = MEMORY, depth: int = 0, folder: str | None = None) -> Iterator[list]:
    """Entries [fp, content, key, rows, n_keep, rest], one per different content."""
    table, files, own = ContentTable(), None, None
    shift = FANOUT_BITS * depth
    try:
        for record in records:
            if files is None:
                table.add(*record)
                # records of one fingerprint can't be parted by further bits
                if table.bytes <= memory or shift >= 64 or all(e[0] == record[0] for e in table.entries):
                    continue
                if own is None and folder is None:
                    own = folder = tempfile.mkdtemp(prefix="grace-", dir=_scratch_root())
                files = [open(os.path.join(folder, f"{depth}-{k}-{id(table)}"), "w+b") for k in range(1 << FANOUT_BITS)]
                for entry in table.entries:
                    pickle.dump(tuple(entry), files[entry[0] >> shift & (1 << FANOUT_BITS) - 1])
                table = ContentTable()
            else:
                pickle.dump(tuple(record), files[record[0] >> shift & (1 << FANOUT_BITS) - 1])
        if files is None:
            yield from table.entries
            return
        for f in files:
            f.seek(0)
            yield from grace(_unpickled(f), memory, depth + 1, folder)
            f.close()
            os.unlink(f.name)
    finally:
        for f in files or ():
            f.close()
        if own:
            shutil.rmtree(own, ignore_errors=True)


def _unpickled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _scratch_root() -> str | None:
    """Spark's local folder for this executor, where it spills too."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return local if local and os.path.isdir(local) else None


def _groups(df: DataFrame, id_col: str, text_col: str, memory: int) -> tuple[DataFrame, list]:
    """(fp, text, id, n, n_keep, rest, sha) of each different text, and df's columns in it."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None).cast("struct<c0:int>")
    text = text_or_empty(f"`{text_col}`")
    one = df.select(F.xxhash64(text).alias("fp"), text.alias("text"), F.col(f"`{id_col}`").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_keep"), rest.alias("rest"))
    partial = one.mapInArrow(lambda it: _merged(it, memory // 4, False), one.schema)
    merged = T.StructType([*one.schema.fields, T.StructField("sha", T.StringType())])
    found = partial.repartition("fp").mapInArrow(lambda it: _merged(it, memory, True), merged)
    places = {id_col: "id", text_col: "text"} | {c: f"rest.c{i}" for i, c in enumerate(others)}
    return found, [F.col(places[c]).alias(c) for c in df.columns]


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """df without copies: of equal texts the row with the largest id stays, once, with all
    its columns; null text comes back as empty.

    Null ids rank below all others. Of repeated rows with the same id and text any one
    stands for the rest. An empty table gives none. A text of any length is one record;
    the memory budget counts the other columns too.
    """
    found, columns = _groups(df, id_col, text_col, memory)
    return found.select(*columns)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch, texts in each_slice(batches):
        fps, ids, ns, keeps = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
        rest = batch.column(5)
        plain = rest.null_count == len(rest)
        for i, fp in enumerate(fps):
            yield fp & _MASK, texts[i], ids[i], ns[i], keeps[i], None if plain else rest[i].as_py()


def _merged(batches, memory: int, final: bool):
    schema = None

    def seen(it):
        nonlocal schema
        for b in it:
            schema = schema or b.schema
            yield b

    source = _records(seen(batches))
    entries = grace(source, memory) if final else _flushed(source, memory)
    held, size = [], 0
    for e in entries:
        held.append(e)
        size += len(e[1]) + 200 + weight(e[5])
        if size > 4 << 20:
            yield _batch(held, schema, final)
            held, size = [], 0
    if held:
        yield _batch(held, schema, final)


def _flushed(source: Iterator[tuple], memory: int) -> Iterator[list]:
    """Map-side: what the table holds goes on whenever it is full."""
    table = ContentTable()
    for record in source:
        table.add(*record)
        if table.bytes > memory:
            yield from table.entries
            table = ContentTable()
    yield from table.entries


def _batch(entries: list[list], schema: pa.Schema, final: bool) -> pa.RecordBatch:
    columns = [[e[0] - (1 << 64) if e[0] >> 63 else e[0] for e in entries], *([e[i] for e in entries] for i in range(1, 6))]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    names = list(schema.names)
    if final:
        arrays.append(pa.array([hashlib.sha256(e[1].encode()).hexdigest() for e in entries]))
        names.append("sha")
    return pa.RecordBatch.from_arrays(arrays, names)


def membership(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Exactly one row of a group is kept, also where rows are
    repeated. The join is by digest; a digest that many rows share is split by adaptive
    execution's skew join, since nothing above it needs a digest's rows together.
    """
    sha = F.sha2(text_or_empty(f"`{text_col}`"), 256)
    copy = F.row_number().over(Window.partitionBy("id", "text_sha256").orderBy(F.lit(1)))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), sha.alias("text_sha256")).withColumn("copy", copy)
    kept, _ = _groups(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", memory)
    kept = kept.select(F.col("sha").alias("text_sha256"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    out = rows.join(kept, "text_sha256")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
