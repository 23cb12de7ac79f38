"""What several of the training-data operators share."""

from __future__ import annotations

import math
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import scratch, shared_dir  # noqa: F401

#: Words are maximal runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def drop_scratch(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, and
    the result outlives a lost executor."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, before the driver ends."""
    for df in tables:
        if path := _paths.pop(df, None):
            drop_scratch(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col):
    """Number of words of a string column; null counts as no words."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_slices(batches: Iterable, text: str = "text", limit: int = 4 << 20) -> Iterator[tuple]:
    """(batch slice, its text column with null as empty) of Arrow batches, each of about
    limit bytes of text, so that a batch of very long texts is worked off in pieces."""
    for batch in batches:
        texts = pc.fill_null(batch.column(text), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, side="right")))
            yield batch.slice(start, end - start), texts.slice(start, end - start)
            start = end


def gathered(batches: Iterable, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together to about limit bytes, for work that gains from more
    rows at a time than a batch has."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def each_slice(batches: Iterable, text: str = "text", limit: int = 4 << 20) -> Iterator[tuple]:
    """The same with the texts as a list of strings."""
    for batch, texts in arrow_slices(batches, text, limit):
        yield batch, texts.to_pylist()


def cells_for(rows: int) -> int:
    """Cells for a group of so many rows: the root of it, so that cells and rows in a cell
    both stay few."""
    return max(1, math.isqrt(rows))


def gapless(df: DataFrame, group: list[str], order: list, out: str, cells, key=None) -> DataFrame:
    """Adds out: the row's position in its group, gapless from 0.

    A group may hold any share of the rows, so it is dealt over ``cells`` cells by a
    hash of the order columns; positions within a cell come from a window, and each
    cell starts after the cells before it. df must give the same rows when read again.
    The order is by cell, then by ``order``.
    """
    from pyspark.sql import Window

    cell = F.pmod(F.xxhash64(*(key if key is not None else order)), cells if isinstance(cells, Column) else F.lit(cells)).cast("int")
    dealt = df.withColumn("_cell", cell)
    sizes = dealt.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_cell").orderBy(*order)
    placed = dealt.withColumn("_at", F.row_number().over(within) - 1)
    return placed.join(starts, [*group, "_cell"]).withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).drop("_cell", "_at", "_start")
