"""Readers for tables kept as Parquet, JSON lines, JSON files, logs, reports and XML."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "array<struct<event_start_timestamp:long,coc:string>>"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def first_of(spark: SparkSession, *paths: str, fmt: str = "parquet") -> DataFrame:
    """The first path that can be read: a mirror, then its origin."""
    for path in paths[:-1]:
        try:
            return spark.read.format(fmt).load(path)
        except AnalysisException:
            continue
    return spark.read.format(fmt).load(paths[-1])


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of JSON-lines files, plain or gzipped; blank lines skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    good = F.col("row").isNotNull() & F.col("row._bad").isNull()
    return parsed.where(good).select("row.*").drop("_bad"), parsed.where(~F.coalesce(good, F.lit(False))).select("value")


def json_files(spark: SparkSession, path: str, schema: str, key: str = "stem") -> DataFrame:
    """One row per JSON file under path, its file name without suffix as key; files that
    don't parse are skipped."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?(\.gz)?$", 1)
    rows = whole.select(name.alias(key), F.from_json("value", schema).alias("row"), F.try_parse_json("value").isNotNull().alias("ok"))
    return rows.where("ok").select(key, "row.*")


def broken_json_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files that hold no valid JSON document."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return whole.where(F.try_parse_json("value").isNull()).select(F.col("_metadata.file_path").alias("path"))


def marked_lines(lines: DataFrame, marker: str, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, count of bad ones) of log lines that hold marker before a JSON payload."""
    payload = F.substring_index(value, marker, -1)
    found = lines.where(F.col(value).contains(marker)).select(F.from_json(F.trim(payload), schema).alias("row"), F.try_parse_json(F.trim(payload)).isNotNull().alias("ok"))
    return found.where("ok").select("row.*"), found.agg(F.count_if(~F.col("ok")).alias("bad"))


def quoted_reports(spark: SparkSession, path: str, header: str = "## ") -> DataFrame:
    """Sections of Markdown reports: file, position, title and the block quotes below it."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    parts = whole.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), f"\n{header}")).alias("position", "section")).where("position > 0")
    lines = F.split("section", "\n")
    quotes = F.transform(F.filter(lines, lambda x: x.startswith(">")), lambda x: F.trim(F.regexp_replace(x, "^>\\s?", "")))
    return parts.select("file", "position", F.trim(F.get(lines, F.lit(0))).alias("title"), F.array_join(quotes, "\n").alias("quote"))


def routes(spark: SparkSession, path: str) -> DataFrame:
    """Routes of XML files: id, town, and their way points."""
    schema = "_id string, _town string, waypoints struct<position:array<struct<_x:double,_y:double,_z:double>>>"
    df = spark.read.format("xml").option("rowTag", "route").schema(schema).load(path)
    return df.select(F.col("_id").alias("route_id"), F.col("_town").alias("town"), F.transform("waypoints.position", lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y"), p["_z"].alias("z"))).alias("waypoints"))


def events_cell(cell: Column) -> Column:
    """An events cell as an array: null and the text None are empty."""
    return F.when(cell.isNull() | (F.trim(cell) == "None"), F.array().cast(EVENTS)).otherwise(F.coalesce(F.from_json(cell, EVENTS), F.array().cast(EVENTS)))


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; readers see whole files only."""
    df.write.mode("append").json(path)


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def projected(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The named columns; one that df lacks, or a null, becomes its default (None: null)."""
    column = lambda name, value: F.lit(value) if name not in df.columns else F.col(name) if value is None else F.coalesce(name, F.lit(value))
    return df.select(*[column(name, value).alias(name) for name, value in defaults.items()])


def parquet_in_bytes(df: DataFrame, content: str, schema: str, rows: int = 10_000) -> DataFrame:
    """The rows of Parquet files that df holds as bytes, such as members of archives.

    Only the schema's columns are decoded, batch by batch; one file's bytes are the most a
    task holds at a time. Null content has no rows; other bytes that aren't Parquet fail.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = df.sparkSession.createDataFrame([], schema).schema
    target = to_arrow_schema(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if data.is_valid:
                    for found in pq.ParquetFile(io.BytesIO(data.as_py())).iter_batches(rows, columns=target.names):
                        yield from pa.Table.from_batches([found]).select(target.names).cast(target).to_batches()

    return df.select(content).mapInArrow(read, wanted)
