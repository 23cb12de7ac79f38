"""Structured Streaming over event tables: windows, sessions, de-duplication, state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, **options) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(path)


def stream_table(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A stream of all files of a Parquet table. A stream reads folders only, so a table of
    one file is read as that file of its folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return stream(spark, path, schema, **options)
    return stream(spark, jpath.getParent().toString(), schema, pathGlobFilter=jpath.getName(), **options)


def tumbling(df: DataFrame, time: str, width: str, group: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, sum and mean per window (sliding where slide is given); works on streams and
    tables."""
    watched = df.withWatermark(time, late) if df.isStreaming else df
    out = watched.groupBy(F.window(time, width, slide or width), *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), *group, "n", "total", "mean")


def sessions(df: DataFrame, time: str, gap: str, group: list[str], late: str = "1 hour") -> DataFrame:
    """Start, end and number of events of each session."""
    watched = df.withWatermark(time, late) if df.isStreaming else df
    out = watched.groupBy(F.session_window(time, gap), *group).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*group, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(df: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, although it may be delivered several times."""
    if not df.isStreaming:
        return df.dropDuplicates(key)
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def moving_averages(df: DataFrame, key: str, order: str, value: str, alpha: float, start: float, low: float, high: float) -> DataFrame:
    """Running clamped average per key, state kept between micro-batches: key, n, ema.
    Rows of one micro-batch are taken in the given order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, start)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for v in rows[value]:
            ema = min(high, max(low, ema * (1 - alpha) + v * alpha))
        n += len(rows)
        state.update((int(n), float(ema)))
        yield pd.DataFrame({key: [k[0]], "n": [int(n)], "ema": [float(ema)]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


class _Averages(StatefulProcessor):
    """State of seeded_averages: n and ema per key, dropped when the key was idle long enough."""

    def __init__(self, key: str, order: str, value: str, time: str | None, idle_ms: int | None, alpha: float, start: float, low: float, high: float) -> None:
        self.key, self.order, self.value, self.time, self.idle_ms = key, order, value, time, idle_ms
        self.alpha, self.start, self.low, self.high = alpha, start, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("average", "n long, ema double")

    def _row(self, k, n: int, ema: float, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [k], "n": [int(n)], "ema": [float(ema)], "expired": [expired]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.held.update((int(row["n"]), float(row["ema"])))
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ema = self.held.get() if self.held.exists() else (0, self.start)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        if self.idle_ms is not None:
            now = timerValues.getCurrentWatermarkInMs()
            timers = list(self.handle.listTimers())
            for timer in timers:
                self.handle.deleteTimer(timer)
            if any(timer <= now for timer in timers):  # due in this batch, whose rows come first
                yield self._row(key[0], n, ema, True)
                n, ema = 0, self.start
            latest = [int(t.timestamp() * 1000) for t in batch[self.time].dropna()]
            self.handle.registerTimer(max([now, *latest]) + self.idle_ms)
        for v in batch[self.value].dropna():
            ema = min(self.high, max(self.low, ema * (1 - self.alpha) + v * self.alpha))
            n += 1
        self.held.update((int(n), float(ema)))
        yield self._row(key[0], n, ema, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, ema = self.held.get()
        self.held.clear()
        yield self._row(key[0], n, ema, True)

    def close(self) -> None:
        pass


def seeded_averages(
    df: DataFrame, key: str, order: str, value: str, alpha: float, start: float, low: float, high: float, seed: DataFrame | None = None, time: str | None = None, idle_seconds: int | None = None, late: str = "1 hour"
) -> DataFrame:
    """Running clamped average per key that resumes from a durable table: key, n, ema, expired.

    ``seed`` (key, n, ema; one row per key) is the state before the first batch; it is read
    once, when the checkpoint is new. A key gives a row for each batch that has rows of it,
    and with ``idle_seconds`` a last one, expired, once the watermark of ``time`` has passed
    its latest row by that much: its state goes, and the key begins at ``start`` again. So the
    state holds no more keys than the idle span has. Rows of one batch are taken in order, a
    key's rows at once; nulls are left out.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if idle_seconds is not None and time is None:
        raise ValueError("idle_seconds needs the column of event time")
    kind = df.schema[key].dataType.simpleString()
    watched = df if idle_seconds is None else df.withWatermark(time, late)
    processor = _Averages(key, order, value, time, None if idle_seconds is None else idle_seconds * 1000, alpha, start, low, high)
    return watched.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{key} {kind}, n long, ema double, expired boolean",
        outputMode="Update",
        timeMode="None" if idle_seconds is None else "EventTime",
        initialState=None if seed is None else seed.groupBy(key),
    )


def to_end(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns its result, for small results: they
    are held by the driver."""
    name = f"stream_{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns all rows that it gave, from a Parquet
    folder per batch; a batch that is replayed replaces its own folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def append_new(df: DataFrame, path: str, checkpoint: str, key: list[str]) -> None:
    """Appends rows to a Parquet table whose keys it doesn't hold yet, batch by batch; a
    batch that is replayed adds nothing twice."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
