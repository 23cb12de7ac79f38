"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end; the stream is cut into
blocks of equally many words. The schedule's slot t falls at the golden-ratio point
``frac(t / phi)``; cumulative weights map it to a source, and its rank among that
source's slots names the block it reads: block ``rank mod blocks``, in pass
``rank div blocks``. A source stops at its target to the word, so no document is read
more often than the target allows. So the targets say how much of a document the mix
takes, and the schedule when: ``mix`` gives the slot and the place in the slot's block
where a document first appears, and ``mixed`` lays the corpus out in the order of slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells_for, n_words, stored

BLOCK = 4096
CHUNK = 1 << 16
WEIGHTS = (5, 2, 1)
MOST = 3.0
#: One row per source reaches the driver; a table of more sources than this is refused.
MAX_SOURCES = 1_000_000
#: A source's stream is laid out in so many cells at least; a large source's in more.
CELLS = 1024


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Each source's share of all words by weight, at most ``most`` times its size; what
    is above is shared again by weight among the rest."""
    left, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    by_room = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    for k, i in enumerate(by_room):  # whoever has least room for its weight is full first
        if left * weights[i] <= most * sizes[i] * weight:
            for j in by_room[k:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = most * sizes[i]
        left, weight = left - out[i], weight - weights[i]
    return out


def golden(first: int, n: int) -> np.ndarray:
    """Golden-ratio points, by 64-bit integer arithmetic that stays exact for any slot."""
    t = np.arange(first + 1, first + n + 1, dtype=np.uint64)
    return (t * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64


def schedule(spark, need: list[int], points=golden, chunk_slots: int = CHUNK) -> DataFrame:
    """Slots (slot, src, rank): need[s] slots of each source s, interleaved as points(first
    slot, n) fall into the sources' shares.

    Slots beyond a source's need are left out; the few that the points leave short (a
    low-discrepancy sequence is off by a handful) follow at the end, one of each such source
    in turn. No slot is given twice; the numbers at the end have gaps.
    """
    slots, wanted = int(sum(need)), np.asarray(need)
    ends = np.cumsum(wanted) / max(slots, 1)

    def sources_of(chunk: int) -> np.ndarray:
        n = min(chunk_slots, slots - chunk * chunk_slots)
        return np.minimum(np.searchsorted(ends, points(chunk * chunk_slots, n), side="right"), len(ends) - 1)

    def count(batches):
        for b in batches:
            chunk, src, n = [], [], []
            for c in b.column(0).to_pylist():
                found, many = np.unique(sources_of(c), return_counts=True)
                chunk += [c] * len(found)
                src += found.tolist()
                n += many.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(src, pa.int32()), pa.array(n, pa.int64())], ["chunk", "src", "n"])

    def lay(batches):
        for b in batches:
            for c, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                src = sources_of(c)
                by = np.argsort(src, kind="stable")
                rank = np.empty(len(src), np.int64)
                found, counts = np.unique(src, return_counts=True)
                first = {x["src"]: x["start"] for x in starts}
                rank[by] = np.arange(len(src)) + np.repeat([first[s] for s in found.tolist()] - np.cumsum(counts) + counts, counts)
                keep = rank < wanted[src]
                yield pa.RecordBatch.from_arrays([pa.array(c * chunk_slots + np.flatnonzero(keep)), pa.array(src[keep].astype(np.int32)), pa.array(rank[keep])], ["slot", "src", "rank"])

    n_chunks = -(-slots // chunk_slots)
    chunks = spark.range(0, n_chunks, 1, max(1, min(n_chunks, 4 * spark.sparkContext.defaultParallelism)))
    counts = chunks.mapInArrow(count, "chunk long, src int, n long")
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    laid = starts.groupBy("chunk").agg(F.collect_list(F.struct("src", "start")).alias("starts")).mapInArrow(lay, "slot long, src int, rank long")
    wants = spark.createDataFrame([(s, int(n)) for s, n in enumerate(need)], "src int, need long")
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    short = wants.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    late = short.select("src", "got", F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    return laid.unionByName(late.select((F.lit(slots) + (F.col("rank") - F.col("got")) * len(need) + F.col("src")).alias("slot"), "src", "rank"))


def _key(id_col: str, text_col: str, source_col: str) -> list:
    """Two 64-bit hashes of id, source and text that tell nulls from their neighbours."""
    cols = [F.col(f"`{c}`") for c in (id_col, source_col, text_col)]
    return [F.xxhash64(F.lit(k), *[c.isNull() for c in cols], *cols).alias(f"key{k}") for k in (1, 2)]


def _mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, block: int, points) -> DataFrame:
    """One row per row: id, key1, key2, size, source_size, target, taken, slots (that of each
    pass over its first word, in order) and offset (its first word's place in the block)."""
    spark = df.sparkSession
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = stored(df.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), n_words(text).alias("size"), *_key(id_col, text_col, source_col)), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of them")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    words = [min(round(t), int(MOST * n)) for t, n in zip(aims, sizes)]
    blocks = [-(-n // block) for n in sizes]
    need = [w // n * b + -(-(w % n) // block) if n else 0 for w, n, b in zip(words, sizes, blocks)]
    plan = spark.createDataFrame(
        [(r["source"], i, n, t, w, b, max(CELLS, cells_for(r["rows"]))) for i, (r, n, t, w, b) in enumerate(zip(found, sizes, aims, words, blocks))],
        "source string, src int, source_size long, target double, words long, blocks long, cells long",
    )
    few = len(found) <= 100_000
    rows = sized.join(F.broadcast(plan) if few else plan, sized["source"].eqNullSafe(plan["source"])).drop("source")

    # where each document lies in its source's shuffled stream
    order = F.xxhash64("key1", F.lit("mix"))
    rows = rows.withColumn("order", order).withColumn("cell", F.shiftright(F.shiftrightunsigned("order", 32) * F.col("cells"), 32))
    cells = rows.groupBy("src", "cell").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("src", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("cell_pos"))
    inside = Window.partitionBy("src", "cell").orderBy(F.shiftrightunsigned("order", 32), "order", "key1", "key2")
    rows = rows.withColumn("pos", F.row_number().over(inside) - 1).withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(cells, ["src", "cell"]).withColumn("start", F.col("start") + F.col("cell_start")).withColumn("pos", F.col("pos") + F.col("cell_pos"))
    held = ["src", "pos", "id", "key1", "key2", "size", "source_size", "target", "start"]
    spans = rows.select(*held, F.explode_outer(F.expr(f"if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), array())")).alias("block"))

    # when the schedule reads each block, and how much of it at the very end
    small = plan.select("src", "source_size", "words", "blocks")
    slots = schedule(spark, need, points).join(F.broadcast(small) if few else small, "src")
    slots = slots.withColumn("block", F.expr("rank % blocks")).withColumn("length", F.expr(f"least({block}, source_size - block * {block})"))
    slots = slots.withColumn("take", F.expr(f"least(length, words - (rank div blocks) * source_size - block * {block})"))
    # a block is read once a pass, MOST times or once more at the very most
    used = slots.groupBy("src", "block").agg(F.count_if(F.expr("take = length")).alias("full"), F.max(F.expr("if(take < length, take, 0)")).alias("part"), F.sort_array(F.collect_list("slot")).alias("slots"))

    lap = lambda end: f"greatest(0, least(start + size, block * {block} + {end}) - greatest(start, block * {block}))"
    met = spans.join(used, ["src", "block"], "left").withColumn("t", F.expr(f"coalesce(full * {lap(block)} + {lap('part')}, 0)"))
    out = met.groupBy(*held).agg(F.sum("t").cast("long").alias("taken"), F.min_by("slots", "block").alias("slots"))
    return out.withColumn("offset", F.expr(f"start % {block}"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, block: int = BLOCK, points=golden) -> DataFrame:
    """One row per row: id, size, source_size, target, taken (words that the mix takes, repeats
    counted), slot and slot_offset (the slot that first reads the document's first word,
    and that word's place in the slot's block; null if nothing is taken).

    Null text has no words and is never taken; null sources form one source, the last. A
    text of any length lies across as many blocks as it fills. Repeated rows lie next to
    each other in their source's stream and are taken each for itself. A table without
    rows or words takes nothing. One row per source, no more, reaches the driver.
    """
    out = _mix(df, id_col, text_col, source_col, weights, block, points)
    some = F.col("taken") > 0
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(some, F.get("slots", F.lit(0))).alias("slot"), F.when(some, F.col("offset")).alias("slot_offset"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, block: int = BLOCK, points=golden) -> DataFrame:
    """The mixed corpus itself, laid out by slots: each row as often as the mix takes its
    words, rounded to whole texts (only the one document at a source's end is taken in
    part), at the slot of its first word in each pass. Partitions hold ranges of slots and
    are sorted, so written files follow the schedule.

    Nulls and empty tables are as in ``mix``. Texts meet their slots by two 64-bit hashes of
    the row's id, source and text. Rows that share all three are told apart by number,
    which costs one more shuffle; it is made only if there are such rows.
    """
    cols, keys = df.columns, ["key1", "key2"]
    placed = stored(_mix(df, id_col, text_col, source_col, weights, block, points).select(*keys, "src", "pos", "size", "taken", "slots", "offset"), "mix-slots")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *_key(id_col, text_col, source_col))
    on = list(keys)
    if not placed.groupBy(*keys).count().where("count > 1").isEmpty():
        on.append("copy")
        placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("src", "pos")))
        whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    times = placed.where("taken > 0").select(*on, "offset", F.expr("slice(slots, 1, cast(round(taken / size) as int))").alias("slots"))
    out = whole.join(times.where("size(slots) > 0"), on).select("row", F.explode("slots").alias("slot"), "offset")
    return out.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset").select("row.*").select(*[F.col(f"`{c}`") for c in cols])
