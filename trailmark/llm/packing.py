"""Packing documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut into full sequences and a remainder. Only the histogram
of piece lengths, at most as many numbers as a sequence has tokens, reaches the driver:
lengths are placed longest first, each into the shortest packs that still hold it, as
counts of packing patterns. Patterns then go back to the pieces by each piece's rank
among those of its length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_slices, cells_for, gapless, gathered, stored

LENGTH = 1024
END_ID = 0


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(piece length, pieces of it in a row), ...]).

    Longest lengths first, each into the shortest packs that hold it. Where none does,
    as many new packs are opened as the pieces left need at least.
    """
    packs: list[tuple[int, int, int, tuple]] = []  # (fill, age, sequences, pattern), shortest first
    done, age = [], 0
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            if packs and packs[0][0] + size <= length:
                fill, _, many, pattern = heapq.heappop(packs)
                used = min(many, n)
                if used < many:
                    heapq.heappush(packs, (fill, age, many - used, pattern))
                    age += 1
                last = (size, pattern[-1][1] + 1) if pattern[-1][0] == size else (size, 1)
                pattern = (*(pattern[:-1] if last[1] > 1 else pattern), last)
            else:
                fill, used, pattern = 0, -(-n // (length // size)), ((size, 1),)
            n -= used
            if fill + size == length:
                done.append((used, list(pattern)))
            else:
                heapq.heappush(packs, (fill + size, age, used, pattern))
                age += 1
    return done + [(many, list(pattern)) for _, _, many, pattern in packs]


def blocks(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces per sequence, first sequence, offset)."""
    out, rank, sequence = [], {}, 0
    for many, pattern in patterns:
        offset = 0
        for size, times in pattern:
            first = rank.get(size, 0)
            out.append((size, first, first + many * times - 1, times, sequence, offset))
            rank[size] = first + many * times
            offset += size * times
        sequence += many
    return out


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (and ids, as
    little-endian unsigned 32-bit integers). Null and empty texts are the end id alone."""

    def cut(batches):
        encoder = tokens.encoder(tokenizer)
        for batch, texts in arrow_slices(gathered(batches)):
            ids, ends = encoder.encode(texts)
            rows, starts, sizes, crcs, totals, held = [], [], [], [], [], []
            for i in range(len(texts)):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                for a in range(0, len(own), length):
                    part = own[a : a + length].tobytes()
                    rows.append(i), starts.append(a), sizes.append(len(part) // 4), crcs.append(zlib.crc32(part)), totals.append(len(own))
                    if with_ids:
                        held.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and
    ids). An empty table gives none; repeated rows are packed each for itself, null and empty
    texts as the end id alone, and a text of any length as its pieces. Pieces of one length
    are ranked in as many cells as a cell has pieces, so neither the cells nor what one of
    them holds grows as fast as the corpus."""
    cut = stored(pieces(df, tokenizer or tokens.default_path(), id_col, text_col, length, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = blocks(pack_histogram(counts, length))
    table = df.sparkSession.createDataFrame(plan, "length long, first long, last long, times long, sequence long, base long")
    if len(plan) <= 200_000:  # a matter of the sequence length, not of the corpus
        table = F.broadcast(table)
    cells = F.get(F.array(*[F.lit(cells_for(counts.get(n, 0))) for n in range(length + 1)]), F.col("length").cast("int"))
    ranked = gapless(cut, ["length"], [F.col("id"), F.col("start"), F.col("ids_crc32")], "rank", cells, key=[F.col("id"), F.col("start")])
    placed = ranked.join(table, "length").where("rank between first and last")
    at = F.expr("rank - first")
    held = ["start", "length", "ids_crc32", "doc_tokens"]
    return placed.select(F.col("id").alias(id_col), *held, F.expr("sequence + (rank - first) div times").alias("sequence_id"), (F.col("base") + at % F.col("times") * F.col("length")).alias("offset"), *["ids"] * with_ids)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """The sequences themselves, of ``pack(..., with_ids=True)``: sequence_id, ids (padded),
    tokens. A sequence's pieces, at most ``length`` of them, meet in one group."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(length) - F.col("tokens")).cast("int")))
    return joined.select("sequence_id", F.concat(ids, pad).alias("ids"), "tokens")
