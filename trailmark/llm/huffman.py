"""Token ids in files, by canonical length-limited Huffman codes.

Codes come from the counts of all ids (package-merge, at most MAX_BITS bits). A file
holds a range of documents in ascending id order:

    magic | lengths: vocabulary size u32, one byte each | blocks | documents | index | tail

Blocks of BLOCK ids are independent: payload bits from a byte of their own, and the bit
offset of every LANE-th id, so that all lanes of a block decode together by table
look-up. ``documents`` is an Arrow stream (id, n); ``index`` has for each block its
ids, file offset, payload bytes and checkpoints; the tail says where both begin.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from . import tokens
from .common import arrow_slices, discard, gathered, scratch, stored
from .files import opened, written

MAGIC = b"TMHUF01\n"
MAX_BITS = 16
#: Bits that the decoder's window surely holds: 32, less those before a code in its first byte.
WIDEST = 25
BLOCK = 1 << 19
LANE = 256
FILE_IDS = 8 << 20
END_ID = 2


# ---- codes


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for absent ids.

    Without a limit it is MAX_BITS, or where more ids are used than that suits, two more
    than would number them, up to WIDEST."""
    used = np.flatnonzero(counts)
    if limit is None:
        limit = min(WIDEST, max(MAX_BITS, (len(used) - 1).bit_length() + 2))
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        both = both[by]
        even = len(both) // 2 * 2
        packages = both[0:even:2] + both[1:even:2]
    take = 2 * (len(leaves) - 1)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes: shorter first, equal lengths by id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for length in np.unique(lengths[used]):
        code <<= int(length) - last
        of = used[lengths[used] == length]
        codes[of] = code + np.arange(len(of))
        code, last = code + len(of), int(length)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, bits) for each value of the next bits: MAX_BITS, or as many as the longest code."""
    limit = max(MAX_BITS, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spread = 1 << (limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(spread.sum())
    ids[:n], bits[:n] = np.repeat(order, spread), np.repeat(lengths[order], spread)
    return ids, bits


# ---- blocks


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offsets of every LANE-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    # each code within the 64 bits from its 32-bit word on; every word has a code's start
    wide = codes[ids].astype(np.uint64) << (64 - size - (starts & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(starts >> 5, prepend=-1))
    words = np.bitwise_or.reduceat(wide, first)
    out = np.zeros(len(words) + 1, np.uint64)
    out[:-1] = words >> np.uint64(32)
    out[1:] |= words & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::LANE]


def decode_block(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    ids, bits = table
    unread = np.uint32(33 - len(ids).bit_length())
    b = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    at, last = checkpoints.astype(np.int64), len(window) - 1
    out = np.empty((LANE, len(at)), np.uint32)
    for k in range(LANE):
        code = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> unread
        out[k] = ids[code]
        at += bits[code]
    return out.T.reshape(-1)[:n]


# ---- files


def file_chunks(batches, codes: np.ndarray, lengths: np.ndarray, dtype: str, meta: dict) -> Iterator[bytes]:
    """A file's bytes; batches are Arrow batches (id, n, ids) in order."""
    head = MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes()
    yield head
    at, index, docs, held, size = len(head), [], [], [], 0

    def flush(n: int):
        nonlocal held, size, at
        ids = np.concatenate(held)
        payload, points = encode_block(ids[:n], codes, lengths)
        index.append((n, at, len(payload), points))
        at += len(payload)
        held, size = [ids[n:]], size - n
        return payload

    for batch in batches:
        docs.append(batch.select([0, 1]))
        for data in batch.column(2):
            own = np.frombuffer(data.as_buffer(), dtype)
            held.append(own)
            size += len(own)
            while size >= BLOCK:
                yield flush(BLOCK)
    if size:
        yield flush(size)
    sink = io.BytesIO()
    if docs:
        with pa.ipc.new_stream(sink, docs[0].schema) as w:
            for d in docs:
                w.write_batch(d)
    meta["docs"], meta["ids"] = sum(len(d) for d in docs), sum(x[0] for x in index)
    documents = sink.getvalue()
    rows = b"".join(struct.pack("<QQQQ", n, a, m, len(p)) + p.astype("<u8").tobytes() for n, a, m, p in index)
    yield documents + struct.pack("<Q", len(index)) + rows + struct.pack("<QQ", at, at + len(documents)) + MAGIC


def read_file(uri: str) -> Iterator[tuple]:
    """(document id, n, its ids in parts) in file order, block by block."""
    with opened(uri) as f:
        total = f.size()
        if f.read_at(len(MAGIC), 0) != MAGIC or f.read_at(len(MAGIC), total - len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri}: not a token file, or cut off")
        (n,) = struct.unpack("<I", f.read_at(4, len(MAGIC)))
        table = decode_table(np.frombuffer(f.read_at(n, len(MAGIC) + 4), np.uint8))
        tail = total - len(MAGIC) - 16
        docs_at, index_at = struct.unpack("<QQ", f.read_at(16, tail))
        raw, at = f.read_at(tail - index_at, index_at), 8
        (n_blocks,) = struct.unpack("<Q", raw[:8])
        index = []
        for _ in range(n_blocks):
            n, a, m, points = struct.unpack("<QQQQ", raw[at : at + 32])
            index.append((n, a, m, np.frombuffer(raw, "<u8", points, at + 32)))
            at += 32 + 8 * points
        if index_at == docs_at:
            return
        docs = pa.ipc.open_stream(f.read_at(index_at - docs_at, docs_at)).read_all()
        blocks = (decode_block(f.read_at(m, a), points, n, table) for n, a, m, points in index)
        left = np.zeros(0, np.uint32)
        for doc, n in zip(docs.column(0), docs.column(1).to_pylist()):
            parts, need = [], n
            while need > len(left):
                parts.append(left)
                need -= len(left)
                left = next(blocks)
            parts.append(left[:need])
            left = left[need:]
            yield doc.as_py(), n, parts


# ---- tables


def tokenised(df: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, n, ids, token, count): rows of documents, ids as unsigned integers (16 bits
    where the vocabulary allows), and with n null each task's counts, as arrays."""

    def run(batches):
        encoder = tokens.encoder(tokenizer)
        dtype, total, kind = _dtype(len(encoder.bytes)), np.zeros(len(encoder.bytes), np.int64), None
        for batch, texts in arrow_slices(gathered(batches)):
            ids, ends = encoder.encode(texts)
            ids = np.insert(ids, ends[1:], end_id).astype(dtype)
            total += np.bincount(ids, minlength=len(total))
            sizes = np.diff(ends) + 1
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())])
            none, kind = pa.nulls(len(sizes), pa.list_(pa.int64())), batch.schema.types[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), data, none, none], names)
        if kind is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen]), pa.array([total[seen]])], names)

    names = ["id", "n", "ids", "token", "count"]
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n long, ids binary, token array<long>, count array<long>")


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(coded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; one number per id of the vocabulary reaches the driver."""
    pairs = coded.where("token is not null").select(F.explode(F.arrays_zip("token", "count")).alias("p"))
    counts = np.zeros(vocabulary, np.int64)
    for r in pairs.groupBy("p.token").agg(F.sum("p.count").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return counts


def write(df: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes token files under path; returns their manifest (file, part, docs, ids, start),
    start being the number of ids in all files before. Null ids come first; rows of one id
    follow each other in the order of a hash of their token ids, over as many files as they fill."""
    tokenizer = tokenizer or tokens.default_path()
    vocabulary = len(tokens.encoder(tokenizer).bytes)
    coded = stored(tokenised(df, tokenizer, id_col, text_col, end_id), "token-ids")
    counts = id_counts(coded, vocabulary)
    lengths = code_lengths(counts)
    codes, dtype = canonical(lengths), _dtype(vocabulary)
    files = max(1, -(-int(counts.sum()) // FILE_IDS))

    def save(batches):
        part, meta = TaskContext.get().partitionId(), {}
        name = written(f"{path}/part-{part:06d}.huf", file_chunks(batches, codes, lengths, dtype, meta))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([meta["docs"]], pa.int64()), pa.array([meta["ids"]], pa.int64())], ["file", "part", "docs", "ids"])

    # rows of one id may fill many files: they are told apart by what they hold
    docs = coded.where("n is not null").select("id", "n", "ids", F.xxhash64("ids").alias("held"))
    order = [F.col("id").asc_nulls_first(), F.col("held").asc()]
    ordered = docs.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("held")
    manifest = stored(ordered.mapInArrow(save, "file string, part long, docs long, ids long"), "token-files").where("docs > 0")
    discard(coded)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32 (and ids).
    id_type is the ids' Spark type."""
    kind = to_arrow_type(_parse_datatype_string(id_type))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                for doc, n, parts in read_file(file):
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((doc, start, n, crc, b"".join(p.astype("<u4").tobytes() for p in parts) if with_ids else None))
                    start, size = start + n, size + 4 * n
                    if size > 8 << 20:
                        yield _rows(rows, kind, with_ids)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, kind, with_ids)

    # a number of its own, or adaptive execution would put all these short rows in one task
    files = manifest.select("file", "start").repartitionByRange(max(1, manifest.count()), "start")
    return files.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)


def _rows(rows: list[tuple], id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["id", "start", "n_tokens", "ids_crc32", "ids"]
    k = 4 + with_ids
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(k)], names[:k])


def round_trip(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Encodes df's texts to files and reads them back. Null and empty texts are the end
    id alone; repeated rows are documents of their own; an empty table gives none. A text of
    any length is one document over many blocks. Further columns of df, whatever they are
    called, take no part."""
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    path = path or scratch(df.sparkSession, "tokens")
    return read(write(df, path, tokenizer, id_col, text_col, end_id), kind, id_col)
