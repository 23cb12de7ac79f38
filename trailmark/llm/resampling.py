"""Importance resampling towards a target distribution, on hashed word n-grams.

Identical texts are collapsed by grouping the full text. Each different text is turned
into feature buckets once; bucket totals are the sums over different texts times their
multiplicity, and a weight is computed once per different text. Weights go back to the
documents by the text's digest before each document's own noise is added. What reaches
the driver is one number per bucket.

Buckets are CRC-32 values of n-grams. CRC-32 is linear, so an n-gram's value follows from
its words' values by table look-ups over whole arrays, and no n-gram is ever spelt out.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, gathered, stored

BUCKETS, NGRAM, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, "42"
#: Rows that a range of the ranking holds, about.
RANK_ROWS = 200_000
#: Bytes of text that are hashed at a time.
SLICE = 2 << 20

#: Words are runs of ASCII letters and digits and of anything beyond ASCII: for each byte,
#: what it becomes in lower case, and whether it is part of a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])

#: What appending so many zero bytes does to a CRC-32 is kept for lengths up to this one.
_SHIFTS = 64


def _shift_table(bits: list[int]) -> np.ndarray:
    """Four tables of 256 that apply a linear map of 32 bits, given by its columns."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(bits[8 * byte + bit])
    return out


@functools.cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables for 0 to _SHIFTS zero bytes, and for 64 << k zero bytes."""

    def apply(table, x: int) -> int:
        return int(table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24])

    empty = zlib.crc32(b"")
    one = _shift_table([zlib.crc32(b"\0", 1 << k ^ empty) ^ zlib.crc32(b"\0", empty) for k in range(32)])
    small = [_shift_table([1 << k for k in range(32)])]
    for _ in range(_SHIFTS):
        small.append(_shift_table([apply(one, apply(small[-1], 1 << k)) for k in range(32)]))
    large = [small[_SHIFTS]]
    for _ in range(30):
        large.append(_shift_table([apply(large[-1], apply(large[-1], 1 << k)) for k in range(32)]))
    return np.array(small), np.array(large)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a joined string's CRC-32 that its first half, with this value, has when
    so many bytes follow; the second half's value is to be added (exclusive or)."""
    small, large = _shifts()
    flat, low = small.reshape(-1), (length & (_SHIFTS - 1)).astype(np.int64) << 10
    out = flat[low + (crc & 255)]
    for byte in (1, 2, 3):
        out ^= flat[low + (byte << 8) + (crc >> np.uint32(8 * byte) & 255)]
    rest, k = length // _SHIFTS, 0
    while (at := np.flatnonzero(rest >> k)).size:
        at = at[rest[at] >> k & 1 == 1]
        x, table = out[at], large[k]
        out[at] = table[0, x & 255] ^ table[1, x >> np.uint32(8) & 255] ^ table[2, x >> np.uint32(16) & 255] ^ table[3, x >> np.uint32(24)]
        k += 1
    return out


def word_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32, bytes) of every word of an Arrow array of strings without nulls, and the
    text that each is of."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[ends[:-1][ends[:-1] < len(raw)]] |= inside[ends[:-1][ends[:-1] < len(raw)]]  # a text begins a word
    starts = np.flatnonzero(first)
    kept = np.cumsum(inside, dtype=np.int64)
    begin = kept[starts] - 1
    total = int(kept[-1]) if len(raw) else 0
    bounds = np.append(begin, total)
    letters = _LOWER[raw[inside]]
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    crcs = np.fromiter(map(zlib.crc32, words.dictionary.to_pylist()), np.uint32, len(words.dictionary))
    return crcs[words.indices.to_numpy()], np.diff(bounds), np.searchsorted(ends, starts, side="right") - 1


def buckets(texts: pa.Array, n_buckets: int = BUCKETS, longest: int = NGRAM) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's buckets, one for each occurrence of a run of 1 to longest words, and its
    number of words."""
    crc, size, of = word_arrays(texts)
    words = np.bincount(of, minlength=len(texts))
    spaced = shifted(crc, np.ones(len(crc), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    parts, owners, runs = [crc % np.uint32(n_buckets)], [of], spaced
    for k in range(1, longest):
        # runs[i] is the value of words i to i + k - 1, each with a space after it
        whole = slice(0, max(0, len(crc) - k))
        same = of[whole] == of[k:]
        now = runs[whole]
        parts.append((shifted(now, size[k:]) ^ crc[k:])[same] % np.uint32(n_buckets))
        owners.append(of[k:][same])
        runs = shifted(now, size[k:] + 1) ^ spaced[k:]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32
    found = np.concatenate(parts).astype(kind)[order]
    return np.split(found, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]), words


def _featured(n_buckets: int, longest: int):
    def run(batches):
        for batch, texts in arrow_slices(gathered(batches, SLICE), limit=SLICE):
            found, words = buckets(texts, n_buckets, longest)
            columns = [batch.column("key"), batch.column("n"), pa.array(words, pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "n_words", "features"])

    return run


def features(df: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS, longest: int = NGRAM) -> DataFrame:
    """One row per different text: key (its SHA-256), n (documents with it), n_words,
    features (unsigned buckets in native byte order). Null counts as the empty text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    alike = df.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return alike.select(F.unhex(F.sha2("text", 256)).alias("key"), "n", "text").mapInArrow(_featured(n_buckets, longest), "key binary, n long, n_words long, features binary")


def totals(featured: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs, multiplicities counted: one number per bucket. A task
    gives a row for each bucket, so there are only about as many tasks as keep all cores
    busy, or as read 64 of the table's partitions each."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def add(batches):
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for n, own in zip(batch.column("n").to_pylist(), batch.column("features")):
                sums += n * np.bincount(np.frombuffer(own.as_buffer(), kind), minlength=n_buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "total"])

    out = np.zeros(n_buckets, np.int64)
    tasks = max(3 * featured.sparkSession.sparkContext.defaultParallelism, featured.rdd.getNumPartitions() // 64)
    for r in featured.select("n", "features").coalesce(tasks).mapInArrow(add, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total")).collect():
        out[r["bucket"]] = r["total"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and raw shares, rounded down."""
    many, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + many) / ((float(a) + 1) * (t + many)))) for a, b in zip(raw, target)], np.int64)


def weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features, weight of each different text."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def weigh(batches):
        for batch in batches:
            own = [np.frombuffer(f.as_buffer(), kind) for f in batch.column("features")]
            columns = [batch.column("key"), batch.column("n_words"), pa.array([len(f) for f in own], pa.int64()), pa.array([int(gain[f].sum()) for f in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_features", "weight"])

    return featured.select("key", "n_words", "features").mapInArrow(weigh, "key binary, n_words long, n_features long, weight long")


def noise(doc_id, seed: str = SEED):
    """A document's Gumbel noise in thousandths, rounded down, from its id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, most: int) -> DataFrame:
    """Rows with rank, 1 for the highest score; ties by id, then key. Dealt by range, so
    that a rank is a range's offset and a position in it."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("key")]
    ranges = max(1, -(-most // RANK_ROWS))
    # rows alike in all of it are dealt apart, so that a repeated id isn't one range
    dealt = scored.withColumn("_apart", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_apart")
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a range
    within = Window.partitionBy("_range").orderBy(*order, "_apart")
    return dealt.withColumn("_at", F.row_number().over(within)).join(starts, "_range").withColumn("rank", (F.col("_start") + F.col("_at")).cast("long"))


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
    min_words: int = MIN_WORDS, n_buckets: int = BUCKETS, longest: int = NGRAM, seed: str = SEED,
) -> DataFrame:
    """One row per document: its id, n_features, weight, score, rank (1 for the first drawn,
    null for those not drawn).

    Texts are lower-cased (A-Z only) and cut into words; features are all runs of 1 to
    ``longest`` words. Of the N documents with ``min_words`` words or more the
    ``percent * N // 100`` with the highest scores are drawn, ties to the smaller id.

    Null and empty texts have no feature and weight 0. An empty table gives no row; an empty
    target favours features that are rare here. Repeated rows count each
    for itself and get one noise per id, so among rows of one id and score the ranks are dealt
    by the text's digest and then at will. A null id has the noise of the empty id and comes
    last among ties. A long text is one row of buckets, two bytes for each feature. Other
    columns are not read, whatever their names.
    """
    # what is stored is a text's features, made once; they serve totals and weights
    featured = stored(features(df, text_col, n_buckets, longest), "features")
    gain = gains(totals(featured, n_buckets), totals(features(target, target_col, n_buckets, longest), n_buckets))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).alias("key"))
    scored = docs.join(weights(featured, gain), "key").withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = stored(scored.select("id", "key", "n_words", "n_features", "weight", "score"), "scored")
    enough = F.col("n_words") >= min_words
    many = scored.where(enough).count()
    drawn = percent * many // 100
    columns = ["id", "n_features", "weight", "score", "rank"]
    ranked = _ranked(scored.where(enough), many).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.select(*columns).union(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))
    return out.withColumnRenamed("id", id_col)
