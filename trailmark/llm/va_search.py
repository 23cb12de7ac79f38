"""Exact top-k search by inner product with vector-approximation files.

Vectors are turned into whole numbers and written in segments to the shared folder: the
approximations (a few bits per dimension, packed), the ids, and the exact vectors, each at
a fixed width. Cell borders are quantiles of a bounded sample of rows; a segment's outermost
cells end at its own least and largest values, so bounds hold for every row whatever the
sample was.

A task takes a block of queries and a group of segments. It scans the approximations for
bounds of every score, keeps what may still be among the k best, and reads exact vectors
from the file, best bound first, until the kth result is certain. Each (query, group) gives
k rows; a window keeps the k best of them. Nothing is shuffled but queries and results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import scratch, stored

K, EVERY, SCALE = 5, 50, 256.0
#: Bits of a cell number, and rows that the cell borders are fitted on.
BITS, SAMPLE = 6, 4096
#: Rows of a segment, of a block of queries, of a group of segments, and of a segment that
#: are bounded at a time.
SEGMENT, QUERIES, GROUP, CHUNK = 65_536, 1024, 1 << 18, 4096
#: Exact vectors that lie closer in the file than this are read in one go.
GAP = 1 << 14
_MOST = np.iinfo(np.int64).max


def whole_numbers(vectors: list, scale: float = SCALE) -> tuple[list[np.ndarray], np.ndarray]:
    """floor(scale * x) of each vector's components as doubles, and which vectors take part:
    those without null or non-finite components (before and after scaling)."""
    out, part = [], np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and None not in v:
            with np.errstate(over="ignore"):
                x = np.floor(np.asarray(v, np.float64) * scale)
            part[i] = np.isfinite(x).all()
            if part[i]:
                out.append(x)
    return out, part


def borders(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(dimensions, cells - 1) inner borders: quantiles, so that cells hold about as many
    sampled rows each."""
    cells = 1 << bits
    if not len(sample):
        return np.zeros((sample.shape[1], cells - 1))
    return np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="nearest").T


class Cells:
    """Cell numbers by inner borders, and each cell's least and largest value where all
    values lie between least and most."""

    def __init__(self, inner: np.ndarray, bits: int = BITS):
        self.inner, self.bits = inner, bits

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Packed cell numbers of rows of whole numbers: value v is in cell c if
        inner[c - 1] <= v < inner[c]."""
        numbers = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            numbers[:, d] = np.searchsorted(self.inner[d], x[:, d], side="right")
        spread = np.unpackbits(numbers[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(spread.reshape(len(x), -1), axis=1)

    def numbers(self, packed: np.ndarray) -> np.ndarray:
        dims = len(self.inner)
        spread = np.unpackbits(packed, axis=1)[:, : dims * self.bits].reshape(len(packed), dims, self.bits)
        return np.packbits(np.concatenate([np.zeros((*spread.shape[:2], 8 - self.bits), np.uint8), spread], 2), axis=2)[:, :, 0]

    def edges(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the cells; values are whole, so a cell ends one below its
        upper border."""
        low = np.concatenate([np.full((len(self.inner), 1), -np.inf), self.inner], 1)
        high = np.concatenate([self.inner - 1, np.full((len(self.inner), 1), np.inf)], 1)
        return np.clip(low, least[:, None], most[:, None]), np.clip(high, least[:, None], most[:, None])


def _merged(x: np.ndarray, ids: np.ndarray, null: np.ndarray, most: int):
    """Equal vectors of a segment as one row with its ``most`` smallest ids: further copies
    can't be among a query's results. Returns vectors, ids and whether each place holds an
    id (1), a null id (2) or nothing (0); nulls come last."""
    order = np.lexsort((ids, null, *x.T)) if x.shape[1] else np.lexsort((ids, null))
    x, ids, null = x[order], ids[order], null[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]).any(1)
    row = np.cumsum(first) - 1
    place = np.arange(len(x)) - np.flatnonzero(first)[row]
    held = place < most
    out, state = np.zeros((int(first.sum()), most), np.int64), np.zeros((int(first.sum()), most), np.uint8)
    out[row[held], place[held]] = ids[held]
    state[row[held], place[held]] = 1 + null[held]
    return x[first], out, state


def _write(folder: str, cells: Cells, dims: int, k: int, scale: float):
    """Writes a partition's vectors as segments; gives a row for each."""

    def segment(rows: list[np.ndarray], ids: list) -> pa.RecordBatch:
        x = np.zeros((len(rows), dims))
        for i, v in enumerate(rows):
            x[i, : len(v)] = v
        null = np.array([i is None for i in ids])
        x, own, state = _merged(x, np.array([0 if i is None else i for i in ids], np.int64), null, k + 1)
        chunks = [cells.pack(x).tobytes(), own.astype("<i8").tobytes(), state.tobytes(), x.astype("<f8").tobytes()]
        path = files.written(f"{folder}/segment-{uuid.uuid4().hex}.va", chunks)
        columns = [pa.array([path]), pa.array([len(x)], pa.int64()), pa.array([x.min(0).tolist()], pa.list_(pa.float64())), pa.array([x.max(0).tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["segment", "rows", "least", "most"])

    def run(batches):
        rows, ids = [], []
        for batch in batches:
            found, part = whole_numbers(batch.column("vector").to_pylist(), scale)
            rows += found
            ids += batch.column("id").filter(pa.array(part)).to_pylist()
            while len(rows) >= SEGMENT:
                yield segment(rows[:SEGMENT], ids[:SEGMENT])
                rows, ids = rows[SEGMENT:], ids[SEGMENT:]
        if rows:
            yield segment(rows, ids)

    return run


def _write_queries(folder: str, dims: int, scale: float):
    """Writes a partition's queries as blocks; gives a row for each."""

    def block(rows, ids):
        x = np.zeros((len(rows), dims))
        for i, v in enumerate(rows):
            x[i, : len(v)] = v
        path = files.written(f"{folder}/queries-{uuid.uuid4().hex}.va", [np.array(ids, "<i8").tobytes(), x.astype("<f8").tobytes()])
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(rows)], pa.int64())], ["block", "n"])

    def run(batches):
        rows, ids = [], []
        for batch in batches:
            found, part = whole_numbers(batch.column("vector").to_pylist(), scale)
            rows += found
            ids += batch.column("id").filter(pa.array(part)).to_pylist()
            while len(rows) >= QUERIES:
                yield block(rows[:QUERIES], ids[:QUERIES])
                rows, ids = rows[QUERIES:], ids[QUERIES:]
        if rows:
            yield block(rows, ids)

    return run


class Segment:
    """One file: packed cells, ids, their states and exact vectors, read where needed."""

    def __init__(self, path: str, rows: int, dims: int, width: int, places: int):
        self.file, self.rows, self.dims, self.width, self.places = files.opened(path), rows, dims, width, places
        self.ids_at = rows * width
        self.exact_at = self.ids_at + rows * places * 9
        self.bytes_read = 0

    def _read(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.file.read_at(size, at)

    def cells(self) -> np.ndarray:
        return np.frombuffer(self._read(0, self.rows * self.width), np.uint8).reshape(self.rows, self.width)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.rows * self.places
        raw = self._read(self.ids_at, n * 9)
        return np.frombuffer(raw, "<i8", n).reshape(-1, self.places), np.frombuffer(raw, np.uint8, n, 8 * n).reshape(-1, self.places)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Exact vectors of ascending rows."""
        size = 8 * self.dims
        if not size or not len(rows):
            return np.zeros((len(rows), self.dims))
        out = np.empty((len(rows), self.dims))
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows) * size > GAP) + 1):
            a, b = int(rows[part[0]]), int(rows[part[-1]]) + 1
            out[part] = np.frombuffer(self._read(self.exact_at + a * size, (b - a) * size), "<f8").reshape(-1, self.dims)[rows[part] - a]
        return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows of whole numbers; beyond a long's range the
    nearest long."""
    with np.errstate(over="ignore"):
        far = (np.abs(q) * np.abs(x)).sum(1) >= 2.0**53
        out = np.where(far, 0, (q * x).sum(1)).astype(np.int64)
    for i in np.flatnonzero(far):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], x[i]))
        out[i] = min(max(exact, -_MOST - 1), _MOST)
    return out


def bounds(q: np.ndarray, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries, rows) of the inner products."""
    d = np.arange(len(low))
    lo, hi = low[d, numbers], high[d, numbers]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        # sums of doubles may be off by a little; bounds give way by more than that
        slack = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).max(1))[:, None] * (len(low) + 2) * 2.0**-51
        least, most = up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def _group_best(ids: np.ndarray, q: np.ndarray, segments: list[tuple[Segment, Cells, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k best rows of a group of segments: (query, score, id, null)."""
    n = len(q)
    kth = np.full((n, k), -np.inf)  # the k largest lower bounds so far
    held: list[tuple[np.ndarray, ...]] = []  # (query, segment, row, upper bound)
    known = []
    for s, (segment, cells, least, most) in enumerate(segments):
        own, state = segment.ids()
        known.append((own, state))
        packed, (low, high) = segment.cells(), cells.edges(least, most)
        for a in range(0, segment.rows, CHUNK):
            lower, upper = bounds(q, cells.numbers(packed[a : a + CHUNK]), low, high)
            # a row whose ids are all the query's own is no candidate
            part, there = own[a : a + CHUNK], state[a : a + CHUNK]
            for r in np.flatnonzero((np.isin(part, ids) & (there == 1)).any(1)):
                for j in np.flatnonzero(np.isin(ids, part[r][there[r] == 1])):
                    if not ((there[r] == 2) | (there[r] == 1) & (part[r] != ids[j])).any():
                        lower[j, r] = upper[j, r] = -np.inf
            best = np.concatenate([kth, lower], 1)
            kth = np.partition(best, -k, axis=1)[:, -k:]
            of, row = np.nonzero((upper >= kth.min(1)[:, None]) & (upper > -np.inf))
            held.append((of, np.full(len(of), s), row + a, upper[of, row]))
        if sum(len(h[0]) for h in held) > 4 * CHUNK:  # drop what the better bounds rule out
            held = [_still(held, kth.min(1))]
    of, seg, row, upper = _still(held, kth.min(1)) if held else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((-upper, of))
    of, seg, row, upper = of[order], seg[order], row[order], upper[order]
    begin = np.searchsorted(of, np.arange(n + 1))
    results: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]
    at, step = begin[:-1].copy(), k
    while (open_ := np.flatnonzero(at < begin[1:])).size:
        # each open query's next candidates, best upper bound first
        take = np.concatenate([np.arange(at[i], min(at[i] + step, begin[i + 1])) for i in open_])
        at[open_] = np.minimum(at[open_] + step, begin[1:][open_])
        step = min(2 * step, 256)
        for s in np.unique(seg[take]):
            mine = take[seg[take] == s]
            rows, where = np.unique(row[mine], return_inverse=True)
            exact = segments[s][0].exact(rows)
            for a in range(0, len(mine), CHUNK):
                part = mine[a : a + CHUNK]
                scores = _scores(q[of[part]], exact[where[a : a + CHUNK]])
                own, state = known[s]
                for i, score, r in zip(of[part].tolist(), scores.tolist(), row[part]):
                    results[i] += [(-score, bool(t == 2), int(v)) for v, t in zip(own[r], state[r]) if t == 2 or t == 1 and v != ids[i]]
        for i in open_:
            results[i] = sorted(results[i])[:k]
            # certain: no bound left reaches the kth score (ties may have smaller ids)
            if len(results[i]) == k and at[i] < begin[i + 1] and upper[at[i]] < -results[i][-1][0]:
                at[i] = begin[i + 1]
    for i, found in enumerate(results):
        if found:
            score, null, own = zip(*found)
            yield i, np.array([-v for v in score], np.int64), np.array(own, np.int64), np.array(null)


def _still(held, least: np.ndarray):
    of, seg, row, upper = (np.concatenate(x) for x in zip(*held))
    keep = upper >= least[of]
    return of[keep], seg[keep], row[keep], upper[keep]


def _search(inner: np.ndarray, bits: int, k: int):
    """(query block, group of segments) to each query's k best rows of the group."""

    def run(batches):
        cells, dims = Cells(inner, bits), len(inner)
        width = -(-dims * bits // 8)
        for batch in batches:
            for r in batch.to_pylist():
                raw = files.opened(r["block"]).read()
                ids = np.frombuffer(raw, "<i8", r["n"])
                q = np.frombuffer(raw, "<f8", r["n"] * dims, 8 * r["n"]).reshape(r["n"], dims)
                segments = [(Segment(s["segment"], s["rows"], dims, width, k + 1), cells, np.array(s["least"]), np.array(s["most"])) for s in r["segments"]]
                out = list(_group_best(ids, q, segments, k))
                if out:
                    many = [len(x[1]) for x in out]
                    which = np.repeat([x[0] for x in out], many)
                    columns = [pa.array([f"{r['block']}#{i}" for i in which]), pa.array(ids[which]), pa.array(np.concatenate([x[2] for x in out]), mask=np.concatenate([x[3] for x in out])), pa.array(np.concatenate([x[1] for x in out]))]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "found", "score"])

    return run


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: float = SCALE, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), the found row's id (under ``id_col``), score: for each row whose
    id is divisible by ``every`` the k rows of all others with the highest inner products of
    floor(scale * x), ties to the smaller id, a null id last.

    Vectors that are null or hold null or non-finite components take no part, neither as
    queries nor as rows found. An empty table gives no row; fewer than k candidates are all
    given. Vectors of different lengths are compared as if the shorter had zeros at its end.
    Rows with the query's own id are its own and not found. Equal rows among the queries are
    one query; rows of one id with different vectors are each a query. Repeated rows are found
    as often as they are there. A row with a null id can be found, but is no query. A score
    beyond the range of a long is the nearest long. Other columns are not read, whatever their
    names.

    The ``sample`` rows that fit the cell borders, those with the least hashes, go to the
    driver; they shape how many exact vectors are read, never the result.
    """
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    chosen = rows.orderBy(F.xxhash64("vector", "id"), "id").limit(sample).select("vector").collect()
    fitted = np.zeros((len(chosen), dims))
    for i, r in enumerate(chosen):
        with np.errstate(over="ignore"):
            fitted[i, : len(r[0])] = np.nan_to_num(np.floor(np.asarray(r[0]) * scale))
    inner = borders(fitted, bits)
    folder = scratch(spark, "va")
    segments = stored(rows.mapInArrow(_write(folder, Cells(inner, bits), dims, k, scale), "segment string, rows long, least array<double>, most array<double>"), "segments")
    asked = rows.where(F.col("id") % every == 0).distinct()
    many = stored(asked, "asked")
    blocks = many.coalesce(max(1, -(-many.count() // QUERIES)))
    blocks = stored(blocks.mapInArrow(_write_queries(folder, dims, scale), "block string, n long"), "blocks")
    # groups of segments: none beyond GROUP rows, unless one segment is, and enough for all cores
    total, cores = segments.agg(F.sum("rows"), F.count(F.lit(1))).first(), spark.sparkContext.defaultParallelism
    if not total[1]:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    groups = min(total[1], max(-(-total[0] // GROUP), -(-3 * cores // max(1, blocks.count()))))
    dealt = segments.withColumn("group", F.pmod(F.xxhash64("segment"), F.lit(groups)))
    dealt = dealt.groupBy("group").agg(F.collect_list(F.struct("segment", "rows", "least", "most")).alias("segments"))
    tasks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(dealt, "group").repartition(4 * cores, "block", "group")
    found = tasks.select("block", "n", "segments").mapInArrow(_search(inner, bits, k), "query string, query_id long, found long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("found").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score")
