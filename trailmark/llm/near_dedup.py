"""Near-duplicates on word shingles by an LSH forest, each link confirmed on full sets.

Documents with equal shingle sets form classes; one row per class goes on. Its MinHash
signature gives TREES sort keys of VALUES values. Each sorted order is dealt by range, so
that a region of any size is spread over tasks. Rows that share ``depth`` values in an
order are candidates; depth follows from the similarity asked for, so that all orders miss
a pair at the threshold about once in a million times. Most rows share depth values with no
other one. That is found out first, from a hash and a number a row and order; the others'
signatures and sketches alone are dealt.

Candidates come in three rounds. The first takes only next neighbours in a few orders; its
confirmed links already join most groups of copies. The second takes WINDOW neighbours in
all orders, those with the longest common prefixes, but only pairs that aren't connected
yet, so a group of many copies costs a few comparisons a row and not the square of its
size. That searches every region of at most WINDOW + 1 rows to the end. The third finishes
more crowded regions in blocks of rows with their full sets, and adapts its depth to them:
in a region of many blocks it descends to the parts that share all VALUES values and comes
up level by level to ``depth``. What has been joined needn't be compared
again: all rows outside a region's largest connected part are held against all others. So no candidate is left out. Candidates must pass a length test
that is exact and a sketch test that a pair at the threshold fails once in a hundred
thousand times before full sets are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, each_slice, gathered, stored
from .components import components

SHINGLE = 5
PERCENT = 85
TREES, VALUES = 24, 8
FIRST_TREES, WINDOW, NEAREST = 8, 16, 4
#: How often at most all orders may miss a pair at the threshold, and the sketch test.
MISS_ORDERS, MISS_SKETCH = 5e-6, 1e-5
#: Bits of a MinHash value in the sketch: with fewer, unlike values often look alike.
BITS = 4
ROWS_PER_TASK = 100_000
#: The same of rows of two numbers.
REGIONS_PER_TASK = 500_000
#: Rows of a crowded region, and shingles in them, that are held against as many others
#: in one task. Deeper levels send each row once or twice more, which pays in regions of
#: more than DESCEND blocks.
CROWD_BLOCK, CROWD_SHINGLES, DESCEND = 2048, 2_000_000, 8
CROWD_ROWS_PER_FILE = 500_000
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
#: Ids (16 bytes each) that are sent to all executors at most, to filter the texts by.
MAX_BROADCAST = 1_000_000
_HASHES = TREES * VALUES
_U = np.uint64
_FOLD = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHINGLE)]


@dataclass(frozen=True)
class Forest:
    """What a similarity threshold in percent asks of the orders and sketches."""

    percent: int
    depth: int
    least: int

    @classmethod
    def of(cls, percent: int) -> Forest:
        p = percent / 100
        depth = max(d for d in range(1, VALUES + 1) if d == 1 or (1 - p**d) ** TREES <= MISS_ORDERS)
        # of the sketch's positions a pair shares each with chance q, by accident too
        q, below, least = p + (1 - p) / (1 << BITS), 0.0, 0
        while (below := below + math.comb(_HASHES, least) * q**least * (1 - q) ** (_HASHES - least)) <= MISS_SKETCH:
            least += 1
        return cls(percent, depth, least)

    def levels(self) -> list[int]:
        """Depths that a crowded region is searched at, deepest first."""
        return sorted({VALUES, (VALUES + self.depth) // 2, self.depth}, reverse=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """64-bit hashes of word shingles, for many texts at once."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's distinct shingles, sorted. Fewer words than a shingle has count as
        one shingle, no words as none."""
        data = [t.encode() for t in texts]
        raw = np.frombuffer(b" ".join(data).translate(_FOLD) + b" ", np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = _powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 1 << 64), len(raw))
        gap = raw == 32
        before = np.concatenate([[True], gap[:-1]])
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * self.up[: len(raw)], dtype=np.uint64)])
        words = _mix((sums[ends] - sums[starts]) * self.down[starts])
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in data]))
        n = max(0, len(words) - SHINGLE + 1)
        runs = np.zeros(n, np.uint64)
        for k, c in enumerate(_STEP):
            runs += words[k : k + n] * _U(c)
        runs = _mix(runs)
        out = []
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(_mix(np.array([sum(int(w) * c for w, c in zip(words[a:b], _STEP)) + int(b - a) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set."""
    with np.errstate(over="ignore"):
        return tuple(np.array([np.add.reduce(_mix(s + _U(salt)), dtype=np.uint64) for s in sets], np.uint64).astype(np.int64) for salt in (1, 0x5851F42D4C957F2D))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of each MinHash value (big-endian), and a packed sketch of BITS more of each.
    Empty sets get zeros."""
    rng = np.random.default_rng(20)
    flips = rng.integers(0, 1 << 32, _HASHES, np.uint32)
    odds = rng.integers(0, 1 << 32, _HASHES, np.uint32) | np.uint32(1)
    full = [i for i, s in enumerate(sets) if len(s)]
    values = np.zeros((len(sets), _HASHES), ">u2")
    nibbles = np.zeros((len(sets), _HASHES), np.uint8)
    if full:
        x = (np.concatenate([sets[i] for i in full]) >> _U(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(_HASHES):
            low = np.minimum.reduceat((x ^ flips[k]) * odds[k], at) * np.uint32(0x9E3779B1)
            values[full, k] = low >> np.uint32(16)
            nibbles[full, k] = low >> np.uint32(16 - BITS) & np.uint32((1 << BITS) - 1)
    return values, nibbles[:, ::2] << BITS | nibbles[:, 1::2]


# ---- stages


def _features(batches):
    shingler = Shingler()
    for batch, texts in each_slice(batches, limit=SLICE):
        sets = shingler.sets(texts)
        hi, lo = set_keys(sets)
        values, sketch = signatures(sets)
        columns = [*(batch.column(c) for c in ("id", "key1", "key2")), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo), pa.array([v.tobytes() for v in values], pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "key1", "key2", "n", "hi", "lo", "signature", "sketch"])


_ROW = "tree int, key binary, node long, part long, n long, sketch binary"
_NEAR = f"a long, b long, boundary int, tail boolean, {_ROW}"


def _close(tree, key, part, n, sketch, window: int, forest: Forest) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + j), j up to window, that may be linked; in crowded regions, which
    the third round finishes, j up to NEAREST."""
    region = np.cumsum(_starts(tree, key, forest.depth))
    crowded = np.bincount(region)[region] > window + 1 if len(region) else np.zeros(0, bool)
    out = []
    for j in range(1, min(window, len(tree) - 1) + 1):
        near = (region[j:] == region[:-j]) & (part[j:] != part[:-j]) & _like_sized(n[j:], n[:-j], forest.percent)
        i = np.flatnonzero(near & ~crowded[j:]) if j > NEAREST else np.flatnonzero(near)
        i = i[_alike(sketch[i], sketch[i + j], forest.least)]
        out.append((i, i + j))
    return out


def _starts(tree, key, depth: int) -> np.ndarray:
    """Where rows begin that share a tree and depth values with the row before no more."""
    first = np.zeros(len(tree), bool)
    first[1:] = (tree[1:] != tree[:-1]) | (key[1:, : 2 * depth] != key[:-1, : 2 * depth]).any(1)
    return first


def _like_sized(n, m, ratio: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= ratio * np.maximum(n, m)


def _alike(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    z = x ^ y
    z |= z >> 2
    return _HASHES - np.bitwise_count((z | z >> 1) & 0x11).sum(1, dtype=np.int64) >= least


def _arrays(batch: pa.RecordBatch):
    m = len(batch)
    blob = lambda name, w: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(m, w)
    return batch.column("tree").to_numpy(), blob("key", 2 * VALUES), batch.column("part").to_numpy(), batch.column("n").to_numpy(), blob("sketch", _HASHES * BITS // 8)


def _neighbours(window: int, forest: Forest):
    """Candidates within a task's stretch of the orders, and its first and last rows for
    the stretches before and after."""

    def pairs(batch: pa.RecordBatch, fresh: int):
        node = batch.column("node").to_numpy()
        found = [(node[i], node[j]) for i, j in ((i[j >= fresh], j[j >= fresh]) for i, j in _close(*_arrays(batch), window, forest))]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        a, b = np.minimum(a, b), np.maximum(a, b)
        ab = np.unique(np.stack([a, b], 1), axis=0)
        return pa.table({"a": ab[:, 0], "b": ab[:, 1]})

    def crowds(batch: pa.RecordBatch):
        """Rows and least and largest part of each region that the window doesn't span,
        or of which the batch may hold only a part."""
        tree, key, part, _, _ = _arrays(batch)
        at = np.concatenate([[0], np.flatnonzero(_starts(tree, key, forest.depth))])
        size = np.diff(at, append=len(tree))
        least, most = np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)
        show = (size > window + 1) & (least != most)
        show[[0, -1]] = True
        keys = pa.array([k[: 2 * forest.depth].tobytes() for k in key[at[show]]], pa.binary())
        return pa.table({"a": least[show], "b": most[show], "tree": pa.array(tree[at[show]], pa.int32()), "key": keys, "n": pa.array(size[show], pa.int64())})

    def edge(rows: pa.Table, boundary: int, tail: bool):
        k = len(rows)
        return rows.append_column("boundary", pa.array([boundary] * k, pa.int32())).append_column("tail", pa.array([tail] * k))

    names = ["a", "b", "boundary", "tail", "tree", "key", "node", "part", "n", "sketch"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def shaped(t: pa.Table):
        columns = [t.column(c).cast(k) if c in t.column_names else pa.nulls(len(t), k) for c, k in zip(names, kinds)]
        return pa.table(columns, names=names).combine_chunks().to_batches()

    def run(batches):
        part, held, head = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            if window > 1:
                yield from shaped(crowds(batch))
            if head < window:
                first = now.slice(0, window - head)
                head += len(first)
                yield from shaped(edge(first, part - 1, False))
            fresh = len(held) if held is not None else 0
            now = pa.concat_tables([held, now]) if held is not None else now
            whole = now.combine_chunks().to_batches()[0]
            yield from shaped(pairs(whole, fresh))
            held = now.slice(max(0, len(now) - window))
        if held is not None:
            yield from shaped(edge(held, part, True))

    return run


def _across(window: int, forest: Forest):
    """Candidates between the end of one stretch and the start of the next."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tail", "descending"), ("tree", "ascending"), ("key", "ascending"), ("node", "ascending")])
        node, tails = t.column("node").to_numpy(), int(np.sum(t.column("tail").to_numpy(zero_copy_only=False)))
        found = _close(*_arrays(t.combine_chunks().to_batches()[0]), window, forest) if len(t) else []
        ab = [(min(node[x], node[y]), max(node[x], node[y])) for i, j in found for x, y in zip(i, j) if x < tails <= y]
        return pa.table({"a": pa.array([x for x, _ in ab], pa.int64()), "b": pa.array([y for _, y in ab], pa.int64())})

    return run


def _companions(batches):
    """node, and the bit of the order, of rows whose region the row before or after has too.
    The first and last rows at hand stay, since theirs may go on elsewhere."""
    for batch in gathered(batches):
        if not len(batch):
            continue
        region = batch.column("region").to_numpy()
        same, edge = region[1:] == region[:-1], np.ones(1, bool)
        shared = np.concatenate([edge, same]) | np.concatenate([same, edge])
        bits = np.left_shift(1, region[shared] & 31).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(shared)), pa.array(bits)], ["node", "trees"])


def sharing(classes: DataFrame, forest: Forest) -> DataFrame:
    """(node, trees) of the classes (node, signature) that share depth values of an order with
    another class; trees has a bit for each such order. Few classes and bits more may come
    along, none is left out."""
    wide = classes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature", "node")
    # the order's number takes the place of a hash's last five bits
    rows = wide.select(F.expr(f"(xxhash64(substring(signature, tree * {2 * VALUES} + 1, {2 * forest.depth})) & -32L) | tree").alias("region"), "node")
    tasks = max(1, -(-classes.count() * TREES // REGIONS_PER_TASK))
    dealt = rows.repartitionByRange(tasks, "region", "node").sortWithinPartitions("region")
    return dealt.mapInArrow(_companions, "node long, trees int").groupBy("node").agg(F.bit_or("trees").alias("trees"))


def _orders(classes: DataFrame, trees: int, values: int, columns: list[str]) -> DataFrame:
    """A row (tree, key, columns) for each of the first trees orders that a class's bits name."""
    named = F.expr(f"filter(sequence(0, {trees - 1}), t -> getbit(trees, t) = 1)")
    wide = classes.select(F.explode(named).alias("tree"), "signature", *columns)
    return wide.select("tree", F.expr(f"substring(signature, tree * {2 * VALUES} + 1, {2 * values})").alias("key"), *columns)


def candidates(classes: DataFrame, trees: int, window: int, forest: Forest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of classes (node, part, n, signature, sketch, trees) that
    lie near each other in one of the first trees orders and not in one part; the regions
    (tree, key) of more rows than the window reaches that aren't all one part; and the
    stored table that both read."""
    rows = _orders(classes, trees, VALUES, ["node", "part", "n", "sketch"])
    dealt = classes.agg(F.sum(F.expr(f"bit_count(trees & {(1 << trees) - 1})"))).first()[0] or 0
    tasks = max(1, -(-dealt // ROWS_PER_TASK))
    order = rows.repartitionByRange(tasks, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    near = stored(order.mapInArrow(_neighbours(window, forest), _NEAR), "forest")
    inside = near.where("a is not null and tree is null").select("a", "b")
    runs = near.where("a is not null and tree is not null").groupBy("tree", "key")
    runs = runs.agg(F.sum("n").alias("n"), F.min("a").alias("least"), F.max("b").alias("most"))
    crowded = runs.where(f"n > {window + 1} and least <> most").select("tree", "key")
    edges = near.where("a is null").select("boundary", "tail", "tree", "key", "node", "part", "n", "sketch")
    across = edges.groupBy("boundary").applyInArrow(_across(window, forest), "a long, b long")
    return inside.union(across).distinct(), crowded, near


def shingle_sets(ends: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the classes whose nodes are in ends, made again from a text. A row
    of docs (id, key1, key2, text) meets the one class of its text at most, however many rows
    share its id, and of rows alike one is worked on."""
    wanted = stored(classes.join(ends, "node", "left_semi").select("node", "first", "key1", "key2"), "wanted")
    small = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    same = (docs["key1"] == wanted["key1"]) & (docs["key2"] == wanted["key2"]) & docs["id"].eqNullSafe(wanted["first"])
    texts = docs.join(small, same).select("node", "text").dropDuplicates(["node"])

    def shingle(batches):
        shingler = Shingler()
        for batch, own in each_slice(batches, limit=SLICE):
            sets = shingler.sets(own)
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, values)], ["node", "shingles"])

    out = stored(texts.mapInArrow(shingle, "node long, shingles array<long>"), "shingles")
    discard(wanted)
    return out


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs whose full shingle sets are similar enough: (a, b); and the stored tables
    that they are read from."""
    pairs = stored(pairs, "pairs")
    sets = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), classes, docs)
    left = pairs.join(sets.withColumnRenamed("node", "a"), "a").withColumnRenamed("shingles", "x")
    both = left.join(sets.withColumnRenamed("node", "b"), "b").withColumnRenamed("shingles", "y")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(f"100 * common >= {percent} * (size(x) + size(y) - common)").select("a", "b"), [pairs, sets]


def _blockwise(forest: Forest, depth: int):
    """The links between two blocks of a crowded region, or within one."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        tree, _, kind, x, y = (k.as_py() for k in key)
        node, part, n, main, block = (t.column(c).to_numpy() for c in ("node", "part", "n", "is_main", "block"))
        blob = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(len(t), -1)
        sketch, before = blob("sketch"), blob("signature").reshape(len(t), TREES, -1)[:, :tree, : 2 * depth]
        sets = t.column("shingles").chunk(0)
        at, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
        left = np.flatnonzero(~main & (block == x))
        right = np.flatnonzero(main) if kind == 0 else np.flatnonzero(block == y)
        a, b = [], []
        for k, i in enumerate(left):
            j = right[k + 1 :] if kind and x == y else right
            j = j[(part[j] != part[i]) & _like_sized(n[j], n[i], forest.percent)]
            j = j[_alike(sketch[j], sketch[i], forest.least)]
            j = j[~(before[j] == before[i]).all(2).any(1)]  # else an earlier order has the pair
            if not len(j):
                continue
            own, ends = np.sort(values[at[i] : at[i + 1]]), np.cumsum(n[j])
            theirs = values[np.arange(ends[-1]) + np.repeat(at[j] - ends + n[j], n[j])]
            spot = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.add.reduceat((own[spot] == theirs).astype(np.int64), ends - n[j])
            linked = j[100 * common >= forest.percent * (n[i] + n[j] - common)]
            a += [node[i]] * len(linked)
            b += node[linked].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def crowd_links(rows: DataFrame, sets: DataFrame, classes: DataFrame, forest: Forest, depth: int) -> tuple[DataFrame, list[DataFrame]] | None:
    """Links (a, b) between classes of different parts among rows (tree, key, node, n) of
    crowded regions that share depth values, and the stored table that they are read from;
    None where no region is open there. sets holds the rows' shingles.

    A region's largest part needn't be compared with itself, so a group of copies costs
    its size times the few rows beside it. A task holds two blocks, whatever the region's
    size, and only links leave it.
    """
    files = 1 + rows.count() // CROWD_ROWS_PER_FILE
    rows = rows.withColumn("key", F.expr(f"substring(key, 1, {2 * depth})")).join(classes.select("node", "part"), "node")
    sizes = rows.groupBy("tree", "key", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("tree", "key").agg(F.max(F.struct("rows", "part", "n")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / CROWD_BLOCK), F.ceil(n / CROWD_SHINGLES)).cast("int")
    mains, others = blocks(F.col("main.rows"), F.col("main.n")), blocks(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n"))
    sizes = sizes.where(f"rows > {WINDOW + 1} and rows > main.rows").select("tree", "key", F.col("main.part").alias("main"), mains.alias("mains"), others.alias("others"))
    dealt = rows.select("tree", "key", "node", "part").join(sizes, ["tree", "key"]).withColumn("is_main", F.expr("part = main"))
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(node), if(is_main, mains, others)) as int)"))
    dealt = stored(dealt.coalesce(files), "dealt")
    if dealt.isEmpty():
        discard(dealt)
        return None
    met = F.expr("""if(is_main, transform(sequence(0, others - 1), k -> struct(0 as kind, k as x, block as y)),
        concat(transform(sequence(0, mains - 1), k -> struct(0 as kind, block as x, k as y)),
               transform(sequence(0, others - 1), k -> struct(1 as kind, least(block, k) as x, greatest(block, k) as y))))""")
    held = ["node", "part", "is_main", "block"]
    sent = dealt.select("tree", "key", F.explode(met).alias("t"), *held).select("tree", "key", "t.*", *held)
    sent = sent.join(classes.select("node", "n", "sketch", "signature"), "node").join(sets, "node")
    return sent.groupBy("tree", "key", "kind", "x", "y").applyInArrow(_blockwise(forest, depth), "a long, b long"), [dealt]


def _uncrowded(classes: DataFrame, regions: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """classes with the parts joined that links within crowded regions connect, searched
    from the deepest level up. The rows' shingles are made once for all levels."""
    regions = F.broadcast(regions) if regions.count() <= MAX_BROADCAST else regions
    orders = _orders(classes, TREES, VALUES, ["node", "n", "part"]).withColumnRenamed("key", "whole")
    rows = orders.withColumn("key", F.expr(f"substring(whole, 1, {2 * forest.depth})")).join(regions, ["tree", "key"])
    still = rows.groupBy("tree", "key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("rows"))
    still = still.where("least <> most").select("tree", "key", F.expr(f"rows > {DESCEND * CROWD_BLOCK}").alias("large"))
    rows = stored(rows.join(still, ["tree", "key"]).select("tree", F.col("whole").alias("key"), "node", "n", "large"), "crowds")
    if rows.isEmpty():
        discard(rows)
        return classes
    sets = shingle_sets(rows.select("node").distinct(), classes, docs)
    large = rows.where("large")
    for depth in forest.levels() if not large.isEmpty() else [forest.depth]:
        found = crowd_links(rows if depth == forest.depth else large, sets, classes, forest, depth)
        if found:
            classes = _joined(classes, *found)
    discard(rows, sets)
    return classes


def _joined(classes: DataFrame, links: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """classes with the parts that links (a, b) between their nodes join made one; spent
    tables have then been read for the last time."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    between = stored(between.distinct(), "links")
    discard(*spent)
    if between.isEmpty():
        discard(between)
        return classes
    roots = components(between).select(F.col("node").alias("part"), "root")
    new = classes.join(roots, "part", "left").withColumn("part", F.coalesce("root", "part")).select(*classes.columns)
    out = stored(new, "parts")
    discard(between, classes)
    return out


def _members(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per row: id, key1, key2 (two hashes of the text, null apart from empty), n,
    part (null where n is 0) and component_id."""
    forest, text = Forest.of(percent), F.col(f"`{text_col}`")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.select("id", "text", *_text_keys(F.col("text")))
    made = stored(keyed.mapInArrow(_features, f"id {kind}, key1 long, key2 long, n long, hi long, lo long, signature binary, sketch binary"), "signatures")
    sets = made.where("n > 0").groupBy("n", "hi", "lo").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key1", "key2")).alias("first"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    sets = sets.select("n", "hi", "lo", F.col("first.id").alias("first"), "first.key1", "first.key2", "signature", "sketch")
    classes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = stored(sharing(classes, forest), "shared")
    small = F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared
    joined = stored(classes.join(small, "node").withColumn("part", F.col("node")), "parts")
    discard(shared)

    pairs, _, near = candidates(joined, FIRST_TREES, 1, forest)
    links, spent = confirmed(pairs, joined, keyed, percent)
    joined = _joined(joined, links, [*spent, near])
    pairs, crowded, near = candidates(joined, TREES, WINDOW, forest)
    crowded = stored(crowded, "crowded")
    links, spent = confirmed(pairs, joined, keyed, percent)
    joined = _joined(joined, links, [*spent, near])
    if not crowded.isEmpty():
        joined = _uncrowded(joined, crowded, keyed, forest)
    discard(crowded)
    least = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    named = joined.select("node", "part").join(least, "part")
    # a class that shares nothing is a part of its own
    named = classes.select("node", "n", "hi", "lo", "first").join(named, "node", "left")
    named = named.select("n", "hi", "lo", F.coalesce("part", "node").alias("part"), F.coalesce("component_id", "first").alias("component_id"))
    out = made.select("id", "key1", "key2", "n", "hi", "lo").join(named, ["n", "hi", "lo"], "left")
    return out.select("id", "key1", "key2", "n", "part", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _text_keys(text) -> list:
    return [F.xxhash64(F.lit(k), text.isNull(), text).alias(f"key{k}") for k in (1, 2)]


def membership(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept.

    Texts without words, null ones too, are linked with nothing. Of repeated rows with
    one id all get the same answer. Null ids rank above all others: a component of null
    ids alone has a null component_id and keeps its rows. A text of any length is read
    whole, and an empty table gives none.
    """
    out = _members(df, id_col, text_col, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """df with one row of each component, that with the smallest id (of rows with that id,
    one by the hash of its text). Rows without words all stay. Of rows that repeat both
    id and text any one stands for the rest. Null ids rank above all others.
    """
    rows = stored(_members(df, id_col, text_col, percent).drop("component_id"), "members")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key1", "key2")
    best = rows.where("n > 0").groupBy("part").agg(F.min(rank).alias("best")).select("best.*")
    kept = best.unionByName(rows.where("n = 0").select(F.col("id").isNull().alias("none"), "id", "key1", "key2")).drop("none")
    kept = kept.distinct().select(F.col("id").alias("_id"), F.col("key1").alias("_key1"), F.col("key2").alias("_key2"))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_own"), *_text_keys(F.col(f"`{text_col}`")))
    same = keyed["_own"].eqNullSafe(kept["_id"]) & (keyed["key1"] == kept["_key1"]) & (keyed["key2"] == kept["_key2"])
    out = keyed.join(kept, same, "left_semi")
    if not rows.groupBy("id", "key1", "key2").count().where("count > 1").isEmpty():
        first = Window.partitionBy("_own", "key1", "key2").orderBy(F.lit(1))
        out = out.withColumn("_copy", F.row_number().over(first)).where("_copy = 1")
    return out.select("_row.*").select(*[F.col(f"`{c}`") for c in df.columns])
