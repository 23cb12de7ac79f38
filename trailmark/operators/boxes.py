"""Upright boxes of a scene that intersect, as a join on grid cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.geometry import box_axes, boxes_touch

FIELDS = ("x", "y", "z", "length", "width", "height", "yaw")
#: Bounds are a little wider than boxes, so that rounding can't part two that touch.
SLACK = 1e-9
#: Boxes of a cell that are one row of the join; cells with more are dealt in blocks.
ROWS = 8000
#: Pairs whose bounds are compared at once, and near pairs whose axes are.
BOUNDS, AXES = 1 << 20, 1 << 15


def touching(df: DataFrame, group: list[str], key: str, cell: float = 4.0, rows: int = ROWS, within: float | None = None) -> DataFrame:
    """group, <key>_a and <key>_b of each pair of boxes of a group that intersect, edges
    included, once, a before b.

    ``df`` has the columns x, y, z, length, width, height and yaw, and keys that tell a group's
    boxes apart. Boxes lie in grids whose cells double from level to level, each at the level
    whose cells are as long as it is (``cell`` at least), in nine cells of it at most; of two
    boxes the smaller one is looked up at the larger one's level, and the pair reported by one
    of the cells they share. So a box is copied a few times a level, whatever the sizes, and
    only boxes in the same cells meet. A cell's boxes are joined as arrays: bounds are compared
    first, and axes are looked at only for pairs whose bounds overlap. Cells of more than
    ``rows`` boxes fall into blocks of about so many, each pair of blocks a row of its own.
    Boxes with a null key or group, or a null or non-finite field, touch nothing.

    With ``within`` a few boxes of a group may share a key: two keys then touch, and are
    reported once, if all boxes of one that overlap a box of the other in height and are
    nearer to it than that in x and in y intersect it.
    """
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in FIELDS]
    told = [F.col(c).isNotNull() for c in (*group, key)]
    known = df.select(*group, F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in FIELDS], F.array_min(F.array(*told, *[F.coalesce(f, F.lit(False)) for f in finite])).alias("_ok")).where("_ok").drop("_ok")
    fields = list(FIELDS)
    if within is not None:
        sharing = Window.partitionBy(*group, "_key")
        same = F.sort_array(F.collect_list(F.struct(*FIELDS)).over(sharing))
        shared = F.count(F.lit(1)).over(sharing) > 1
        known = known.withColumns({"_same": F.when(shared, same), "_own": F.row_number().over(sharing.orderBy(*FIELDS))})
        fields += ["_same", "_own"]
    sized = known.withColumns(_ends({c: F.col(c) for c in FIELDS}, F))
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    sized = sized.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(side / cell))).cast("int"))
    levels = sized.agg(F.collect_set("_level").alias("_levels"))  # one row, a few dozen numbers
    place = [*group, "_at", "_c", "_r"]

    def dealt(boxes: DataFrame, at: Column) -> DataFrame:
        cells = lambda c: F.sequence(_cell(F.col(f"_{c}0"), at, cell), _cell(F.col(f"_{c}1"), at, cell))
        return boxes.withColumn("_at", at).withColumn("_c", F.explode(cells("x"))).withColumn("_r", F.explode(cells("y")))

    large = dealt(sized, F.col("_level"))
    small = sized.crossJoin(F.broadcast(levels)).withColumn("_up", F.explode(F.filter("_levels", lambda v: v >= F.col("_level")))).drop("_levels")
    small = dealt(small, F.col("_up"))
    full = small.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n")).where("_n > 1")

    def packed(boxes: DataFrame, own: str, other: str, name: str) -> DataFrame:
        """Boxes of a cell and block, once for each block of the other side."""
        n = F.coalesce("_n", F.lit(1))
        blocks = boxes.join(F.broadcast(full), place, "left").withColumn(own, F.pmod(F.xxhash64("_key"), n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), n - 1)))
        starts = [(F.col(f"_{i}") == _cell(F.col(f"_{c}0"), F.col("_at"), cell)).alias(f"_starts_{c}") for i, c in (("c", "x"), ("r", "y"))]
        box = F.struct("_key", (F.col("_level") < F.col("_at")).alias("_lower"), *starts, *fields)
        return blocks.groupBy(*place, "_small_block", "_large_block").agg(F.collect_list(box).alias(name))

    sides = packed(small, "_small_block", "_large_block", "_small"), packed(large, "_large_block", "_small_block", "_large")
    met = sides[0].join(sides[1], [*place, "_small_block", "_large_block"]).select(*group, "_small", "_large")
    names = [*group, f"{key}_a", f"{key}_b"]

    def meeting(batches):
        for batch in batches:
            for row, first, second in _meeting(_boxes(batch.column("_small")), _boxes(batch.column("_large")), within):
                yield pa.RecordBatch.from_arrays([*(batch.column(g).take(row) for g in group), first, second], names)

    kinds = [known.schema[c].dataType.simpleString() for c in (*group, "_key", "_key")]
    return met.mapInArrow(meeting, ", ".join(f"`{n}` {kind}" for n, kind in zip(names, kinds)))


def _ends(box: dict, by) -> dict:
    """A box's bounds, a little wide; by is F for columns and np for arrays."""
    cos, sin, l, w = by.abs(by.cos(box["yaw"])), by.abs(by.sin(box["yaw"])), by.abs(box["length"]) / 2, by.abs(box["width"]) / 2
    half = {"x": cos * l + sin * w, "y": sin * l + cos * w}
    return {f"_{c}{side}": box[c] + s * (h * (1 + SLACK) + SLACK * (1 + by.abs(box[c]))) for c, h in half.items() for side, s in ((0, -1), (1, 1))}


def _boxes(column: pa.ListArray) -> tuple[np.ndarray, dict, dict]:
    """The row of each box of a column of arrays, the boxes' numbers and their other fields, by
    row and _y0."""
    sizes, boxes = pc.list_value_length(column).to_numpy(), column.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    fields = {f.name: a for f, a in zip(boxes.type, boxes.flatten())}
    other = {c: fields.pop(c) for c in ("_key", "_same") if c in fields}
    numbers = {c: a.to_numpy(zero_copy_only=False) for c, a in fields.items()}
    numbers |= _ends(numbers, np)
    order = np.lexsort((numbers["_y0"], row))
    return row[order], {c: v[order] for c, v in numbers.items()}, {c: a.take(pa.array(order)) for c, a in other.items()}


def _meeting(small: tuple, large: tuple, within: float | None):
    """Row and both keys of each pair of a row's small and large boxes that intersect."""
    sides, keys = [small[1], large[1]], pa.concat_arrays([small[2]["_key"], large[2]["_key"]])
    place = (keys if pa.types.is_integer(keys.type) else pc.rank(keys, tiebreaker="dense")).to_numpy()
    n, both = len(small[0]), {c: np.concatenate([side[c] for side in sides]) for c in sides[0]}
    both |= box_axes(both["yaw"], np)
    shared = None if within is None else _Shared(both, pa.concat_arrays([small[2]["_same"], large[2]["_same"]]), within)
    found, waiting = [], 0
    for i, j in _near(small[0], large[0], *sides, place[:n], place[n:]):
        found.append((i, j))
        waiting += len(i)
        if waiting >= AXES:
            yield from _tested(found, small[0], both, keys, place, n, shared)
            found, waiting = [], 0
    yield from _tested(found, small[0], both, keys, place, n, shared)


class _Shared:
    """Boxes whose key others of their group have too."""

    def __init__(self, both: dict, same: pa.ListArray, within: float):
        sizes = pc.fill_null(pc.list_value_length(same), 0).to_numpy()
        others = same.flatten()
        self.within, self.repeated, self.size, n = within, sizes > 0, np.maximum(sizes, 1), len(sizes)
        self.start = np.where(self.repeated, n + np.cumsum(sizes) - sizes, np.arange(n))
        self.own = np.where(self.repeated, both["_own"] - 1, 0)
        boxes = {f.name: np.concatenate([both[f.name], a.to_numpy()]) for f, a in zip(others.type, others.flatten())}
        self.all = boxes | box_axes(boxes["yaw"], np)

    def reported(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of these intersecting pairs are the first of their keys, all of whose near
        boxes intersect."""
        width = self.size[q]
        count = self.size[p] * width
        ends = np.cumsum(count)
        pair, k = np.repeat(np.arange(len(p)), count), np.arange(ends[-1]) - np.repeat(ends - count, count)
        a, b = ({c: v[at] for c, v in self.all.items()} for at in (self.start[p][pair] + k // width[pair], self.start[q][pair] + k % width[pair]))
        touch, near = boxes_touch(a, b, np.abs), np.abs(a["z"] - b["z"]) <= (a["height"] + b["height"]) / 2
        for c in "xy":
            near &= np.abs(a[c] - b[c]) < self.within
        near |= touch
        first = np.minimum.reduceat(np.where(near, k, count[pair]), ends - count)
        return np.logical_and.reduceat(touch | ~near, ends - count) & (first == self.own[p] * width + self.own[q])


def _near(row_a, row_b, a: dict, b: dict, place_a, place_b):
    """Positions of the pairs that this row's cell reports and whose bounds overlap."""
    ends = [np.searchsorted(rows, np.arange(row_a[-1] + 2) if len(row_a) else [0]) for rows in (row_a, row_b)]
    for s0, s1, l0, l1 in zip(ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]):
        if s0 == s1 or l0 == l1:
            continue
        low, tallest, step = b["_y0"][l0:l1], (b["_y1"][l0:l1] - b["_y0"][l0:l1]).max(), max(1, min(256, BOUNDS // (l1 - l0)))
        tallest += SLACK * (1 + abs(tallest) + np.abs(low[[0, -1]]).max())
        for start in range(s0, s1, step):
            one = slice(start, min(s1, start + step))
            two = slice(l0 + np.searchsorted(low, a["_y0"][start] - tallest), l0 + np.searchsorted(low, a["_y1"][one].max(), "right"))
            near = a["_x0"][one, None] <= b["_x1"][two]
            near &= b["_x0"][two] <= a["_x1"][one, None]
            near &= a["_y0"][one, None] <= b["_y1"][two]
            near &= b["_y0"][two] <= a["_y1"][one, None]
            for c in "xy":
                near &= a[f"_starts_{c}"][one, None] | b[f"_starts_{c}"][two]
            near &= (place_a[one, None] < place_b[two]) | a["_lower"][one, None]
            i, j = np.nonzero(near)
            yield i + start, j + two.start


def _tested(found: list, row, both: dict, keys: pa.Array, place, n: int, shared: _Shared | None):
    """Of near pairs those that intersect, the box with the lesser key first."""
    i, j = (np.concatenate([pair[k] for pair in found] or [np.zeros(0, int)]) for k in (0, 1))
    fields = [c for c in both if not c.startswith("_") and c != "yaw"]
    for start in range(0, len(i), AXES):
        a, b = i[start : start + AXES], j[start : start + AXES] + n
        lesser = place[a] < place[b]
        p, q = np.where(lesser, a, b), np.where(lesser, b, a)
        touch = boxes_touch(*({c: both[c][at] for c in fields} for at in (p, q)), np.abs) & (place[p] != place[q])
        if shared is not None:
            doubtful = np.flatnonzero(touch & (shared.repeated[p] | shared.repeated[q]))
            if len(doubtful):
                touch[doubtful] = shared.reported(p[doubtful], q[doubtful])
        yield pa.array(row[a[touch]]), keys.take(pa.array(p[touch])), keys.take(pa.array(q[touch]))


def _cell(x: Column, level: Column, cell: float) -> Column:
    return F.floor(x / (F.lit(cell) * F.pow(F.lit(2.0), level)))
