"""Hierarchical weighted hash tree: rows to shards by region, rack and shard.

At each level every child draws ``-ln(u) / weight`` with u from a hash of the row's key
and the child's path, and the smallest draw wins. A child whose weight grows only gains
rows, one whose weight falls only loses them, and rows that stay outside the children
of a changed node do not move at all. A layout grows by a region of its own, so what
moves goes into the new shard and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cells_for, gapless, text_or_empty

#: Rows of a shard are numbered in so many cells at least; in a large table in more.
CELLS = 512


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(regions: int, racks: int, shards: int) -> list[Leaf]:
    """A full tree: shards per rack, racks per region; shards numbered from 0."""
    return [Leaf(r, k, (r * racks + k) * shards + s) for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a new region: it takes rows only into itself."""
    return [*leaves, Leaf(max(x.region for x in leaves) + 1, 0, max(x.shard for x in leaves) + 1, weight)]


def place(key: Column, leaves: list[Leaf], seed: str = "tree") -> Column:
    """The shard of a key. Null keys share one shard."""
    tree: dict[str, dict[str, float]] = {}
    for x in leaves:
        for parent, child in (("", f"{x.region}"), (f"{x.region}", f"{x.region}/{x.rack}"), (f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}")):
            tree.setdefault(parent, {})
            tree[parent][child] = tree[parent].get(child, 0.0) + x.weight
    children = F.create_map(*[c for parent, kids in tree.items() for c in (F.lit(parent), F.array(*[F.struct(F.lit(kid).alias("path"), F.lit(w).alias("weight")) for kid, w in kids.items()]))])

    def descend(node: Column) -> Column:
        def draw(child: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, child["path"], F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"].alias("path"))

        return F.array_min(F.transform(F.element_at(children, node), draw))["path"]

    path = descend(descend(descend(F.lit(""))))
    return F.element_at(F.split(path, "/"), 3).cast("int")


def shard(df: DataFrame, leaves: list[Leaf], id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``. Size is the text's UTF-8 bytes plus 8 (null text: 8, crc 0).
    Slots are gapless from 0 in each shard; repeated rows get slots of their own, and an
    empty table gives none. Cells are by id: rows that share one id, null ids too, are
    numbered in one task, which sorts ids and checksums only.
    """
    cells = cells or max(CELLS, cells_for(df.count()))
    text, key = text_or_empty(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = df.select(
        key.alias(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, leaves).alias("shard"),
        place(key, grown(leaves)).alias("grown_shard"),
    )
    out = gapless(rows, ["shard"], [F.col(id_col), F.col("text_crc32")], "slot", cells, key=[F.col(id_col)])
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
