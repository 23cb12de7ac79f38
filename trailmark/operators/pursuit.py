"""Sparse non-negative decomposition of vectors on a dictionary (gradient pursuit)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.session import scratch

#: Atoms that are held against a batch of rows at a time, and bytes of a dictionary up to
#: which a task keeps it instead of reading it again for each step.
ATOMS, KEEP = 8192, 64 << 20
#: Correlations up to this share of a vector's length are rounding errors, not positive.
ROUNDING = 1e-12


class Dictionary:
    """A stored table (atom, unit vector) in blocks of bounded size."""

    def __init__(self, uri: str):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        system, path = fs.FileSystem.from_uri(uri)
        self.data = ds.dataset(path, filesystem=system, format="parquet")
        self.kept: list | None = None

    def _read(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in self.data.to_batches(columns=["atom", "unit"], batch_size=ATOMS):
            if len(batch):
                yield batch.column("atom").to_numpy(), batch.column("unit").flatten().to_numpy().reshape(len(batch), -1)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.kept is not None:
            yield from self.kept
            return
        held, size = [], 0
        for block in self._read():
            size += block[1].nbytes
            if size <= KEEP:
                held.append(block)
            yield block
        if size <= KEEP:
            self.kept = held


def best_atoms(residual: np.ndarray, chosen: np.ndarray, dictionary: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the atoms that a row hasn't chosen yet the one with the highest correlation to its
    residual, ties to the smaller id: (correlation, atom, unit vector) of each row."""
    n, d = residual.shape
    top, atom, unit = np.full(n, -np.inf), np.full(n, -1, np.int64), np.zeros((n, d))
    for ids, vectors in dictionary.blocks():
        scores = residual @ vectors.T
        for column in chosen.T:
            at = np.searchsorted(ids, column) if (ids[1:] >= ids[:-1]).all() else None
            hit = np.flatnonzero(np.isin(column, ids))
            where = at[hit] if at is not None else np.array([np.flatnonzero(ids == c)[0] for c in column[hit]], int)
            scores[hit, where] = -np.inf
        found = scores.max(1)
        # the smallest id among the block's best
        first = np.where(scores == found[:, None], ids, np.iinfo(np.int64).max).argmin(1)
        better = (found > top) | (found == top) & (ids[first] < atom)
        top[better], atom[better], unit[better] = found[better], ids[first[better]], vectors[first[better]]
    return top, atom, unit


def decompose(x: np.ndarray, dictionary: Dictionary, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(atoms, coefficients, explained share of the square sum) of each row; atom -1 where a
    row has stopped growing, since no correlation is positive.

    A step moves all coefficients of a row along the correlations of its atoms with the
    residual, as far as lowers the square error most, and cuts them off at zero.
    """
    n, d = x.shape
    atoms, weight, basis = np.full((n, steps), -1, np.int64), np.zeros((n, steps)), np.zeros((n, steps, d))
    residual, floor = x, ROUNDING * np.sqrt((x * x).sum(1))
    for s in range(steps):
        top, atom, unit = best_atoms(residual, atoms[:, :s], dictionary)
        grows = top > floor
        atoms[grows, s], basis[grows, s] = atom[grows], unit[grows]
        slope = np.matmul(basis, residual[:, :, None])[:, :, 0]  # nothing for places without an atom
        move = np.matmul(slope[:, None, :], basis)[:, 0]
        length = (move * move).sum(1)
        pace = np.divide((residual * move).sum(1), length, out=np.zeros(n), where=length > 0)
        weight = np.maximum(weight + pace[:, None] * slope, 0)
        residual = x - np.matmul(weight[:, None, :], basis)[:, 0]
    square = (x * x).sum(1)
    return atoms, weight, 1 - (residual * residual).sum(1) / np.maximum(square, 1e-12)


def gradient_pursuit(df: DataFrame, atoms: DataFrame, steps: int, id_col: str, vector_col: str, atom_col: str) -> DataFrame:
    """One row per row of df: its id, atoms (array of ids), coefficients (both without the
    places where a row had stopped growing), explained.

    atoms has ``atom_col`` and ``vector_col``; their vectors are scaled to length 1, those
    of length 0, null or non-finite left out. Vectors of df that are null or hold null or
    non-finite numbers get null results; all vectors must have one length. The dictionary may
    have any size: it is written to the shared folder once and tasks go through it in blocks,
    so neither the driver nor a task holds it. Without atoms nothing is explained.
    """
    finite = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    lengths = atoms.select(F.col(f"`{atom_col}`").cast("long").alias("atom"), vector.alias("v")).where(finite("v"))
    lengths = lengths.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0")
    path = scratch(df.sparkSession, "dictionary")
    lengths.select("atom", F.transform("v", lambda x: x / F.col("norm")).alias("unit")).sortWithinPartitions("atom").write.parquet(path)

    def run(batches):
        dictionary = Dictionary(path)
        for batch in batches:
            vectors = batch.column("v")
            good = np.flatnonzero(batch.column("good").to_numpy(zero_copy_only=False))
            found, coefficients, explained = [None] * len(batch), [None] * len(batch), [None] * len(batch)
            if len(good):
                x = vectors.take(pa.array(good)).flatten().to_numpy().reshape(len(good), -1)
                for i, a, w, e in zip(good, *decompose(x, dictionary, steps)):
                    found[i], coefficients[i], explained[i] = a[a >= 0].tolist(), w[a >= 0].tolist(), float(e)
            columns = [batch.column("id"), pa.array(found, pa.list_(pa.int64())), pa.array(coefficients, pa.list_(pa.float64())), pa.array(explained, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "atoms", "coefficients", "explained"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v")).withColumn("good", finite("v"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, atoms array<long>, coefficients array<double>, explained double")
    return out.withColumnRenamed("id", id_col)
