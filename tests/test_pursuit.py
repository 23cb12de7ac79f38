from __future__ import annotations

import math

import numpy as np
import pytest

from trailmark.operators import pursuit
from trailmark.plans import registry


def plain_loop(x, atoms, steps):
    """The decomposition of one vector, written out: atoms as (id, unit vector)."""
    chosen, weight, residual = [], [], list(x)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    for _ in range(steps):
        left = [(dot(residual, u), -i, u) for i, u in atoms if i not in [c for c, _ in chosen]]
        if left and max(left)[0] > 1e-12 * math.sqrt(dot(x, x)):
            top = max(left, key=lambda t: t[:2])
            chosen.append((-top[1], top[2]))
            weight.append(0.0)
        slope = [dot(residual, u) for _, u in chosen]
        move = [sum(s * u[k] for s, (_, u) in zip(slope, chosen)) for k in range(len(x))]
        pace = dot(residual, move) / dot(move, move) if dot(move, move) > 0 else 0.0
        weight = [max(w + pace * s, 0.0) for w, s in zip(weight, slope)]
        residual = [v - sum(w * u[k] for w, (_, u) in zip(weight, chosen)) for k, v in enumerate(x)]
    return [i for i, _ in chosen], weight, 1 - dot(residual, residual) / max(dot(x, x), 1e-12)


def unit(v):
    norm = math.sqrt(sum(a * a for a in v))
    return [a / norm for a in v]


@pytest.mark.parametrize("block, keep", [(8192, 64 << 20), (3, 0)])
def test_query_equals_a_plain_loop(spark, sf, monkeypatch, block, keep):
    monkeypatch.setattr(pursuit, "ATOMS", block)
    monkeypatch.setattr(pursuit, "KEEP", keep)
    rows = {r.vec_id: [float(a) for a in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    atoms = [(i, unit(v)) for i, v in sorted(rows.items()) if i % 20 == 0]
    got = registry.QUERIES["gradient_pursuit"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got[::3]:
        ids, weight, explained = plain_loop(rows[r.vec_id], atoms, 4)
        assert r.atoms == ids
        assert np.allclose(r.coefficients, weight, atol=1e-9) and abs(r.explained - explained) < 1e-9


def test_odd_rows(spark):
    atoms = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "atom long, v array<double>")
    rows = [("a", [1.0, 0.0]), ("b", [-1.0, -1.0]), ("c", None), ("d", [1.0, None]), ("e", [float("nan"), 1.0]), ("f", [0.0, 0.0]), (None, [3.0, 4.0])]
    got = {r.id: r for r in pursuit.gradient_pursuit(spark.createDataFrame(rows, "id string, v array<double>"), atoms, 2, "id", "v", "atom").collect()}
    assert (got["a"].atoms, got["a"].coefficients, got["a"].explained) == ([1], [1.0], 1.0)
    assert got["b"].atoms == [] and got["b"].explained == 0.0
    assert got["c"].atoms is got["d"].atoms is got["e"].explained is None
    assert got["f"].atoms == [] and got["f"].explained == 1.0
    assert got[None].atoms == [2, 1] and got[None].explained > 0.9  # of equal atoms the smaller id
    none = pursuit.gradient_pursuit(spark.createDataFrame(rows, "id string, v array<double>"), atoms.where("false"), 2, "id", "v", "atom").collect()
    assert len(none) == 7 and all(not r.atoms for r in none)
