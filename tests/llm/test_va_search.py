from __future__ import annotations

import math
import random

import numpy as np
import pytest

from trailmark.llm import files, va_search


def brute(rows, every=50, k=5):
    part = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, queries = [], {(i, tuple(v)) for i, v in part if i is not None and i % every == 0}
    for q, x in queries:
        scored = sorted((-min(max(sum(a * b for a, b in zip(x, v)), -(1 << 63)), (1 << 63) - 1), i is None, i or 0) for i, v in part if i != q)
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(map(repr, out))


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted(map(repr, (tuple(r) for r in va_search.search(df, **more).collect())))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 0.3) for _ in range(9)]
    out = [(i, vector()) for i in range(400)]
    hot = vector()
    out += [(400 + i, hot) for i in range(200)]  # a third are one vector
    out += [(600, None), (650, [0.1, None] * 4), (700, [float("nan")] * 9), (750, [float("inf")] + [0.0] * 8), (751, [float("-inf")] * 9)]
    out += [(None, vector()), (None, hot), (800, []), (850, [1.0, 2.0]), (901, [0.5] * 12), out[50], out[50], out[7], (50, vector())]
    return out


def test_equals_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=1) == brute(rows, k=1)
    assert found(spark, rows, every=7, k=12) == brute(rows, every=7, k=12)


def test_any_cells_and_blocks_give_the_same(spark, rows, monkeypatch):
    expected = brute(rows)
    assert found(spark, rows, bits=1, sample=5) == expected
    assert found(spark, rows, bits=8, sample=1) == expected
    for name, value in (("SEGMENT", 50), ("QUERIES", 3), ("GROUP", 90), ("CHUNK", 16), ("GAP", 1)):
        monkeypatch.setattr(va_search, name, value)
    assert found(spark, rows) == expected


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0]), (1, [2.0]), (50, [3.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == []
    assert found(spark, [(0, None)]) == [] and spark is not None


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [1e6 + 0.5, 3.0])] + [(i, [1e6 + i / 256, float(i)]) for i in range(1, 30)] + [(40, [1e200, 1.0]), (41, [-1e200, 1.0]), (42, [1e308, 1.0])]
    got = found(spark, rows)
    assert got == brute([r for r in rows if r[0] != 42])  # its scaled value isn't finite


def test_edge_tables(spark, rows):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert va_search.search(empty).columns == ["query_id", "rank", "vec_id", "score"] and va_search.search(empty).count() == 0
    clashing = spark.createDataFrame([(i, v, "s", 1, "b", 2) for i, v in rows], "vec_id long, embedding array<double>, segment string, `group` int, block string, id int")
    assert sorted(map(repr, (tuple(r) for r in va_search.search(clashing).collect()))) == brute(rows)


def test_bounds_hold_and_few_exact_vectors_are_read(spark, sf, monkeypatch):
    x = np.floor(256 * np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], np.float64))
    cells = va_search.Cells(va_search.borders(x[:100]))
    low, high = cells.edges(x.min(0), x.max(0))
    numbers = cells.numbers(cells.pack(x))
    lower, upper = va_search.bounds(x[:20], numbers, low, high)
    exact = x[:20] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    # a segment in memory: how much of the exact part a search reads
    many = np.random.default_rng(1).normal(0, 32, (20_000, x.shape[1])).round()
    cells = va_search.Cells(va_search.borders(many[:4096]))

    class Held:
        def __init__(self, data):
            self.data = data

        def read_at(self, size, at):
            return self.data[at : at + size]

    own, state = np.zeros((len(many), 6), "<i8"), np.zeros((len(many), 6), np.uint8)
    own[:, 0], state[:, 0] = np.arange(len(many)), 1
    data = cells.pack(many).tobytes() + own.tobytes() + state.tobytes() + many.astype("<f8").tobytes()
    monkeypatch.setattr(files, "opened", lambda _: Held(data))
    monkeypatch.setattr(va_search, "GAP", 1)
    segment = va_search.Segment("x", len(many), many.shape[1], -(-many.shape[1] * va_search.BITS // 8), 6)
    best = list(va_search._group_best(np.arange(4), many[:4], [(segment, cells, many.min(0), many.max(0))], 5))
    for i, score, ids, _ in best:
        exact = many @ many[i]
        exact[i] = -np.inf
        assert score.tolist() == sorted(exact.tolist(), reverse=True)[:5] and ids.tolist() == np.argsort(-exact, kind="stable")[:5].tolist()
    approximations = len(many) * (segment.width + 6 * 9)
    assert segment.bytes_read - approximations < 0.02 * many.nbytes
