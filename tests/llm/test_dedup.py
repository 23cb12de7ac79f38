from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import numpy as np
import pytest

from trailmark.llm import exact_dedup, near_dedup
from trailmark.llm.components import components


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("memory", [exact_dedup.MEMORY, 20_000])
def test_membership_matches_brute_force(spark, docs, corpus, memory):
    want = brute_exact(corpus)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    got = exact_dedup.membership(docs, memory=memory).collect()
    assert len(got) == len(corpus)
    kept = defaultdict(int)
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_deduplicate_keeps_one_whole_row_of_each_text(clashing, corpus):
    out = exact_dedup.deduplicate(clashing, memory=20_000)
    assert out.columns == clashing.columns
    assert sorted((r.text, r.doc_id) for r in out.collect()) == sorted((t, i) for t, (i, _) in brute_exact(corpus).items())


def test_exact_empty(empty):
    assert exact_dedup.membership(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


def test_grace_spills_recursively_and_keeps_colliding_fingerprints_apart():
    records = [((i % 300) << 3 | i % 2, f"text {i % 300} " * 30, i, 1, 1, None) for i in range(3000)]
    entries = list(exact_dedup.grace(iter(records), memory=30_000))
    assert len(entries) == 300 and sum(e[3] for e in entries) == 3000
    same = [(7, f"t{i % 50}" * 2000, i, 1, 1, None) for i in range(200)]
    entries = list(exact_dedup.grace(iter(same), memory=10_000))
    assert len(entries) == 50 and {e[3] for e in entries} == {4}
    assert pickle.loads(pickle.dumps(entries[0]))


def brute_near(rows, percent=85):
    sets = []
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        words = text.encode().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a and 100 * c >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("window", [near_dedup.WINDOW, 2])
def test_near_membership_matches_brute_force(docs, corpus, monkeypatch, window):
    monkeypatch.setattr(near_dedup, "ROWS_PER_TASK", 300)  # many stretches, so that edges count
    monkeypatch.setattr(near_dedup, "WINDOW", window)
    got = near_dedup.membership(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_near(corpus), key=key)
    for r in got:
        assert r.kept == (r.doc_id == r.component_id)


def test_crowded_regions_are_searched_to_the_end(spark, monkeypatch):
    """Unlinked relatives of one text crowd every order; links hide among them."""
    monkeypatch.setattr(near_dedup, "WINDOW", 2)
    monkeypatch.setattr(near_dedup, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(near_dedup, "CROWD_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "DESCEND", 1)
    monkeypatch.setattr(near_dedup, "CROWD_SHINGLES", 10_000)
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(90):
        words = list(base)
        for k in rng.choice(300, 7, replace=False):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            words[int(rng.integers(300))] = "y"
            rows.append((1000 + i, " ".join(words)))
    want = sorted(brute_near(rows))
    assert 20 < len({c for _, _, c in want}) < len(rows)
    searched = []
    whole = near_dedup.crowd_links
    monkeypatch.setattr(near_dedup, "crowd_links", lambda *a: searched.append(1) or whole(*a))
    got = near_dedup.membership(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(searched) == len(near_dedup.Forest.of(85).levels()) and sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_depth_and_sketch_follow_the_threshold():
    from math import comb

    for percent in (80, 85, 90, 95):
        f, p = near_dedup.Forest.of(percent), percent / 100
        assert (1 - p**f.depth) ** near_dedup.TREES <= near_dedup.MISS_ORDERS or f.depth == 1
        assert f.depth == near_dedup.VALUES or (1 - p ** (f.depth + 1)) ** near_dedup.TREES > near_dedup.MISS_ORDERS
        q, n = p + (1 - p) / 2**near_dedup.BITS, near_dedup.TREES * near_dedup.VALUES
        below = lambda k: sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k))  # noqa: E731, B023
        assert below(f.least) <= near_dedup.MISS_SKETCH < below(f.least + 1)
        assert f.levels()[0] == near_dedup.VALUES and f.levels()[-1] == f.depth


@pytest.mark.parametrize("percent", [80, 90])
def test_other_thresholds_match_brute_force(docs, corpus, percent):
    got = near_dedup.membership(docs, percent=percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_near(corpus, percent), key=key)


def test_deduplicate_tells_repeated_ids_apart(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(2, a, 1), (5, a, 2), (5, b, 3), (5, b + " x", 4), (5, b, 5), (7, None, 6), (7, None, 7), (7, "", 8), (None, a + " y", 9), (None, "one", 10)]
    out = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "-", r.extra) for r in out)
    assert [g[:3] for g in got if g[1] == 2] == [(False, 2, a)]
    five = [g for g in got if g[1] == 5]
    assert len(five) == 1 and five[0][2] in (b, b + " x")
    assert [g[2] for g in got if g[1] == 7] == ["-", "-"] and [g[2] for g in got if g[0]] == ["one"]


def test_near_deduplicate_and_empty(clashing, empty):
    out = near_dedup.deduplicate(clashing)
    assert out.columns == clashing.columns and out.count() < clashing.count()
    assert near_dedup.membership(empty).count() == 0
    assert near_dedup.deduplicate(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
    for share in (0.5, 0.85):
        errors = []
        for k in range(20):
            n = 1500
            common = int(2 * n * share / (1 + share))
            a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[:common], whole[n : 2 * n - common]]))
            values, sketch = near_dedup.signatures([a, b])
            errors.append((values[0] == values[1]).mean() - common / (2 * n - common))
            rng.shuffle(whole)
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)] + [(200, 201 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 90, 95: 90, **{201 + i: 200 for i in range(50)}}


def test_rows_that_share_nothing_are_not_dealt(spark, monkeypatch):
    """Of texts without relatives neither signatures nor sketches go into the orders."""
    rng = np.random.default_rng(8)
    text = lambda: [f"w{k}" for k in rng.integers(0, 10_000, 120)]
    rows = [(i, " ".join(text())) for i in range(400)]
    for i in range(6):
        words = rows[i][1].split()
        rows += [(1000 + i, " ".join([*words[:-1], "x"])), (2000 + i, " ".join(["x", *words[1:]]))]
    dealt, whole = [], near_dedup._orders
    monkeypatch.setattr(near_dedup, "_orders", lambda *a: dealt.append(whole(*a)) or dealt[-1])
    monkeypatch.setattr(near_dedup, "_joined", lambda c, *a, f=near_dedup._joined: dealt.append(dealt.pop().count()) or f(c, *a))
    got = near_dedup.membership(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_near(rows))
    assert len(dealt) == 2 and 18 * 12 < dealt[1] < 18 * near_dedup.TREES + 100
