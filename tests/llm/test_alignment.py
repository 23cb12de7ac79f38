from __future__ import annotations

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import alignment

ALIGNER = alignment.Aligner(*alignment.default_paths())


def brute(text):
    """(A ids, B ids) of each group, or None for texts without tokens."""
    if not text:
        return None
    ids_a, ids_b = ALIGNER.a.encode(" " + text, add_special_tokens=False).ids, ALIGNER.b.encode(text)
    bytes_a, bytes_b = [ALIGNER.bytes_a[i] for i in ids_a], [ALIGNER.bytes_b[i] for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b))
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in cuts]
    for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
        for i, e in zip(ids, ends):
            groups[bisect.bisect_left(cuts, e)][side].append(i)
    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def links(groups):
    return Counter((a, b) for x, y in groups for a in x for b in y)


def brute_rows(texts):
    """The result's rows without the id, for the whole corpus."""
    found = [brute(t) for t in texts]
    count, best, best_b = Counter(), defaultdict(int), defaultdict(int)
    for groups in found:
        count.update(set(links(groups or [])))
    for (a, b), n in count.items():
        best[a], best_b[b] = max(best[a], n), max(best_b[b], n)
    out = []
    for groups in found:
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        own = links(groups)
        n_best = sum(n for (a, b), n in own.items() if count[a, b] == best[a])
        n_best_b = sum(n for (a, b), n in own.items() if count[a, b] == best_b[b])
        digest = hashlib.sha256(written(groups).encode()).hexdigest()
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), n_best, n_best_b, sum(n * count[p] for p, n in own.items()), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256"]
ODD = ["▁a", "x y▁z w", " ", "  two  spaces ", "<|endoftext|> <s> <0x41>", "a\u0000b", "日本😀" * 300, "q" * 3000, "tab\there \n\n new", "a\xa0b 　c"]


def test_rows_equal_brute_force(spark, docs, corpus):
    texts = [r[1] for r in corpus] + ODD
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "again"), (3, "again"), (3, "again")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = [(r[0], *e) for r, e in zip(rows, brute_rows([t for _, t in rows]))]
    assert sorted(map(repr, [(r.doc_id, *(r[c] for c in COLUMNS)) for r in got])) == sorted(map(repr, expected))
    assert sum(e[1] == 0 for e in expected) >= 4  # null, empty, two texts with U+2581


def test_hot_pairs_are_broadcast_and_the_rest_is_joined(spark, docs):
    whole = sorted(map(repr, alignment.align(docs).collect()))
    assert sorted(map(repr, alignment.align(docs, head=3).collect())) == whole
    assert sorted(map(repr, alignment.align(docs, head=0).collect())) == whole


def test_edge_tables(clashing, empty, docs):
    assert alignment.align(empty).count() == 0
    got = alignment.align(clashing)
    assert got.columns[0] == "doc_id"
    assert sorted(map(repr, got.collect())) == sorted(map(repr, alignment.align(docs).collect()))


def test_two_pointers_meet_at_common_ends():
    i, j = alignment.merge_ends(np.array([1, 4, 5, 9]), np.array([2, 4, 8, 9]))
    assert (i.tolist(), j.tolist()) == ([1, 3], [1, 3])
    assert [len(x) for x in alignment.merge_ends(np.array([], int), np.array([], int))] == [0, 0]


def test_wide_groups_count_ids():
    a, b = np.array([7] * 40 + [8] * 2), np.array([5] * 30 + [6])
    pairs, times, ends = alignment._links(a, b, np.array([0, 41]), np.array([0, 30]), np.array([41, 1]), np.array([30, 1]))
    own = Counter()
    for p, t in zip(pairs.tolist(), times.tolist()):
        own[p >> 32, p & 0xFFFFFFFF] += t
    assert own == {(7, 5): 1200, (8, 5): 30, (8, 6): 1} and len(pairs) == 3 and ends.tolist() == [0, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("ab .'\t\n1é日😀́\xa0▁") + ["the ", "  ", "<s>", "<|endoftext|>"]), max_size=30).map("".join), max_size=8))
def test_units_align_as_whole_texts(texts):
    found = ALIGNER.align(texts)
    for i, t in enumerate(texts):
        groups = brute(t)
        digest = "" if groups is None else hashlib.sha256(written(groups).encode()).hexdigest()
        own = dict(zip(zip(found["a"][i].tolist(), found["b"][i].tolist()), found["times"][i].tolist()))
        assert (found["groups_sha256"][i], own) == (digest, dict(links(groups or [])))


def test_units_are_remembered_within_a_budget(monkeypatch):
    monkeypatch.setattr(alignment, "STORE", 5000)
    own = alignment.Aligner(*alignment.default_paths())
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)] + ["y" * 5000 + " z"] * 2
    first = own.align(texts + texts)
    assert own.held <= 5000 and 0 < len(own.slot) <= 10 and len(own.units_held) == len(own.slot)
    again = own.align(texts + texts)
    assert all(repr(first[k]) == repr(again[k]) for k in first)
