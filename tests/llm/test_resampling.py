from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def brute_rows(rows, target, percent=5):
    raw, wanted = Counter(), Counter()
    for _, t in rows:
        raw.update(grams(t)[0])
    for t in target:
        wanted.update(grams(t)[0])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    out = []
    for i, text in rows:
        own, n = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, own))
        out.append([i, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_rows_equal_brute_force(spark, docs, corpus):
    target = [corpus[5][1], "One two three. " * 5, None, ""]
    rows = [(r[0], r[1]) for r in corpus]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent in (5, 40, 100):
        assert plain(resampling.resample(docs, wanted, percent=percent)) == sorted(map(repr, brute_rows(rows, target, percent)))


def test_rank_over_many_ranges(spark, docs, monkeypatch):
    wanted = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    whole = plain(resampling.resample(docs, wanted, percent=60))
    monkeypatch.setattr(resampling, "RANK_ROWS", 7)
    assert plain(resampling.resample(docs, wanted, percent=60)) == whole
    assert plain(resampling.resample(docs.repartition(3), wanted, percent=60)) == whole


def test_one_id_and_text_for_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANK_ROWS", 10)
    rows = [(None, "same words " * 12)] * 60 + [(i, f"w{i} " * 25) for i in range(120)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, "same words")], "item_id long, text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 91))
    assert min(r.score for r in got if r["rank"]) >= max(r.score for r in got if not r["rank"])


def test_edge_tables(spark, clashing, docs, empty):
    wanted = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert resampling.resample(empty, wanted).count() == 0
    assert plain(resampling.resample(clashing, wanted)) == plain(resampling.resample(docs, wanted))
    assert resampling.resample(docs, wanted.limit(0)).count() == docs.count()
    assert resampling.resample(empty, wanted.limit(0)).columns == ["doc_id", "n_features", "weight", "score", "rank"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZ9 .`{~é日 ", "word " * 3, "x" * 70, "y" * 300]), max_size=20).map("".join), min_size=1, max_size=6))
def test_buckets_are_checksums_of_runs(texts):
    found, words = resampling.buckets(pa.array(texts))
    for t, own, n in zip(texts, found, words):
        assert (sorted(own.tolist()), n) == (sorted(grams(t)[0]), grams(t)[1])


def test_checksums_of_joined_strings():
    left, right = [b"", b"a", b"abc" * 50], [b"", b"q", b"z" * 64, b"y" * 5000]
    for a in left:
        for b in right:
            got = resampling.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
            assert int(got[0]) == zlib.crc32(a + b)
