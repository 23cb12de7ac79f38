from __future__ import annotations

import random

from trailmark.llm import near_dedup


def _pairs(n):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for _ in range(n):
        words = [word() for _ in range(60)]
        yield " ".join(words)
        yield " ".join([*words[:-1], "other"])


def test_rows_of_one_id_meet_their_own_class_only(spark, monkeypatch):
    texts = list(_pairs(60))
    met = []
    shingles = near_dedup.shingle_sets
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda *a: met.append(shingles(*a)) or met[-1])
    monkeypatch.setattr(near_dedup, "discard", lambda *tables: None)
    for key in (lambda i: None, lambda i: 7, lambda i: i):
        met.clear()
        rows = [(key(i), t) for i, t in enumerate(texts)] + [(key(0), texts[0])] * 40
        df = spark.createDataFrame(rows, "doc_id long, text string")
        kept = near_dedup.deduplicate(df)
        assert kept.count() == 60
        # one row of shingles for each class that is wanted, though an id or a text is repeated
        assert met and all(m.count() == m.select("node").distinct().count() <= len(texts) for m in met)
