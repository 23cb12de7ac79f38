from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_dedup import brute_near
from test_placing import brute_ids, brute_mix, crc
from test_texts import brute_quality

from trailmark.llm import mixing


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "sequence_packing"]

    rows = [r for r in rows if brute_quality(r[1] or "")[-1]]
    docs = stages["quality_rules"](spark, docs, sf)
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == Counter(rows)

    best = {}
    for r in rows:
        best[r[1]] = max(r, best.get(r[1], r))
    rows = list(best.values())
    docs = stages["exact_dedup"](spark, docs, sf)
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == Counter(rows)

    rows = [r for r, (i, _, c) in zip(rows, brute_near(rows, corpus_pipeline.NEAR_PERCENT)) if i == c]
    docs = stages["near_dedup"](spark, docs, sf)
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == Counter(rows)

    at = [docs.columns.index(c) for c in ("doc_id", "source", "text")]
    times = {i: round(taken / size) if size else 0 for i, size, *_, taken, _, _ in brute_mix([tuple(r[k] for k in at) for r in rows], mixing.BLOCK)}
    rows = [r for r in rows for _ in range(times[r[0]])]
    docs = stages["source_mix"](spark, docs, sf)
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == Counter(rows)

    want = Counter()
    for r, ids in zip(rows, brute_ids([r[1] for r in rows])):
        ids = ids + [0]
        for a in range(0, len(ids), 1024):
            want[r[0], a, crc(ids[a : a + 1024])] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in stages["sequence_packing"](spark, docs, sf).collect()) == want


def test_run_chains_the_stages(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and "sequence_id" in packed.columns
