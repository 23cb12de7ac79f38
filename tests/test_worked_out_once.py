"""Long arrays: what a lambda names is worked out once, not once an element."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trailmark.functions import sequences, statistics
from trailmark.operators import trajectories


def test_softmax_and_likelihood_of_long_arrays(spark):
    logits = [math.sin(i) for i in range(4000)]
    total = sum(math.exp(x) for x in logits)
    df = spark.createDataFrame([(logits,), (None,)], "l array<double>")
    p, nll, none = *df.where("l is not null").select(statistics.softmax(F.col("l")), statistics.negative_log_likelihood(F.col("l"), F.lit(7))).first(), df.where("l is null").select(statistics.softmax(F.col("l"))).first()[0]
    assert none is None and all(abs(a - math.exp(x) / total) < 1e-12 for a, x in zip(p, logits)) and len(p) == 4000
    assert abs(nll - (math.log(total) - logits[7])) < 1e-9


def test_long_tracks(spark):
    track = lambda n, jump: [[2.0 * i + (jump if i > n // 2 else 0.0), 1.0 * i] for i in range(n)]
    rows = [("steady", track(3000, 0.0)), ("jump", track(3000, 9.0)), ("two", track(2, 0.0)), ("holes", [[0.0, 0.0], [None, 0.0], [1.0, 0.0], [2.0, 0.0], [9.0, 0.0]]), ("none", None)]
    df = spark.createDataFrame(rows, "name string, track array<array<double>>")
    ok = {r.name: r.ok for r in df.select("name", trajectories.well_driven(F.col("track"), 1.0, 12.0, 6.5).alias("ok")).collect()}
    assert ok == {"steady": True, "jump": False, "two": False, "holes": True, "none": None}
    assert not df.where("name = 'holes'").select(trajectories.well_driven(F.col("track"), 1.0, 12.0, 5.5)).first()[0]
    halves = F.transform(F.col("track"), lambda p: p[0] / 2)
    assert df.where("name = 'steady'").select(F.array_max(sequences.differences(sequences.differences(halves)))).first()[0] == 0.0
