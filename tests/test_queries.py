"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from trailmark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_queries_without_sql_run(spark, sf):
    for name in registry.QUERIES.keys() - registry.ORACLES.keys():
        assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["central_differences", "edge_repeating_average", "longest_runs", "running_sums", "unwrapped_angles", "sharpest_window", "polynomial_rates", "dip_and_recover", "resampled_series", "rank_percentiles"])
def test_series_are_not_put_in_one_row(spark, sf, name):
    assert "collect_list" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_every_actor_and_search_has_rows(spark, sf):
    actors = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
    assert registry.QUERIES["states_of_every_actor"](spark, sf).count() == 5 * actors
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    searches = registry.QUERIES["search_similarities"](spark, sf)
    assert searches.count() == e.where("vec_id % 20 = 0").count() * (e.count() - 1)


def test_blocks_hold_every_pair_once(spark):
    from trailmark.operators import joins

    out = joins.all_pairs(spark.range(57).toDF("a"), spark.range(23).toDF("b"), 5)
    assert out.count() == out.distinct().count() == 57 * 23


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and keeps its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "trailmark", tmp_path / "trailmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == str(sorted(registry.QUERIES))


def test_a_broken_operator_is_not_taken_for_a_removed_one(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "trailmark", tmp_path / "trailmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_nowhere\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)
    assert out.returncode and "a_module_that_is_nowhere" in out.stderr
