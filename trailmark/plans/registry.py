"""Named queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "manoeuvre_labels"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (load), load giving tables by name and load.path where they
    are, under its own name."""

    def wrap(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load = lambda name: table(spark, sf_dir, name)
            load.path = lambda name: f"{sf_dir}/{name}.parquet"
            return build(load)

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return wrap


from . import domain, filters_joins, grouped, kept_sources, motion, numbers, phrases, reasoning, resumed, sequences, texts_nested  # noqa: E402, F401
