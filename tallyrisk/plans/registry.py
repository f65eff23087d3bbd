"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyrisk.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

# Bytes a task reads of a table: a score curve's task holds a cell for every distinct score it meets.
SPLIT_BYTES = 32 << 20

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is left out where no SQL text can express the result."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = sf_dir.rstrip("/")
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
            return function(prepare(spark, path), path)

        run.__doc__ = function.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    from tallyrisk.plans import batch_queries, model_queries, stream_queries  # noqa: F401
