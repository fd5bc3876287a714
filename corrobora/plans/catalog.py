"""Named queries, each with the SQL text that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def load() -> None:
    """Import every module that registers queries."""
    from . import (q_claims, q_conflicts, q_documents, q_index, q_pipeline, q_rating, q_retrieval, q_runs,  # noqa: F401
                   q_streaming, q_uploads, q_values, q_verification)
