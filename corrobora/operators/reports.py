"""Listing reports over documents and runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_list(documents: DataFrame, scope: str, order: str, fields: list[str]) -> DataFrame:
    """Selected fields in arrival order. A global sort is range-partitioned, so one large scope spreads out."""
    return documents.select(scope, order, *fields).orderBy(scope, order)


def status_counts(documents: DataFrame, scope: str) -> DataFrame:
    def of(*names):
        return F.count(F.when(F.col("status").isin(*names), 1))
    return documents.groupBy(scope).agg(
        F.count(F.lit(1)).alias("documents"), of("ready").alias("ready"), of("failed").alias("failed"),
        of("duplicate").alias("duplicate"), of("queued", "extracting", "indexing").alias("in_progress"))


def run_history(runs: DataFrame, scope: str) -> DataFrame:
    return runs.select(scope, "run_no", "created_at", "question", "state").orderBy(scope, "created_at", "run_no")
