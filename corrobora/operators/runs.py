"""Questions, cache keys, cached runs and stored run rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import squeeze


def checked_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """Question with single spaces and a rejection code (empty, too long) or NULL."""
    rows = questions.withColumn(column, squeeze(F.coalesce(column, F.lit(""))))
    return rows.withColumn("code", F.when(F.col(column) == "", fixed.QUESTION_EMPTY).when(
        F.length(column) > fixed.QUESTION_MAX, fixed.QUESTION_LONG))


def document_set_digests(documents: DataFrame) -> DataFrame:
    """One digest per scope over the hashes of its ready documents, whatever their order.

    The hash list of a large scope is never collected: the eight 32-bit words of the SHA-256 values are summed, which
    identifies a multiset of hashes and combines map-side.
    """
    words = [F.conv(F.substring("sha256", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = documents.filter("status = 'ready'").groupBy("scope").agg(
        F.count(F.lit(1)).alias("ready"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("scope", "ready", F.concat_ws(":", "ready", *[f"w{i}" for i in range(8)]).alias("document_set"))


def cache_key(prompt_version: str, model: str, document_set: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(prompt_version), F.lit(model), document_set, squeeze(F.lower(question))), 256)


def with_cache_key(questions: DataFrame, digests: DataFrame, prompt_version: str, model: str) -> DataFrame:
    rows = questions.join(digests, "scope", "left")
    return rows.withColumns({"has_documents": F.col("ready").isNotNull(), "cache_key": cache_key(
        prompt_version, model, F.coalesce("document_set", F.lit("")), F.col("question"))}).drop("ready", "document_set")


def cache_lookup(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds cached_run: the newest servable run of the same scope and key; `fresh` questions never hit.

    Newest is a maximum, so a key with most of the runs is combined before the shuffle.
    """
    newest = runs.filter(~F.col("degraded")).groupBy("scope", "cache_key").agg(
        F.max_by(F.struct(*[c for c in runs.columns if c not in ("scope", "cache_key")]), F.struct("created_at", "run_no")).alias("newest"))
    rows = asked.join(newest, ["scope", "cache_key"], "left")
    return rows.withColumn("cached_run", F.when(~F.col("fresh"), F.col("newest"))).drop("newest")


def degraded(evidence_only: Column, check_failed: Column) -> Column:
    """Stored for history, never served from the cache."""
    return evidence_only | check_failed


def debug_view(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Per run: matched rule and the dropped claims with their reasons, in claim order."""
    lost = checked.filter("drop_reason IS NOT NULL").groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("claim_no", F.concat_ws("=", "claim_id", "drop_reason").alias("d")))), lambda r: r["d"]), ",").alias("dropped"))
    return rows.select("run_id", "state", "rule").join(lost, "run_id", "left").withColumn("dropped", F.coalesce("dropped", F.lit("")))
