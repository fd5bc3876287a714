"""Evaluation of results against expectations, extractor quality, and stage logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import squeeze


def extractor_quality(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per model: replies, valid replies, claims, and claims whose quote is in the cited passage exactly / loosely."""
    per_reply = replies.groupBy("model").agg(F.count(F.lit(1)).alias("replies"), F.count(F.when(F.col("valid"), 1)).alias("valid"))
    claims = replies.filter("valid").select("model", "run_id", F.explode("claims").alias("c")).select("model", "run_id", "c.evidence", "c.quote")
    texts = claims.join(evidence, ["run_id", "evidence"], "left")
    loose = F.contains(squeeze(F.lower("text")), squeeze(F.lower("quote")))
    per_claim = texts.groupBy("model").agg(
        F.count(F.lit(1)).alias("claims"), F.count(F.when((F.col("quote") != "") & F.contains("text", "quote"), 1)).alias("exact"),
        F.count(F.when((F.col("quote") != "") & loose, 1)).alias("loose"))
    return per_reply.join(per_claim, "model", "left").select("model", "replies", "valid", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("claims", "exact", "loose")])


def check_expectations(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per expectation: which checks hold, and PASS, FAIL or GAP (a known gap that still fails).

    expected: id, question_id, states[], documents[], positions[], known_gap; results: question_id, state, documents[], positions[].
    """
    rows = expected.join(results.withColumnRenamed("documents", "got_documents").withColumnRenamed("positions", "got_positions"), "question_id", "left")
    none = F.expr("cast(array() as array<string>)")
    got = lambda c: F.coalesce(F.col(c), none)
    state_ok = F.coalesce(F.array_contains("states", F.col("state")), F.lit(False))
    documents_ok = F.size(F.array_except("documents", got("got_documents"))) == 0
    positions_ok = (F.size("positions") == 0) | ((F.size(F.array_except("positions", got("got_positions"))) == 0)
                                                & (F.size(F.array_except(got("got_positions"), F.col("positions"))) == 0))
    rows = rows.withColumns({"state_ok": state_ok, "documents_ok": documents_ok, "positions_ok": positions_ok})
    passed = F.col("state_ok") & F.col("documents_ok") & F.col("positions_ok")
    return rows.select("id", "question_id", "state_ok", "documents_ok", "positions_ok", F.when(passed, "PASS").when(F.col("known_gap"), "GAP").otherwise("FAIL").alias("outcome"))


def log_fields(line: Column) -> Column:
    """key=value pairs of a stage line as a map; quotes around values are dropped, the first of equal keys wins."""
    keys = F.regexp_extract_all(line, F.lit(fixed.STAGE_FIELD), F.lit(1))
    values = F.transform(F.regexp_extract_all(line, F.lit(fixed.STAGE_FIELD), F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(pairs)


def stage_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    fields = lines.withColumn("f", log_fields(F.col(column)))
    return fields.select(*[c for c in lines.columns], F.try_to_timestamp(F.col("f")["ts"]).alias("ts"), F.col("f")["level"].alias("level"),
                         F.col("f")["stage"].alias("stage"), F.col("f")["ms"].try_cast("bigint").alias("ms"), "f")


def stage_summary(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("stage", "level").agg(
        F.count(F.lit(1)).alias("lines"), F.count("ms").alias("timed"), F.round(F.avg("ms"), 4).alias("mean_ms"),
        F.max("ms").alias("max_ms"))
