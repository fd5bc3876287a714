"""The whole pipeline over a table of stored runs: the same questions asked in two batches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import intake
from ..sources import tables
from . import q_claims
from . import q_retrieval as qr
from . import run_table, stand_ins
from .catalog import query

AGAIN = 100_000      # added to the id of a question that is asked twice


def questions_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every item, one in seven of them twice in a batch, and one that is too long for each scope."""
    asked = qr.questions(spark, sf).withColumn("fresh", F.lit(False))
    twice = asked.filter("question_id % 7 = 0").withColumn("question_id", F.col("question_id") + AGAIN)
    long = asked.groupBy("scope").agg(F.min("question_id").alias("question_id")).select(
        (F.col("question_id") + 2 * AGAIN).alias("question_id"), "scope", F.repeat(F.lit("why "), 200).alias("question"), F.lit(False).alias("fresh"))
    return asked.unionByName(twice).unionByName(long)


def inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    passages = qr.corpus(spark, sf).withColumns({
        "document": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")), "page": F.lit(None).cast("int"), "section": F.lit(None).cast("string"), "paragraph": F.col("ordinal"),
        "text_hash": tx.text_hash(F.col("text")), "extraction_method": F.lit("text"), "ocr_confidence": F.lit(None).cast("double")})
    documents = qr.with_status(spark, sf).select("scope", "status", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    vectors = qr.question_vectors(spark, sf).select("question_id", "vector")
    asked = questions_asked(spark, sf).select(F.col("question_id").alias("id"), "scope", (F.col("question_id") % AGAIN).alias("question_id"))
    asked_vectors = asked.join(vectors, "question_id").select(F.col("id").alias("question_id"), "scope", "vector")
    return {"passages": tables.stored(passages, "passages"), "documents": documents, "question_vectors": asked_vectors, "passage_vectors": tables.stored(qr.passage_vectors(spark, sf), "passage-vectors")}


def reply(prompts: DataFrame) -> DataFrame:
    """One prompt in three has a recorded reply, the others are sent."""
    call = lambda rows: tables.stored(intake.call_models(rows, stand_ins.passage_reader, ["primary", "fallback"], callers=4), "called")
    recordings = intake.recorded(call(prompts.filter("question_id % 100000 % 3 = 0")))
    _, to_send = intake.split_recorded(prompts, recordings, "replay")
    return intake.resolve(prompts, recordings, call(to_send), "replay")


def answered_twice(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The rows of the second batch, in which one question in five is asked anew, and the folder of the runs."""
    given, path = inputs(spark, sf), tables.shared_folder(spark, "runs")
    asked = questions_asked(spark, sf)
    run_table.answer_batch(asked, path=path, batch_id=1, system=q_claims.SYSTEM, reply=reply, **given)
    again = asked.withColumn("fresh", F.col("question_id") % 5 == 0)
    return run_table.answer_batch(again, path=path, batch_id=2, system=q_claims.SYSTEM, reply=reply, **given), path


_RULES_SQL = r"""
asked AS (SELECT question_id, scope, trim(regexp_replace(question, '\s+', ' ', 'g')) AS q FROM questions),
items AS (SELECT question_id, doc_id, length(trim(left(text, 40))) >= 10 AS ok, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM chosen JOIN corpus USING (doc_id, ordinal)),
sides AS (SELECT DISTINCT a.question_id FROM items a JOIN items b ON a.question_id = b.question_id AND a.ok AND b.ok AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 AND a.h <> b.h),
base AS (SELECT question_id, any_value(scope) AS scope, any_value(length(q)) AS n, count(doc_id) AS n_evidence, count(*) FILTER (ok) AS verified, least(count(DISTINCT doc_id) FILTER (ok), count(DISTINCT h) FILTER (ok)) AS independent
  FROM asked LEFT JOIN items USING (question_id) GROUP BY 1),
flags AS (SELECT *, n_evidence > 0 AND (n % 11 = 5 OR n % 13 = 7) AS evidence_only FROM base),
ruled AS (SELECT *, CASE WHEN evidence_only THEN 1 WHEN verified = 0 THEN 2 WHEN n % 4 = 1 AND question_id IN (FROM sides) THEN 3 WHEN n % 4 = 2 THEN 4 WHEN n % 4 = 3 THEN 5 WHEN n % 8 = 4 THEN 6 WHEN independent >= 2 THEN 8 ELSE 9 END AS rule FROM flags),
every AS (SELECT *, question_id AS id FROM ruled UNION ALL SELECT *, question_id + 100000 FROM ruled WHERE question_id % 7 = 0)"""


@query("run_pipeline", qr._sql("""SELECT id AS question_id, scope, ['LOW', 'INSUFFICIENT', 'CONFLICT', 'LOW', 'LOW', 'LOW', 'LOW', 'HIGH', 'MEDIUM'][rule] AS state, CAST(rule AS INTEGER) AS rule,
  CASE WHEN evidence_only OR n_evidence = 0 THEN 'none' WHEN question_id % 3 = 0 THEN 'recording' ELSE 'live' END AS llm_source, n_evidence, CASE WHEN evidence_only THEN 0 ELSE verified END AS claims_verified,
  id % 5 <> 0 AND NOT evidence_only AS cached, CASE WHEN id >= 100000 AND NOT evidence_only THEN 0 ELSE 1 END + CASE WHEN id % 5 <> 0 AND NOT evidence_only THEN 0 ELSE 1 END AS runs_kept, CAST(NULL AS VARCHAR) AS code FROM every
UNION ALL SELECT min(question_id) + 200000, scope, NULL, NULL, NULL, NULL, NULL, false, 0, 'question_too_long' FROM questions GROUP BY scope""",
    qr._BM25_SQL, qr._DENSE_SQL, qr._FUSE_SQL, qr._CHOSEN_SQL, _RULES_SQL))
def run_pipeline(spark, sf):
    rows, path = answered_twice(spark, sf)
    kept = run_table.read_runs(spark, path).groupBy(F.col("run_id").alias("kept_id")).agg(F.count(F.lit(1)).cast("int").alias("runs_kept"))
    signals = F.from_json("result_json", "signals struct<evidence_retrieved:bigint,claims_verified:bigint,llm_source:string>").getField("signals")
    rows = rows.withColumn("s", signals).join(kept, F.col("run_id") == F.col("kept_id"), "left")
    return rows.select(F.col("run_id").alias("question_id"), "scope", "state", "rule", "s.llm_source", F.col("s.evidence_retrieved").alias("n_evidence"), "s.claims_verified",
                       F.coalesce("cached", F.lit(False)).alias("cached"), F.coalesce("runs_kept", F.lit(0)).alias("runs_kept"), "code")
