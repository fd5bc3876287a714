"""Runs that are kept: questions are answered from a table of stored runs, and what is new is added to it once.

A batch of questions has an id. Its new runs are one partition of the table, written as a whole; the batch itself never reads that partition. So a batch that failed and is
repeated, or is repeated after it ended, gives the same answers and leaves the same rows.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intake, runs
from ..sources import tables
from . import investigate as iv

RUN_SCHEMA = ("run_id bigint, scope string, question string, state string, rule int, degraded boolean, headline string, result_json string, cache_key string, model string, "
              "created_at timestamp, run_no bigint, batch_id bigint")
KEPT = [field.split()[0] for field in RUN_SCHEMA.split(", ")][:-1]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs; none where nothing has been stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def add_runs(rows: DataFrame, path: str, batch_id: int) -> None:
    """Replace the batch's partition by these rows; other partitions stay as they are."""
    written = rows.select(*KEPT, F.lit(batch_id).cast("bigint").alias("batch_id"))
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def answers_from_replies(questions: DataFrame, evidence: DataFrame, replies: DataFrame, question_vectors: DataFrame | None = None) -> DataFrame:
    """Run rows of questions with their evidence and one reply each (question_id, raw_response, model, llm_source).

    A question that has evidence but no readable reply is answered with its passages only; one without a vector is marked as answered by keywords."""
    read = tables.stored(intake.reissued(intake.validated(intake.with_json(replies))).withColumnRenamed("question_id", "run_id"), "replies")
    extracted = iv.extraction_from_replies(read)
    asked = evidence.select("question_id").distinct()
    readable = read.filter("valid").select(F.col("run_id").alias("question_id"))
    unavailable = asked.join(readable, "question_id", "left_anti")
    by_keywords = None if question_vectors is None else questions.select("question_id").join(question_vectors.select("question_id"), "question_id", "left_anti")
    source = read.select(F.col("run_id").alias("question_id"), "llm_source", "model")
    return iv.run_rows(iv.investigate(questions, evidence, extracted, unavailable, by_keywords if by_keywords is not None else True, source), None)


def answer_batch(asked: DataFrame, passages: DataFrame, documents: DataFrame, path: str, batch_id: int, system: str, reply: Callable[[DataFrame], DataFrame],
                 question_vectors: DataFrame | None = None, passage_vectors: DataFrame | None = None, model: str = "model") -> DataFrame:
    """One row per question: its run, whether that was `cached`, or the `code` with which the question was rejected.

    asked: question_id, scope, question, fresh (answer anew); passages and documents: those of all scopes; reply: prompts to (question_id, raw_response, model, llm_source).
    Equal questions of a batch are answered once: the one with the smallest id gets the run and the others are served from it, if it may be served; else each keeps its own row.
    """
    spark = asked.sparkSession
    checked = tables.stored(runs.checked_questions(asked), "asked")
    good = runs.with_cache_key(checked.filter("code IS NULL").drop("code"), runs.document_set_digests(documents), iv.PROMPT_VERSION, model)
    good = tables.stored(good, "questions")
    earlier = read_runs(spark, path).filter(F.col("batch_id") != batch_id)

    def answer(missing: DataFrame) -> DataFrame:
        firsts = missing.filter("NOT fresh").groupBy("scope", "cache_key").agg(F.min("question_id").alias("leader"))
        missing = missing.join(firsts, ["scope", "cache_key"], "left").withColumn("leader", F.when(F.col("fresh"), F.col("question_id")).otherwise(F.col("leader")))
        missing = tables.stored(missing, "missing")
        if missing.isEmpty():
            return spark.createDataFrame([], RUN_SCHEMA).drop("batch_id").withColumn("leader", F.col("run_id"))
        leaders = missing.filter("question_id = leader").drop("leader", "fresh")
        wanted = leaders.select("question_id")
        vectors = None if question_vectors is None else question_vectors.join(wanted, "question_id", "left_semi")
        evidence = tables.stored(iv.retrieve(leaders, passages, vectors, passage_vectors), "evidence")
        replies = tables.stored(reply(intake.prompts(leaders, evidence, system)), "raw-replies")
        rows = answers_from_replies(leaders, evidence, replies, vectors).drop("code")
        own = rows.withColumnRenamed("run_id", "leader").drop("run_no", "scope", "question", "cache_key")
        every = missing.select("question_id", "leader", "scope", "question", "cache_key").join(own, "leader")
        return every.select(F.col("question_id").alias("run_id"), F.col("question_id").alias("run_no"), *[c for c in every.columns if c != "question_id"])

    hits, answered = iv.from_cache_or(good, earlier, answer)
    answered = tables.stored(answered.withColumn("cached", (F.col("run_id") != F.col("leader")) & ~F.col("degraded")), "answered")
    add_runs(answered.filter("NOT cached"), path, batch_id)
    found = hits.select(F.col("question_id").alias("run_id"), F.col("cached_run.batch_id").alias("from_batch"), F.col("cached_run.run_no").alias("run_no"), "scope", "question", "cache_key",
                        *[F.col(f"cached_run.{c}").alias(c) for c in ("state", "rule", "degraded", "headline", "result_json", "model", "created_at")], F.lit(True).alias("cached"))
    rejected = checked.filter("code IS NOT NULL").select(F.col("question_id").alias("run_id"), "scope", "question", "code")
    return answered.drop("leader").unionByName(found, allowMissingColumns=True).unionByName(rejected, allowMissingColumns=True)
