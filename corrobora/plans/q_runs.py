"""Queries over questions, cached runs, evaluation and logs, and the whole batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, indexing, reports, retrieval, runs
from ..sources import tables
from . import investigate as iv
from . import q_conflicts as qc
from . import q_rating as qr
from . import q_verification as qv
from . import views
from .catalog import query


@query("run_question_check", r"""WITH q AS (SELECT 'b' || item_id AS id, text AS t FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, CASE WHEN turn = 3 THEN '  ' ELSE text END FROM conversations)
SELECT id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS question, CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 'empty_question' WHEN length(trim(regexp_replace(t, '\s+', ' ', 'g'))) > 500 THEN 'question_too_long' END AS code FROM q""")
def run_question_check(spark, sf):
    b = views.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"))
    c = views.table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
                                                       F.when(F.col("turn") == 3, "  ").otherwise(F.col("text")).alias("question"))
    return runs.checked_questions(b.unionByName(c))


_WORDS = ", ':', ".join(f"sum(CAST('0x' || substr(sha256(text), {8 * i + 1}, 8) AS BIGINT))" for i in range(8))


@query("run_cache_key", f"""WITH sets AS (SELECT source AS scope, concat(count(*), ':', {_WORDS}) AS s FROM documents WHERE doc_id % 29 <> 0 GROUP BY 1)
SELECT item_id AS question_id, d.source AS scope, sha256(concat('v1|model|', coalesce(s, ''), '|', trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))) AS cache_key
FROM benchmark b JOIN documents d ON d.doc_id = item_id LEFT JOIN sets ON scope = d.source""")
def run_cache_key(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("source").alias("scope"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"),
                                                   F.when(F.col("doc_id") % 29 == 0, "failed").otherwise("ready").alias("status"))
    # an item is asked in the scope of the document that has its number
    scopes = views.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("scope"))
    asked = views.table(spark, sf, "benchmark").join(scopes, "item_id").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "scope")
    return runs.with_cache_key(asked, runs.document_set_digests(d), "v1", "model").select("question_id", "scope", "cache_key")


def stored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """orders as runs: scope by customer, question by priority, partly filled orders as runs without analysis."""
    evidence_only, failed = F.col("o_orderstatus") == "P", F.col("o_orderkey") % 13 == 0
    return views.table(spark, sf, "orders").select(
        F.concat(F.lit("inv"), (F.col("o_custkey") % 20).cast("string")).alias("scope"), F.col("o_orderkey").alias("run_no"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("question"), F.when(evidence_only, "LOW").when(F.col("o_orderstatus") == "F", "HIGH").otherwise("MEDIUM").alias("state"),
        runs.degraded(evidence_only, failed).alias("degraded"), runs.cache_key("v1", "model", F.lit("set"), F.col("o_orderpriority")).alias("cache_key"),
        F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("result_json"))


_RUNS_SQL = """stored AS (SELECT 'inv' || (o_custkey % 20) AS scope, o_orderkey AS run_no, o_orderdate AS created_at, o_orderpriority AS question,
  CASE o_orderstatus WHEN 'P' THEN 'LOW' WHEN 'F' THEN 'HIGH' ELSE 'MEDIUM' END AS state, o_orderstatus = 'P' OR o_orderkey % 13 = 0 AS degraded FROM orders)"""


@query("rpt_run_history", f"WITH {_RUNS_SQL} SELECT scope, run_no, created_at, question, state FROM stored ORDER BY scope, created_at, run_no")
def rpt_run_history(spark, sf):
    return reports.run_history(stored_runs(spark, sf), "scope")


@query("run_cache_lookup", f"""WITH {_RUNS_SQL}, newest AS (SELECT scope, question, max((created_at, run_no)) AS m FROM stored WHERE NOT degraded GROUP BY ALL)
SELECT o_orderkey AS question_id, CASE WHEN o_orderstatus <> 'F' THEN m[2] END AS cached_run, o_orderstatus <> 'F' AND m IS NOT NULL AS cached
FROM orders LEFT JOIN newest ON scope = 'inv' || (o_custkey % 25) AND lower(question) = lower(o_orderpriority)""".replace("m[2]", "struct_extract(m, 2)"))
def run_cache_lookup(spark, sf):
    asked = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("inv"), (F.col("o_custkey") % 25).cast("string")).alias("scope"), (F.col("o_orderstatus") == "F").alias("fresh"),
        runs.cache_key("v1", "model", F.lit("set"), F.upper("o_orderpriority")).alias("cache_key"))
    found = runs.cache_lookup(asked, stored_runs(spark, sf))
    return found.select("question_id", F.col("cached_run.run_no").alias("cached_run"), F.col("cached_run").isNotNull().alias("cached"))


@query("run_degraded_flag", f"WITH {_RUNS_SQL} SELECT scope, count(*) AS runs, count(*) FILTER (degraded) AS degraded, count(*) FILTER (NOT degraded) AS servable FROM stored GROUP BY 1")
def run_degraded_flag(spark, sf):
    return stored_runs(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("degraded"), 1)).alias("degraded"),
                                                       F.count(F.when(~F.col("degraded"), 1)).alias("servable"))


@query("run_debug", qr._sql("""SELECT run_id, state, rule, coalesce(dropped, '') AS dropped FROM states LEFT JOIN (SELECT run_id, string_agg(claim_id || '=' || drop_reason, ',' ORDER BY claim_no) AS dropped FROM checked WHERE drop_reason IS NOT NULL GROUP BY 1) USING (run_id)"""))
def run_debug(spark, sf):
    return runs.debug_view(qr.rated(spark, sf), qv.checked(spark, sf))


@query("sink_result_json", qr._sql("SELECT run_id, state, CAST(rule AS BIGINT) AS rule, claims_verified, len(string_split(reasons, ' || ')) AS reasons FROM states LEFT JOIN reason_lists USING (run_id)", qr._REASONS_SQL))
def sink_result_json(spark, sf):
    rows = tables.to_result_json(qr.rated(spark, sf, noted=True), ["state", "rule", "signals", "reasons"])
    back = tables.from_result_json(rows.select("run_id", "result_json"), "state string, rule bigint, signals struct<claims_verified:bigint>, reasons array<string>")
    return back.select("run_id", "result.state", "result.rule", "result.signals.claims_verified", F.size("result.reasons").cast("bigint").alias("reasons"))


@query("evl_expectations", qr._sql("""SELECT run_id AS id, run_id AS question_id, state_ok, documents_ok, positions_ok, CASE WHEN state_ok AND documents_ok AND positions_ok THEN 'PASS' WHEN run_id % 7 = 0 THEN 'GAP' ELSE 'FAIL' END AS outcome FROM (
  SELECT s.run_id, CASE WHEN s.run_id % 3 = 0 THEN state = 'CONFLICT' ELSE state IN ('HIGH', 'MEDIUM', 'LOW') END AS state_ok, EXISTS (SELECT 1 FROM vclaims v WHERE v.run_id = s.run_id AND v.document = d.doc) AS documents_ok,
    s.run_id % 5 <> 0 OR coalesce((SELECT string_agg(DISTINCT display, ',' ORDER BY display) FROM positions p JOIN results r USING (run_id, aspect_id) WHERE p.run_id = s.run_id AND status = 'conflict'), '') = '30 days,45 days' AS positions_ok
  FROM states s JOIN (SELECT run_id, min('File_' || document_id || '.pdf') AS doc FROM v4 GROUP BY 1) d ON d.run_id = s.run_id)"""))
def evl_expectations(spark, sf):
    run = F.col("run_id")
    expected = views.claim_table(spark, sf, "evidence").groupBy("run_id").agg(F.array(F.min("document")).alias("documents")).select(
        run.alias("id"), run.alias("question_id"), F.when(run % 3 == 0, F.array(F.lit("CONFLICT"))).otherwise(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW"))).alias("states"), "documents",
        F.when(run % 5 == 0, F.array(F.lit("30 days"), F.lit("45 days"))).otherwise(F.expr("cast(array() as array<string>)")).alias("positions"), (run % 7 == 0).alias("known_gap"))
    sides = F.flatten(F.transform(F.filter("results", lambda a: a["status"] == "conflict"), lambda a: F.transform(a["positions"], lambda p: p["display"])))
    results = qr.rated(spark, sf).select(run.alias("question_id"), "state", F.array_distinct(F.transform("claims", lambda c: c["document"])).alias("documents"), sides.alias("positions"))
    return evaluation.check_expectations(expected, results)


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return views.table(spark, sf, "events").select("event_id", F.concat(
        F.lit("ts="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" level="), F.when(failed, "WARN").otherwise("INFO"), F.lit(" stage="), F.col("event_type"), F.lit(" run="), F.col("user_id").cast("string"),
        F.when(failed, F.concat(F.lit(' error=Timeout detail="429 after retry ms=7"'))).otherwise(F.concat(F.lit(" ms="), F.round(F.col("value") * 10).cast("int").cast("string"), F.lit(' note="k v"')))).alias("line"))


@query("obs_stage_log", """SELECT event_type AS stage, CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS level, count(*) AS lines, count(*) FILTER (event_type <> 'error') AS timed,
  round(avg(CASE WHEN event_type <> 'error' THEN CAST(round(value * 10) AS BIGINT) END), 4) AS mean_ms, max(CASE WHEN event_type <> 'error' THEN CAST(round(value * 10) AS BIGINT) END) AS max_ms FROM events GROUP BY ALL""")
def obs_stage_log(spark, sf):
    return evaluation.stage_summary(evaluation.stage_lines(log_lines(spark, sf)))


# --- the whole batch -------------------------------------------------------------------------------------
def batch_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions (every benchmark item in each of four investigations), passages, and known facts: the lines of the items."""
    investigation = F.concat(F.lit("inv"), (F.regexp_replace("source", "src", "").cast("int") % 4).cast("string"))
    passages = views.passages(spark, sf).withColumns({
        "scope": investigation, "document": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))}).drop("source")
    items = views.table(spark, sf, "benchmark").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    asked = items.select((F.col("item_id") * 4 + F.col("k")).alias("question_id"), F.concat(F.lit("inv"), F.col("k").cast("string")).alias("scope"), F.col("text").alias("question"))
    facts = asked.select("question_id", F.posexplode(F.split("question", "\n")).alias("at", "line")).select(
        "question_id", (F.col("at") + 1).alias("fact_no"), F.concat(F.lit("Line "), (F.col("at") + 1).cast("string")).alias("label"), tx.squeeze(F.col("line")).alias("quote"),
        tx.squeeze(F.col("line")).alias("value"), F.lit("text").alias("value_type")).filter("quote <> ''")
    return runs.checked_questions(asked), passages, facts


def batch(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted questions answered, rejected ones with their code."""
    checked, passages, facts = batch_inputs(spark, sf)
    asked, rejected = checked.filter("code IS NULL").drop("code"), checked.filter("code IS NOT NULL")
    # passages feed the index, the statistics and the evidence: written once, read three times
    passages = tables.stored(passages, "passages")
    evidence = iv.retrieve(asked, passages)
    evidence = tables.stored(evidence, "evidence")
    # the document set of an investigation is part of the key under which its answers are stored
    documents = passages.groupBy("scope", "doc_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("text_hash")), ","), 256).alias("sha256")).withColumn("status", F.lit("ready"))
    questions = runs.with_cache_key(asked, runs.document_set_digests(documents), iv.PROMPT_VERSION, iv.RULES)
    answered = iv.run_rows(iv.investigate(questions, evidence, iv.extraction_from_facts(facts, evidence), keyword_only=True, source="none"))
    return answered.unionByName(rejected.select(F.col("question_id").alias("run_id"), "scope", "question", "code"), allowMissingColumns=True)


@query("run_investigations")
def run_investigations(spark, sf):
    return batch(spark, sf)
