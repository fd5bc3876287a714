"""Queries over prompts, stored replies and extracted claims."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, intake
from . import q_retrieval as qr
from . import views
from .catalog import query

SYSTEM = "Report what the passages state, as one JSON object with aspects, claims, supersession and answer."


_PROMPT_SQL = f"""
items AS (SELECT question_id, rank, 'E' || rank AS eid, 'say "doc" ' || doc_id AS document, ordinal + 1 AS page, CASE WHEN doc_id % 2 = 0 THEN 'Part "' || ordinal || '"' END AS section, text
  FROM chosen JOIN corpus USING (doc_id, ordinal)),
blocks AS (SELECT question_id, string_agg('<evidence id="' || eid || '" document="' || translate(document, '"', '''') || '" page="' || page || '" section="' || coalesce(translate(section, '"', ''''), 'n/a') || '">' || chr(10)
  || replace(text, '</evidence', '<\\/evidence') || chr(10) || '</evidence>', chr(10) ORDER BY rank) AS b FROM items GROUP BY ALL),
prompts AS (SELECT question_id, 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || b AS "user", sha256('{SYSTEM}' || chr(10) || '---' || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || b) AS recording_key
  FROM blocks JOIN questions USING (question_id))"""


def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieved evidence of every question, as the model would see it."""
    e = qr.evidence(spark, sf).select("question_id", "rank", "eid", F.concat(F.lit('say "doc" '), F.col("doc_id").cast("string")).alias("document"), (F.col("ordinal") + 1).alias("page"),
                                      F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Part "'), F.col("ordinal").cast("string"), F.lit('"'))).alias("section"), "text")
    return intake.prompts(qr.questions(spark, sf), e, SYSTEM)


@query("clm_prompt_build", qr._sql('SELECT question_id, "user", recording_key FROM prompts', qr._BM25_SQL, qr._DENSE_SQL, qr._FUSE_SQL, qr._CHOSEN_SQL, _PROMPT_SQL))
def clm_prompt_build(spark, sf):
    return prompt_rows(spark, sf).select("question_id", "user", "recording_key")


# --- prompts and recordings over conversations ------------------------------------------------------
def turn_prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.lit(SYSTEM).alias("system"),
        F.concat(F.lit("#"), (F.col("conv_id") + F.col("turn")).cast("string"), F.lit(" "), F.concat_ws("-", "conv_id", "turn"), F.lit(" "), F.col("text")).alias("user"))
    return c.withColumn("recording_key", intake.recording_key(F.col("system"), F.col("user")))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Stored replies of the first turns."""
    p = turn_prompts(spark, sf)
    return p.filter("turn = 0").select("recording_key", F.lit("stored-model").alias("model"), F.concat(F.lit('{"claims":[],"n":"'), F.col("question_id"), F.lit('"}')).alias("raw_response"))


def stub_client():
    """Offline stand-in for a model: fails, recovers or answers badly depending on the number in the prompt."""
    calls: dict = {}

    def call(model: str, history: list) -> str:
        number, name = history[1][1][1:].split(" ", 2)[:2]
        calls[name] = calls.get(name, 0) + 1
        case = int(number) % 5
        if case == 1 and calls[name] == 1:
            raise intake.CallFailed("HTTP 429", True)
        if case == 2 and model == "primary":
            raise intake.CallFailed("HTTP 500", True)
        if case == 3:
            raise intake.CallFailed("HTTP 401", False)
        if case == 4 and len(history) == 2:
            return "no json here {" if int(number) % 2 else '{"claims": "none", "aspects": []}'
        return 'Sure: {"claims": [], "aspects": []} done'
    return call


def called(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return intake.call_models(rows, stub_client, ["primary", "fallback"], callers=4)


_TURNS_SQL = f"turns AS (SELECT conv_id || '-' || turn AS question_id, turn, conv_id + turn AS n, sha256('{SYSTEM}' || chr(10) || '---' || chr(10) || '#' || (conv_id + turn) || ' ' || conv_id || '-' || turn || ' ' || text) AS recording_key FROM conversations)"


@query("clm_recording_join", f"""WITH {_TURNS_SQL} SELECT question_id, CASE WHEN turn = 0 THEN 'recording' WHEN n % 5 = 3 THEN 'none' ELSE 'live' END AS llm_source,
  CASE WHEN turn = 0 THEN 'stored-model' WHEN n % 5 = 3 THEN NULL WHEN n % 5 = 2 THEN 'fallback' ELSE 'primary' END AS model FROM turns""")
def clm_recording_join(spark, sf):
    p, stored = turn_prompts(spark, sf), recordings(spark, sf)
    _, to_send = intake.split_recorded(p, stored, "replay")
    return intake.resolve(p, stored, called(spark, sf, to_send), "replay").select("question_id", "llm_source", "model")


@query("clm_external_call", f"""WITH {_TURNS_SQL} SELECT recording_key, CASE WHEN n % 5 = 3 THEN 'unavailable' ELSE 'ok' END AS status, CASE n % 5 WHEN 2 THEN 'fallback' WHEN 3 THEN NULL ELSE 'primary' END AS model,
  CAST([1, 2, 3, 2, 2][n % 5 + 1] AS INTEGER) AS attempts, CASE WHEN n % 5 = 3 THEN 'fallback: HTTP 401' END AS error FROM turns""")
def clm_external_call(spark, sf):
    return called(spark, sf, turn_prompts(spark, sf)).drop("raw_response")


# --- replies assembled from claims ----------------------------------------------------------------------
_REPLY_COLUMNS = """run_id, claim_no, 'C' || CAST((claim_no - 1) % 5 + 1 AS STRING) AS id, CASE WHEN aspect_id = 'A9' THEN 'zz' ELSE aspect_id END AS aspect, evidence, quote,
    CASE WHEN claim_no % 9 = 5 THEN '42.5' ELSE value END AS value, CASE WHEN claim_no % 9 = 6 THEN 'weird' ELSE value_type END AS kind, scope, explicit"""
_ITEM_SQL = """'{"id":"' || id || '","aspect":"' || aspect || '","evidence":"' || evidence || '","quote":"' || quote || '","value":' || CASE WHEN claim_no % 9 = 5 THEN '42.5' ELSE '"' || value || '"' END
  || ',"value_type":"' || upper(kind) || '","scope":' || coalesce('"' || scope || '"', 'null') || CASE WHEN explicit THEN '' ELSE ',"explicit":false' END || ',"extra":{"a":"}"}}'"""
_ASPECT_SQL = """'{"id":"' || aspect_id || '","label":"' || label || '"}'"""
_ANSWER_SQL = """'{"text":"Statement ' || CAST(claim_no AS STRING) || '","claims":["' || id || '","nope"]}'"""
_ITEMS_SQL = f"""
reply_claims AS (SELECT {_REPLY_COLUMNS} FROM claims WHERE claim_no < 1000),
reply_items AS (SELECT run_id, claim_no, {_ITEM_SQL} AS item FROM reply_claims),
reply_aspects AS (SELECT run_id, aspect_no, {_ASPECT_SQL} AS item FROM aspects),
reply_answers AS (SELECT run_id, claim_no, {_ANSWER_SQL} AS item FROM reply_claims)"""
# the same items from one reading of the claim rows: a run's claims, statements and aspects are gathered together, in place where the rows are bucketed by run
_GATHERED_SQL = f""",
reply_rows AS (SELECT {_REPLY_COLUMNS}, aspect_no, topic FROM (SELECT {views.CLAIM_COLUMNS}, aspect_no, topic FROM (SELECT *, claim_no AS no FROM base))),
gathered AS (SELECT run_id, sort_array(collect_list(struct(claim_no, item, answer)) FILTER (WHERE claim_no < 1000)) AS said, {views.ASPECT_FLAGS}
  FROM (SELECT run_id, claim_no, aspect_no, topic, {_ITEM_SQL} AS item, {_ANSWER_SQL} AS answer FROM reply_rows) GROUP BY run_id),
reply_parts AS (SELECT run_id, array_join(said.item, ',') AS reply_items, array_join(said.answer, ',') AS reply_answers,
  concat_ws(',', {", ".join(f"CASE WHEN has{n} THEN (SELECT {_ASPECT_SQL} FROM (SELECT 'A{n}' AS aspect_id, '{label}' AS label)) END" for n, label in sorted(views.ASPECT_LABELS.items()))}) AS reply_aspects FROM gathered)"""


def reply_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Reply text by run: plain, fenced, inside prose, with a malformed item, claims not a list, truncated."""
    rows = views.claim_table(spark, sf, "reply_parts", _GATHERED_SQL.replace("{", "{{").replace("}", "}}"))
    case, lit = F.col("run_id") % 6, F.lit
    claims = F.when(case == 4, lit('"none"')).otherwise(F.concat(lit("["), F.when(case == 3, lit('{"id":5,"aspect":"A1"},"text",')).otherwise(""), F.col("reply_items"), lit("]")))
    body = F.concat(lit('{"aspects":['), F.col("reply_aspects"), lit('],"claims":'), claims, lit(',"supersession":[],"answer":['), F.col("reply_answers"), lit('],"ambiguous":true,"ambiguity_note":"two readings"}'))
    rows = tx.settled(rows.select("run_id", body.alias("body")), body=F.col("body"))
    fenced, prose = F.concat(lit("```json\n"), F.col("body"), lit("\n```")), F.concat(lit("Here is the result: "), F.col("body"), lit(" Done {x"))
    return rows.select("run_id", F.when(case == 1, fenced).when(case == 2, prose).when(case == 5, F.expr("left(body, length(body) - 20)")).otherwise(F.col("body")).alias("raw_response"),
                       F.concat(lit("model-"), (F.col("run_id") % 4).cast("string")).alias("model"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return intake.validated(intake.with_json(reply_texts(spark, sf)))


def _sql(select: str) -> str:
    return f"WITH {views.CLAIMS_SQL},{_ITEMS_SQL}\n{select}"


@query("clm_extract_json", _sql("""SELECT run_id, CASE WHEN run_id % 6 <> 5 THEN '{"aspects":[' || a || '],"claims":' || CASE WHEN run_id % 6 = 4 THEN '"none"' ELSE '[' || CASE WHEN run_id % 6 = 3 THEN '{"id":5,"aspect":"A1"},"text",' ELSE '' END || c || ']' END
  || ',"supersession":[],"answer":[' || s || '],"ambiguous":true,"ambiguity_note":"two readings"}' END AS json
FROM (SELECT run_id, string_agg(item, ',' ORDER BY claim_no) AS c FROM reply_items GROUP BY 1) JOIN (SELECT run_id, string_agg(item, ',' ORDER BY aspect_no) AS a FROM reply_aspects GROUP BY 1) USING (run_id)
  JOIN (SELECT run_id, string_agg(item, ',' ORDER BY claim_no) AS s FROM reply_answers GROUP BY 1) USING (run_id)"""))
def clm_extract_json(spark, sf):
    return intake.with_json(reply_texts(spark, sf)).select("run_id", "json")


@query("clm_lenient_validate", _sql("""SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY claim_no) - 1 AS INTEGER) AS pos, id, aspect, evidence, quote, value, CASE WHEN kind = 'weird' THEN 'text' ELSE kind END AS value_type, scope, explicit
FROM reply_claims WHERE run_id % 6 < 4"""))
def clm_lenient_validate(spark, sf):
    return replies(spark, sf).filter("valid").select("run_id", F.posexplode("claims").alias("pos", "c")).select("run_id", "pos", "c.*")


@query("clm_reissue_ids", _sql("""SELECT r.run_id, 'C' || r.claim_no AS claim_id, coalesce('A' || a.n, '') AS aspect_id, 'C' || f.first_no AS cited
FROM reply_claims r LEFT JOIN (SELECT run_id, aspect_id, row_number() OVER (PARTITION BY run_id ORDER BY aspect_no) AS n FROM aspects) a ON a.run_id = r.run_id AND a.aspect_id = r.aspect
  JOIN (SELECT run_id, id, min(claim_no) AS first_no FROM reply_claims GROUP BY ALL) f ON f.run_id = r.run_id AND f.id = r.id WHERE r.run_id % 6 < 4"""))
def clm_reissue_ids(spark, sf):
    own = intake.reissued(replies(spark, sf).filter("valid"))
    return own.select("run_id", F.explode(F.arrays_zip("claims", "answer")).alias("z")).select(
        "run_id", "z.claims.claim_id", "z.claims.aspect_id", F.array_join("z.answer.claims", ",").alias("cited"))


@query("clm_rule_extract", qr._sql(r"""SELECT question_id, CAST(fact_no AS INTEGER) AS fact_no, 'E' || rank AS evidence, doc_id, quote
FROM (SELECT question_id, o AS fact_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS quote FROM asked, unnest(string_split(question, chr(10))) WITH ORDINALITY AS u(line, o)) JOIN chosen USING (question_id)
  JOIN corpus USING (doc_id, ordinal) WHERE quote <> '' AND contains(text, quote)""", qr._PLANTED_SQL, qr._ASKED_BM25_SQL, qr._NO_DENSE_SQL, qr._KEYWORD_FUSE_SQL, qr._CHOSEN_SQL))
def clm_rule_extract(spark, sf):
    """The lines of an item are its facts; they are looked for in the passages that the item's question retrieves."""
    _, asked = qr.planted_questions(spark, sf)
    asked = asked.select("question_id", "scope", "question")
    facts = asked.select("question_id", F.posexplode(F.split("question", "\n")).alias("at", "line")).select(
        "question_id", (F.col("at") + 1).alias("fact_no"), F.concat(F.lit("Line "), F.col("at").cast("string")).alias("label"), tx.squeeze(F.col("line")).alias("quote"),
        tx.squeeze(F.col("line")).alias("value"), F.lit("text").alias("value_type")).filter("quote <> ''")
    located = qr.corpus(spark, sf).withColumns({"document": F.col("doc_id").cast("string"), "extraction_method": F.lit("text"), "ocr_confidence": F.lit(None).cast("double")})
    found = qr.rt.evidence_items(qr.keyword_chosen(spark, sf, asked), located)
    return intake.rule_claims(facts, found).join(found.select("question_id", F.col("eid").alias("evidence"), "doc_id"), ["question_id", "evidence"]).select(
        "question_id", "fact_no", "evidence", "doc_id", "quote")


@query("evl_extractor_quality", _sql("""SELECT 'model-' || (run_id % 4) AS model, count(DISTINCT run_id) AS replies, count(DISTINCT run_id) FILTER (run_id % 6 < 4) AS valid, count(claim_no) FILTER (run_id % 6 < 4) AS claims,
  count(*) FILTER (run_id % 6 < 4 AND contains(text, quote)) AS exact, count(*) FILTER (run_id % 6 < 4 AND contains(lower(text), lower(quote))) AS loose
FROM reply_claims LEFT JOIN (SELECT run_id, eid AS evidence, text FROM evidence) USING (run_id, evidence) GROUP BY 1"""))
def evl_extractor_quality(spark, sf):
    return evaluation.extractor_quality(replies(spark, sf), views.claim_table(spark, sf, "evidence").select("run_id", F.col("eid").alias("evidence"), "text"))
