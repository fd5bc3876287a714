"""The whole batch in one job: questions -> cache -> retrieval -> claims -> checks -> conflicts -> state -> stored runs."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources import tables
from ..operators import composition, conflicts, indexing, layout, rating, retrieval, runs, verification

PROMPT_VERSION, RULES = "v1", "rules"      # parts of the key under which an answer is stored
RESULT = ["run_id", "scope", "question", "state", "headline", "degraded", "sentences", "results", "claims", "signals", "reasons", "related", "warnings"]


def retrieve(questions: DataFrame, passages: DataFrame, question_vectors: DataFrame | None = None, passage_vectors: DataFrame | None = None) -> DataFrame:
    """Evidence items of every question. Without vectors the keyword ranking stands alone."""
    # the postings are the index: written once, read for the statistics and for the scores
    postings = tables.stored(indexing.postings(passages), "postings")
    corpus = indexing.corpus_stats(postings)
    bm25 = retrieval.bm25_top(questions, postings, indexing.term_stats(postings, corpus), corpus)
    if question_vectors is not None and passage_vectors is not None:
        dense = retrieval.dense_top(question_vectors, passage_vectors)
    else:
        dense = bm25.filter(F.lit(False)).withColumn("dense_rank", F.lit(None).cast("int"))
    return retrieval.evidence_items(retrieval.diverse(retrieval.fuse(bm25, dense)), passages.drop("scope"))


def extraction_from_facts(facts: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Claims by rule from known fact phrases: one aspect per fact label, one claim per passage holding the phrase."""
    from ..operators.intake import rule_claims
    found = rule_claims(facts, evidence).withColumn("aspect_no", F.col("fact_no").cast("int"))
    order = F.struct("fact_no", "rank")
    rows = found.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "aspect_no", "evidence", "quote", "value", "value_type", "scope", "explicit"))).alias("c"))
    claims = rows.select(F.col("question_id").alias("run_id"), F.posexplode("c").alias("p", "c")).select(
        "run_id", (F.col("p") + 1).alias("claim_no"), F.concat(F.lit("C"), (F.col("p") + 1).cast("string")).alias("claim_id"),
        F.concat(F.lit("A"), F.col("c.aspect_no").cast("string")).alias("aspect_id"), *[f"c.{f}" for f in ("evidence", "quote", "value", "value_type", "scope", "explicit")])
    aspects = found.select(F.col("question_id").alias("run_id"), "aspect_no", F.concat(F.lit("A"), F.col("aspect_no").cast("string")).alias("aspect_id"), "label").distinct()
    entries = claims.filter(F.lit(False)).select("run_id", F.col("claim_no").alias("entry_no"), "evidence", "quote", "aspect_id")
    answers = claims.groupBy("run_id").agg(F.expr("cast(array() as array<struct<text:string,claims:array<string>>>)").alias("answer"))
    return {"claims": claims, "aspects": aspects, "entries": entries, "answers": answers}


def extraction_from_replies(replies: DataFrame) -> dict[str, DataFrame]:
    """Claims, aspects, supersession entries and draft answers of validated replies with own ids (one row per run_id)."""
    valid = replies.filter("valid")
    def rows(name):
        return valid.select("run_id", F.explode(name).alias("x")).select("run_id", "x.*")
    return {"claims": rows("claims"), "aspects": rows("aspects"), "entries": rows("entries"), "answers": valid.select("run_id", "answer", "ambiguous", "ambiguity_note")}


def _marked(rows: DataFrame, some: DataFrame, name: str) -> DataFrame:
    """Adds a flag that is true for the runs in `some` (question_id)."""
    marks = some.select(F.col("question_id").alias("run_id"), F.lit(True).alias(name)).distinct()
    return rows.join(marks, "run_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def investigate(questions: DataFrame, evidence: DataFrame, extracted: dict[str, DataFrame], unavailable: DataFrame | None = None, keyword_only: bool | DataFrame = False,
                source: str | DataFrame = "live", check_failed: DataFrame | None = None) -> DataFrame:
    """One result row per question.

    questions: question_id, scope, question, has_documents; evidence: items of `retrieve`;
    with a column cache_key if the rows are to be stored; unavailable: question_id of questions whose reply could not be had or read (answered with passages only);
    keyword_only: no vectors took part, or question_id of questions for which none did; source: where the claims come from, or question_id, llm_source and model; check_failed: question_id whose conflict check failed.
    """
    items = evidence.withColumnRenamed("question_id", "run_id").withColumns({
        "chunk_id": F.concat_ws("-", "doc_id", "ordinal"), "document_id": F.col("doc_id")})
    asked = questions.withColumnRenamed("question_id", "run_id")
    if unavailable is None:
        asked = asked.withColumn("evidence_only", F.lit(False))
    else:
        asked = _marked(asked, unavailable, "evidence_only")
    answers = extracted["answers"]
    for name, default in (("ambiguous", F.lit(False)), ("ambiguity_note", F.lit(None).cast("string"))):
        if name not in answers.columns:
            answers = answers.withColumn(name, default)
    shown = F.struct("rank", "eid", "chunk_id", "document_id", "document", "page", "section", "paragraph", F.substring("text", 1, fixed.RELATED_CHARS).alias("quote"),
                     "extraction_method", layout.quality_band(F.col("extraction_method"), F.col("ocr_confidence")).alias("ocr_quality"))
    per_run = items.groupBy("run_id").agg(F.sort_array(F.collect_list(shown)).alias("evidence"))
    flagged = asked.join(per_run, "run_id", "left").join(answers, "run_id", "left")
    kind = dict(flagged.dtypes)["evidence"]
    flagged = flagged.withColumns({
        "evidence": F.coalesce("evidence", F.expr(f"cast(array() as {kind})")), "ambiguous": F.coalesce("ambiguous", F.lit(False)),
        "answer": F.coalesce("answer", F.expr("cast(array() as array<struct<text:string,claims:array<string>>>)")), "check_failed": F.lit(False)})
    if isinstance(keyword_only, DataFrame):
        flagged = _marked(flagged, keyword_only, "keyword_only")
    else:
        flagged = flagged.withColumn("keyword_only", F.lit(keyword_only))
    if check_failed is not None:
        flagged = _marked(flagged.drop("check_failed"), check_failed, "check_failed")
    if isinstance(source, DataFrame):
        flagged = flagged.join(source.select(F.col("question_id").alias("run_id"), "llm_source", "model"), "run_id", "left")
    else:
        flagged = flagged.withColumns({"llm_source": F.lit(source), "model": F.lit(None).cast("string")})
    silent = F.col("evidence_only") | (F.size("evidence") == 0)
    flagged = flagged.withColumns({"n_evidence": F.size("evidence"), "llm_source": F.when(silent, "none").otherwise(F.col("llm_source")), "model": F.when(~silent, F.col("model"))})
    checked = verification.check_claims(extracted["claims"], items, extracted["aspects"])
    notes = verification.supersession_notes(extracted["entries"], items)
    rows = rating.rated(conflicts.case_rows(flagged, extracted["aspects"], checked, notes), F.col("keyword_only"))
    done = composition.with_result(composition.with_citations(composition.with_sentences(rows)))
    return done.withColumn("servable", ~runs.degraded(F.col("evidence_only"), F.col("check_failed")))


def run_rows(results: DataFrame, model: str | None = RULES) -> DataFrame:
    """Stored form: one JSON document per run next to the columns that lookups need; the model is the one given, or else the one that replied. In the JSON `degraded` says that the answer has passages only;
    the column also covers a failed conflict check, after which a run is not served again."""
    shown = results.withColumn("degraded", F.col("evidence_only"))
    body = F.to_json(F.struct(*[F.col(c) for c in RESULT]), {"ignoreNullFields": "false"})
    return shown.withColumn("result_json", body).select(
        "run_id", "scope", "question", "state", "rule", (~F.col("servable")).alias("degraded"), "headline", "result_json", "cache_key", (F.col("model") if model is None else F.lit(model)).alias("model"),
        F.current_timestamp().alias("created_at"), F.col("run_id").cast("bigint").alias("run_no"), F.lit(None).cast("string").alias("code"))


def from_cache_or(asked: DataFrame, stored: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cached rows, newly answered rows): only questions without a servable run are answered."""
    looked = runs.cache_lookup(asked, stored)
    hits = looked.filter("cached_run IS NOT NULL")
    return hits, answer(looked.filter("cached_run IS NULL").drop("cached_run"))
