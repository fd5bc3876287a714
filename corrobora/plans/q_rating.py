"""Queries over evidence states, reasons, sentences, citations and headlines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import wording
from ..operators import composition as cm
from ..operators import conflicts as cf
from ..operators import layout, rating
from ..operators import verification as vf
from . import q_conflicts as qc
from . import q_verification as qv
from . import views
from .catalog import query

SEP = " || "


def evidence_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every run in order, with the related-passage fields."""
    e = views.claim_table(spark, sf, "evidence").withColumnRenamed("paragraph", "rank")
    item = F.struct("rank", "eid", "chunk_id", "document_id", "document", "page", "section", F.substring("text", 1, fixed.RELATED_CHARS).alias("quote"),
                    "extraction_method", layout.quality_band(F.col("extraction_method"), F.col("ocr_confidence")).alias("ocr_quality"))
    return e.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    d = views.run_flags(spark, sf, "drafts", True).select("run_id", "sentence_no", "text", F.array_compact(F.array("c1", "c2")).alias("claims"))
    return d.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence_no", "text", "claims"))), lambda x: F.struct(
        x["text"].alias("text"), x["claims"].alias("claims"))).alias("answer"))


def rated(spark: SparkSession, sf: str, noted: bool = False, fields: list[str] = cf.RATED) -> DataFrame:
    """Rated runs; `noted` for readers of reasons, which name the notes."""
    evidence = views.claim_table(spark, sf, "evidence").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    rows = qc.cases(spark, sf, True, fields, noted).join(evidence, "run_id", "left")
    rows = rows.withColumns({"n_evidence": F.when(F.col("has_documents"), F.coalesce("n_evidence", F.lit(0))).otherwise(0),
                             "llm_source": F.when(F.col("evidence_only") | ~F.col("has_documents"), "none").otherwise("live")})
    return rating.rated(rows, reasons=noted)


def composed(spark: SparkSession, sf: str, related: bool = True) -> DataFrame:
    """Composed runs; `related` for readers of the related passages."""
    rows = rated(spark, sf, noted=related, fields=cf.CLAIM).join(drafts(spark, sf), "run_id", "left")
    if related:
        rows = rows.join(evidence_arrays(spark, sf), "run_id", "left")
        rows = rows.withColumn("evidence", F.when(F.col("has_documents"), F.col("evidence")).otherwise(F.slice("evidence", 1, 0)))
    rows = rows.withColumn("answer", F.coalesce("answer", F.expr("cast(array() as array<struct<text:string,claims:array<string>>>)")))
    return cm.with_result(cm.with_citations(cm.with_sentences(rows)))


_SUPPORT_SQL = """
support AS (SELECT t.run_id, t.aspect_no, t.aspect_id, t.label, t.status, t.basis, t.np, coalesce(least(count(DISTINCT document_id) FILTER (explicit), count(DISTINCT text_hash) FILTER (explicit)), 0) AS ind,
    coalesce(bool_or(ocr_quality IS DISTINCT FROM 'low') FILTER (explicit), false) AS clear, count(DISTINCT document) AS nd, arg_min(document, claim_no) AS doc1
  FROM results t LEFT JOIN vclaims USING (run_id, aspect_id) GROUP BY ALL),
run_claims AS (SELECT run_id, count(*) AS verified, count(DISTINCT document_id) AS docs, count(*) FILTER (explicit) AS explicit_claims, count(*) FILTER (extraction_method = 'ocr') AS ocr_claims,
  count(*) FILTER (ocr_quality = 'low') AS ocr_low FROM vclaims GROUP BY 1),
run_aspects AS (SELECT run_id, count(*) AS aspects_total, count(*) FILTER (status <> 'uncovered') AS covered, count(*) FILTER (status = 'conflict') AS conflicts FROM results GROUP BY 1),
run_checked AS (SELECT run_id, count(*) AS extracted, count(*) FILTER (drop_reason <> 'duplicate') AS lost FROM checked JOIN live USING (run_id) GROUP BY 1),
run_evidence AS (SELECT run_id, count(*) AS n_evidence FROM evidence JOIN runs USING (run_id) WHERE has_documents GROUP BY 1),
signals AS (SELECT r.*, coalesce(n_evidence, 0) AS evidence_retrieved, coalesce(extracted, 0) AS claims_extracted, coalesce(verified, 0) AS claims_verified, coalesce(lost, 0) AS claims_dropped, coalesce(docs, 0) AS documents_cited,
    coalesce(aspects_total, 0) AS aspects_total, coalesce(covered, 0) AS aspects_covered, coalesce(conflicts, 0) AS conflicting_aspects, coalesce(explicit_claims, 0) AS explicit_claims, coalesce(ocr_claims, 0) AS ocr_claims,
    coalesce(ocr_low, 0) AS ocr_low_claims, coalesce(verified, 0) - coalesce(explicit_claims, 0) AS inferred_claims, coalesce(aspects_total, 0) - coalesce(covered, 0) AS aspects_uncovered, coalesce(agreeing, 0) AS agreeing_documents,
    check_failed AS conflict_check_failed, CASE WHEN evidence_only OR NOT has_documents THEN 'none' ELSE 'live' END AS llm_source
  FROM runs r LEFT JOIN run_claims USING (run_id) LEFT JOIN run_aspects USING (run_id) LEFT JOIN run_checked USING (run_id) LEFT JOIN run_evidence USING (run_id)
    LEFT JOIN (SELECT run_id, max(n_docs) AS agreeing FROM positions GROUP BY 1) USING (run_id)),
ruled AS (SELECT s.*, CASE WHEN evidence_only THEN 1 WHEN NOT has_documents OR claims_verified = 0 THEN 2 WHEN conflicting_aspects > 0 THEN 3 WHEN ambiguous THEN 4 WHEN aspects_uncovered > 0 THEN 5 WHEN explicit_claims = 0 THEN 6
    WHEN ocr_low_claims = claims_verified THEN 7 WHEN NOT check_failed AND NOT EXISTS (SELECT 1 FROM support x WHERE x.run_id = s.run_id AND NOT (ind >= 2 AND clear)) THEN 8 ELSE 9 END AS rule FROM signals s),
states AS (SELECT *, ['LOW', 'INSUFFICIENT', 'CONFLICT', 'LOW', 'LOW', 'LOW', 'LOW', 'HIGH', 'MEDIUM'][rule] AS state FROM ruled)"""

_REASONS_SQL = """
reason_rows AS (
  SELECT run_id, 0 AS o1, 0 AS o2, 0 AS o3, claims_verified || CASE WHEN claims_verified = 1 THEN ' relevant passage was' ELSE ' relevant passages were' END || ' confirmed across ' || documents_cited || CASE WHEN documents_cited = 1 THEN ' document.' ELSE ' documents.' END AS reason FROM states WHERE claims_verified > 0
  UNION ALL SELECT run_id, 1, 0, 0, CASE rule WHEN 1 THEN 'Automatic analysis was unavailable, so only the closest passages are shown.' WHEN 4 THEN 'The question can be read in more than one way' || coalesce(': ' || ambiguity_note, '.')
      WHEN 6 THEN 'The documents do not state this directly; the answer is inferred.' WHEN 7 THEN 'All supporting text comes from a low-quality scan.'
      ELSE CASE WHEN has_documents THEN 'None of the retrieved passages states an answer to this question.' ELSE 'No processed documents are available yet.' END END FROM states WHERE rule IN (1, 2, 4, 6, 7)
  UNION ALL SELECT run_id, 1, aspect_no, 0, string_agg(n_docs || CASE WHEN n_docs = 1 THEN ' document states ' ELSE ' documents state ' END || display, '; ' ORDER BY pos_no) || '.' FROM states JOIN results USING (run_id) JOIN positions USING (run_id, aspect_id) WHERE rule = 3 AND status = 'conflict' GROUP BY run_id, aspect_no
  UNION ALL SELECT run_id, 1, 1000, 0, 'Because the documents disagree, no single answer is given.' FROM states WHERE rule = 3
  UNION ALL SELECT run_id, 1, 0, 0, 'No evidence was found for: ' || string_agg(lower(left(label, 1)) || substr(label, 2), ', ' ORDER BY aspect_no) || '.' FROM states JOIN results USING (run_id) WHERE rule = 5 AND status = 'uncovered' GROUP BY run_id
  UNION ALL SELECT run_id, 1, 0, 0, min(ind) || ' independent documents state the same thing directly.' FROM states JOIN support USING (run_id) WHERE rule = 8 GROUP BY run_id
  UNION ALL SELECT run_id, 1, -1, 0, 'The conflict check could not be completed.' FROM states WHERE rule = 9 AND check_failed
  UNION ALL SELECT run_id, 1, aspect_no, 0, CASE WHEN nd = 1 THEN 'Only one document (' || doc1 || ') states ' || CASE WHEN aspects_total = 1 THEN 'this' ELSE lower(left(label, 1)) || substr(label, 2) END || '.'
      WHEN ind < 2 THEN 'Only one document states ' || lower(left(label, 1)) || substr(label, 2) || ' directly.' ELSE 'Support for ' || lower(left(label, 1)) || substr(label, 2) || ' comes only from low-quality scans.' END
    FROM states JOIN support USING (run_id) WHERE rule = 9 AND NOT (ind >= 2 AND clear)
  UNION ALL SELECT run_id, 2, aspect_no, entry_no, document || ' states that it replaces an earlier provision' || CASE WHEN status = 'conflict' THEN '; the conflict is still shown so you can decide.' ELSE '.' END FROM attached JOIN results USING (run_id, aspect_id)
  UNION ALL SELECT run_id, 3, 0, 0, ocr_claims || CASE WHEN ocr_claims = 1 THEN ' passage comes' ELSE ' passages come' END || ' from scanned images.' FROM states WHERE ocr_claims > 0
  UNION ALL SELECT run_id, 4, aspect_no, 0, 'Positions on ' || lower(left(label, 1)) || substr(label, 2) || ' were compared as text, which is less exact than numeric comparison.' FROM results WHERE basis = 'text' AND np > 1
  UNION ALL SELECT run_id, 4, aspect_no, 1, 'Different values apply to different conditions' || coalesce(': ' || (SELECT string_agg(scope, ', ' ORDER BY no) FROM (SELECT scope, min(claim_no) AS no FROM vclaims v WHERE v.run_id = r.run_id AND v.aspect_id = r.aspect_id AND scope IS NOT NULL GROUP BY scope)), '') || '.'
    FROM results r WHERE status = 'complementary'
  UNION ALL SELECT run_id, 5, 0, 0, claims_dropped || CASE WHEN claims_dropped = 1 THEN ' extracted statement was' ELSE ' extracted statements were' END || ' discarded because the quote could not be found in the source.' FROM states WHERE claims_dropped > 0),
reason_lists AS (SELECT run_id, string_agg(reason, ' || ' ORDER BY o) AS reasons FROM (SELECT run_id, reason, min((o1, o2, o3)) AS o FROM reason_rows GROUP BY ALL) GROUP BY 1)"""

_SENTENCES_SQL = r"""
said AS (SELECT run_id, 0 AS g, aspect_no * 1000 + pos_no AS o, CASE WHEN len(names) = 1 THEN names[1] || ' states ' ELSE array_to_string(names[:-2], ', ') || ' and ' || names[-1] || ' state ' END || display || '.' AS text, ids
    FROM positions JOIN results USING (run_id, aspect_id) WHERE status = 'conflict'),
cites AS (SELECT run_id, sentence_no, text, [c1, c2] AS cs FROM drafts JOIN live USING (run_id)),
kept AS (SELECT run_id, 1 AS g, sentence_no AS o, left(trim(regexp_replace(text, '\s*[\(\[]\s*[EC]\d+(\s*(,|and|&)\s*[EC]\d+)*\s*[\)\]]', '', 'g')), 400) AS text, list_filter(cs, lambda c: c IS NOT NULL) AS ids FROM cites
  WHERE len(list_filter(cs, lambda c: c IS NOT NULL)) > 0),
good AS (SELECT k.* FROM kept k WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(k.ids) AS cid) u LEFT JOIN vclaims v ON v.run_id = k.run_id AND v.claim_id = u.cid LEFT JOIN results r ON r.run_id = v.run_id AND r.aspect_id = v.aspect_id
  WHERE v.claim_id IS NULL OR r.status = 'conflict')),
first_lists AS (SELECT * FROM said UNION ALL SELECT * FROM good),
defaults AS (SELECT run_id, 2 AS g, claim_no AS o, document || ' states: ' || CASE WHEN position_key IS NOT NULL THEN value ELSE '"' || quote || '"' END || '.' AS text, [claim_id] AS ids FROM vclaims WHERE run_id NOT IN (SELECT run_id FROM first_lists)),
sentences AS (SELECT run_id, text, ids, CAST(row_number() OVER (PARTITION BY run_id ORDER BY g, o) - 1 AS INTEGER) AS sentence_no, g FROM (SELECT * FROM first_lists UNION ALL SELECT * FROM defaults)),
uses AS (SELECT run_id, claim_id, min((sentence_no, i)) AS o FROM sentences, unnest(ids) WITH ORDINALITY AS u(claim_id, i) GROUP BY ALL),
citations AS (SELECT v.run_id, v.claim_id, CAST(row_number() OVER (PARTITION BY v.run_id ORDER BY u.o NULLS LAST, v.claim_no) AS INTEGER) AS citation FROM vclaims v LEFT JOIN uses u USING (run_id, claim_id))"""


def _sql(select: str, *parts: str) -> str:
    return views.conflicts_sql(select, True, _SUPPORT_SQL, *parts)


@query("unc_independent_docs", _sql("SELECT run_id, aspect_id, CAST(ind AS INTEGER) AS independent FROM support"))
def unc_independent_docs(spark, sf):
    return rated(spark, sf).select("run_id", F.explode("support").alias("s")).select("run_id", "s.aspect_id", "s.independent")


@query("unc_well_supported", _sql("SELECT run_id, aspect_id, ind >= 2 AND clear AS well_supported FROM support"))
def unc_well_supported(spark, sf):
    return rated(spark, sf).select("run_id", F.explode("support").alias("s")).select("run_id", "s.aspect_id", "s.well_supported")


@query("unc_state", _sql("SELECT run_id, state, rule FROM states"))
def unc_state(spark, sf):
    return rated(spark, sf).select("run_id", "state", "rule")


@query("unc_reasons", _sql("SELECT run_id, reasons FROM reason_lists", _REASONS_SQL))
def unc_reasons(spark, sf):
    return rated(spark, sf, noted=True).select("run_id", F.array_join("reasons", SEP).alias("reasons"))


@query("unc_signals", _sql(f"SELECT run_id, {', '.join(rating.SIGNALS)} FROM states"))
def unc_signals(spark, sf):
    return rated(spark, sf).select("run_id", "signals.*")


@query("unc_warnings", _sql("""SELECT run_id, CASE WHEN has_documents THEN array_to_string(list_filter([CASE WHEN evidence_only THEN 'Automatic analysis unavailable.' END, CASE WHEN ocr_claims > 0 THEN ocr_claims || CASE WHEN ocr_claims = 1 THEN ' passage comes' ELSE ' passages come' END || ' from scanned images.' END,
  CASE WHEN check_failed THEN 'The conflict check could not be completed.' END, CASE WHEN run_id % 7 = 0 THEN 'Semantic search is unavailable; keyword search only.' END], lambda w: w IS NOT NULL), ' || ') ELSE '' END AS warnings FROM states"""))
def unc_warnings(spark, sf):
    """Warnings count the claims of a run and need neither its arrays nor its positions."""
    counted = cf.scanned_claims(views.run_flags(spark, sf, "runs", True), qv.checked(spark, sf))
    rows = counted.withColumn("signals", F.struct("ocr_claims"))
    return rating.with_warnings(rows, F.col("run_id") % 7 == 0).select("run_id", F.array_join("warnings", SEP).alias("warnings"))


@query("cmp_conflict_sentences", _sql("SELECT run_id, text, array_to_string(ids, ',') AS claim_ids FROM said", _SENTENCES_SQL))
def cmp_conflict_sentences(spark, sf):
    return qc.cases(spark, sf, True).select("run_id", F.explode(cm.conflict_sentences()).alias("s")).select("run_id", "s.text", F.array_join("s.claim_ids", ",").alias("claim_ids"))


@query("cmp_filter_drafts", _sql("SELECT run_id, text, array_to_string(ids, ',') AS claim_ids FROM good WHERE run_id IN (SELECT run_id FROM states WHERE state <> 'INSUFFICIENT')", _SENTENCES_SQL))
def cmp_filter_drafts(spark, sf):
    s = composed(spark, sf, related=False).select("run_id", F.explode("sentences").alias("s")).select("run_id", "s.text", F.array_join("s.claim_ids", ",").alias("claim_ids"))
    return s.filter("text LIKE 'Statement %'")


@query("cmp_strip_ids", _sql(r"SELECT run_id, sentence_no, trim(regexp_replace(text, '\s*[\(\[]\s*[EC]\d+(\s*(,|and|&)\s*[EC]\d+)*\s*[\)\]]', '', 'g')) AS text FROM drafts"))
def cmp_strip_ids(spark, sf):
    return views.run_flags(spark, sf, "drafts", True).select("run_id", "sentence_no", cm.without_ids(F.col("text")).alias("text"))


@query("cmp_default_sentences", _sql("SELECT run_id, sentence_no, text, array_to_string(ids, ',') AS claim_ids FROM sentences WHERE g = 2", _SENTENCES_SQL))
def cmp_default_sentences(spark, sf):
    s = composed(spark, sf, related=False).select("run_id", F.posexplode("sentences").alias("sentence_no", "s"))
    return s.filter("s.text LIKE '% states: %'").select("run_id", "sentence_no", "s.text", F.array_join("s.claim_ids", ",").alias("claim_ids"))


@query("cmp_citations", _sql("SELECT run_id, claim_id, citation FROM citations", _SENTENCES_SQL))
def cmp_citations(spark, sf):
    return composed(spark, sf, related=False).select("run_id", F.explode("claims").alias("c")).select("run_id", "c.claim_id", "c.citation")


@query("cmp_headline", _sql("""SELECT run_id, state, CASE WHEN evidence_only THEN 'Automatic analysis is unavailable right now. These are the most relevant passages.' WHEN state = 'INSUFFICIENT' THEN 'The uploaded documents do not contain enough evidence to answer this.'
    WHEN state = 'CONFLICT' THEN 'The documents disagree on ' || (SELECT CASE WHEN count(*) = 1 THEN max(l) ELSE array_to_string(list(l ORDER BY aspect_no)[:-2], ', ') || ' and ' || list(l ORDER BY aspect_no)[-1] END FROM (SELECT aspect_no, lower(left(label, 1)) || substr(label, 2) AS l FROM results r WHERE r.run_id = s.run_id AND status = 'conflict')) || '.'
    ELSE (SELECT text FROM sentences x WHERE x.run_id = s.run_id AND sentence_no = 0) END AS headline,
  CASE WHEN state = 'INSUFFICIENT' THEN 0 ELSE coalesce(nsent, 0) END AS sentences, CASE WHEN state = 'INSUFFICIENT' THEN 0 ELSE claims_verified END AS claims,
  CASE WHEN evidence_only THEN least(5, evidence_retrieved) WHEN state = 'INSUFFICIENT' THEN least(3, evidence_retrieved) ELSE 0 END AS related
FROM states s LEFT JOIN (SELECT run_id, count(*) AS nsent FROM sentences GROUP BY 1) USING (run_id)""", _SENTENCES_SQL))
def cmp_headline(spark, sf):
    return composed(spark, sf).select("run_id", "state", "headline", *[F.size(c).cast("bigint").alias(c) for c in ("sentences", "claims", "related")])


@query("ver_grounding_runs", _sql("""SELECT run_id, claims, related, CASE WHEN run_id % 7 = 3 THEN claims ELSE 0 END AS bad_claims, CASE WHEN run_id % 7 = 4 THEN related ELSE 0 END AS bad_related, 0::BIGINT AS bad_notes,
  CASE WHEN run_id % 7 = 5 THEN sentences ELSE 0 END AS unknown_citations
FROM (SELECT run_id, CASE WHEN state = 'INSUFFICIENT' THEN 0 ELSE coalesce(nsent, 0) END AS sentences, CASE WHEN state = 'INSUFFICIENT' THEN 0 ELSE claims_verified END AS claims,
    CASE WHEN evidence_only THEN least(5, evidence_retrieved) WHEN state = 'INSUFFICIENT' THEN least(3, evidence_retrieved) ELSE 0 END AS related
  FROM states s LEFT JOIN (SELECT run_id, count(*) AS nsent FROM sentences GROUP BY 1) USING (run_id))""", _SENTENCES_SQL))
def ver_grounding_runs(spark, sf):
    """Everything that composed runs show, some of it tampered with: pages of claims, documents of related passages, cited ids."""
    run = F.col("run_id")
    rows = composed(spark, sf).withColumns({
        "claims": F.when(run % 7 == 3, F.transform("claims", lambda c: c.withField("page", F.coalesce(c["page"], F.lit(0)) + 1))).otherwise(F.col("claims")),
        "related": F.when(run % 7 == 4, F.transform("related", lambda r: r.withField("document_id", r["document_id"] + 1))).otherwise(F.col("related")),
        "sentences": F.when(run % 7 == 5, F.transform("sentences", lambda s: s.withField("claim_ids", F.concat(s["claim_ids"], F.array(F.lit("C999999")))))).otherwise(F.col("sentences")), "scope": run})
    passages = views.claim_table(spark, sf, "evidence").unionByName(views.claim_table(spark, sf, "note_evidence")).withColumn("scope", run)
    return vf.audit_runs(rows, passages).drop("notes")


@query("cmp_locations", views.claims_sql(r"""SELECT run_id, eid, coalesce(nullif(concat_ws(' · ', CASE WHEN page IS NOT NULL THEN 'Page ' || page END, section), ''), 'Paragraph ' || paragraph) AS location,
  replace(replace(document, '.pdf', ''), '_', ' ') AS name, replace(replace(document, '.pdf', ''), '_', ' ') || ' states: ' || text AS sentence FROM evidence"""))
def cmp_locations(spark, sf):
    e = views.claim_table(spark, sf, "evidence")
    said = F.concat("document", F.lit(" states: "), "text")
    return e.select("run_id", "eid", wording.location(F.col("page"), F.col("section"), F.col("paragraph")).alias("location"),
                    wording.readable_name(F.col("document")).alias("name"), wording.with_readable_names(said, F.array("document")).alias("sentence"))


@query("cmp_why_facts", _sql("""SELECT run_id, array_to_string(list_filter([claims_verified || CASE WHEN claims_verified = 1 THEN ' verified passage' ELSE ' verified passages' END, documents_cited || CASE WHEN documents_cited = 1 THEN ' supporting document' ELSE ' supporting documents' END,
  CASE WHEN explicit_claims > 0 THEN explicit_claims || ' stated directly' END, CASE WHEN inferred_claims > 0 THEN inferred_claims || ' inferred' END, CASE WHEN ocr_claims > 0 THEN ocr_claims || ' from scans' END,
  CASE WHEN conflicting_aspects > 0 THEN conflicting_aspects || CASE WHEN conflicting_aspects = 1 THEN ' conflict' ELSE ' conflicts' END END, CASE WHEN aspects_uncovered > 0 THEN aspects_uncovered || CASE WHEN aspects_uncovered = 1 THEN ' part' ELSE ' parts' END || ' unanswered' END,
  CASE WHEN claims_dropped > 0 THEN claims_dropped || ' discarded as unverifiable' END], lambda f: f IS NOT NULL), ', ') AS facts FROM states"""))
def cmp_why_facts(spark, sf):
    return rated(spark, sf).select("run_id", F.array_join(rating.facts(F.col("signals")), ", ").alias("facts"))
