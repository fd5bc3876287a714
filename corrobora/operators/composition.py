"""Answers from verified claims only: sentences, citations, headline, related passages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import settled, strip
from ..functions.wording import joined, lower_first

SENTENCES = "array<struct<text:string,claim_ids:array<string>>>"


def _sentence(text: Column, claim_ids: Column) -> Column:
    return F.struct(text.alias("text"), claim_ids.alias("claim_ids"))


def without_ids(text: Column) -> Column:
    return F.substring(strip(F.regexp_replace(text, fixed.EVIDENCE_IDS, "")), 1, fixed.SENTENCE_MAX)


def conflict_sentences() -> Column:
    """One sentence per position of every conflicting aspect, naming its documents."""
    def said(p):
        verb = F.when(F.size(p["documents"]) == 1, " states ").otherwise(" state ")
        return _sentence(F.concat(joined(p["documents"]), verb, p["display"], F.lit(".")), p["claim_ids"])
    return F.flatten(F.transform(F.filter("results", lambda a: a["status"] == "conflict"), lambda a: F.transform(a["positions"], said)))


def kept_drafts() -> Column:
    """Draft sentences whose cited claims are all verified and none of them is about a conflicting aspect."""
    clean = F.transform("answer", lambda s: _sentence(without_ids(s["text"]), F.array_distinct(s["claims"])))
    return F.filter(clean, lambda s: (s["text"] != "") & (F.size(s["claim_ids"]) > 0)
                    & F.forall(s["claim_ids"], lambda c: F.array_contains("_verified", c)) & ~F.arrays_overlap(s["claim_ids"], F.col("_disputed")))


def default_sentences() -> Column:
    return F.transform("claims", lambda c: _sentence(
        F.concat(c["document"], F.lit(" states: "), F.when(c["position_key"].isNotNull(), c["value"]).otherwise(
            F.concat(F.lit('"'), c["quote"], F.lit('"'))), F.lit(".")), F.array(c["claim_id"])))


def with_sentences(rows: DataFrame) -> DataFrame:
    """Adds `sentences`. Needs results, claims and answer array<struct<text,claims>>."""
    disputed = F.filter("claims", lambda c: F.exists("results", lambda a: (a["status"] == "conflict") & (a["aspect_id"] == c["aspect_id"])))
    # the lambdas over drafts and claims name these arrays: merged into them, they would be built anew for every draft and every claim
    rows = settled(rows, _verified=F.transform("claims", lambda c: c["claim_id"]), _disputed=F.transform(disputed, lambda c: c["claim_id"]))
    rows = rows.withColumn("_said", F.concat(conflict_sentences(), kept_drafts()))
    return rows.withColumn("sentences", F.when(F.size("_said") > 0, F.col("_said")).otherwise(default_sentences())).drop("_said", "_disputed")


def with_citations(rows: DataFrame) -> DataFrame:
    """Numbers claims by first use in the sentences, then the rest in order; claims come back in that order."""
    order = F.array_union(F.flatten(F.transform("sentences", lambda s: s["claim_ids"])), F.col("_verified"))
    rows = settled(rows, _order=order)
    fields = [f.name for f in rows.schema["claims"].dataType.elementType.fields]
    numbered = F.transform("claims", lambda c: F.struct(
        F.array_position("_order", c["claim_id"]).cast("int").alias("citation"), *[c[f].alias(f) for f in fields]))
    return rows.withColumn("claims", F.array_sort(numbered)).drop("_order", "_verified")


def with_result(rows: DataFrame) -> DataFrame:
    """Adds `headline` and, where there is `evidence`, `related`; an insufficient answer shows no sentences and no claims. Needs state."""
    empty = F.col("state") == "INSUFFICIENT"
    topics = F.transform(F.filter("results", lambda a: a["status"] == "conflict"), lambda a: lower_first(a["label"]))
    headline = (F.when(F.col("evidence_only"), fixed.HEADLINE_EVIDENCE_ONLY).when(empty, fixed.HEADLINE_INSUFFICIENT)
                .when(F.col("state") == "CONFLICT", F.concat(F.lit("The documents disagree on "), joined(topics), F.lit(".")))
                .otherwise(F.coalesce(F.get("sentences", F.lit(0))["text"], F.lit(fixed.HEADLINE_DEFAULT))))
    limit = F.when(F.col("evidence_only"), fixed.RELATED_EVIDENCE_ONLY).when(empty, fixed.RELATED_INSUFFICIENT).otherwise(0)
    related = {"related": F.slice("evidence", F.lit(1), limit)} if "evidence" in rows.columns else {}
    return rows.withColumns({
        "headline": headline, **related,
        "sentences": F.when(empty, F.slice("sentences", 1, 0)).otherwise(F.col("sentences")),
        "claims": F.when(empty, F.slice("claims", 1, 0)).otherwise(F.col("claims"))})
