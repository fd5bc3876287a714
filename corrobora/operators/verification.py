"""Checking extracted claims against stored passages. Nothing is kept unless its quote is found in the cited passage.

claims: run_id, claim_no, claim_id, aspect_id, evidence (eid), quote, value, value_type, scope, explicit
evidence: run_id, eid, chunk_id, document_id, document, page, section, paragraph, text, text_hash, extraction_method, ocr_confidence
A run is one model reply, so its claims are few; every step groups by run, never by a larger unit.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..functions import quotes, values
from ..functions.text import settled, strip
from ..sources.tables import stored
from .layout import quality_band

LOCATION = ["chunk_id", "document_id", "document", "page", "section", "paragraph", "text", "text_hash", "extraction_method", "ocr_confidence"]


def good_length(quote: Column) -> Column:
    return F.length(strip(quote)).between(fixed.QUOTE_MIN, fixed.QUOTE_MAX)


def found_quotes(rows: DataFrame) -> DataFrame:
    """Adds shown_quote; rows: quote, text, scanned."""
    return quotes.with_shown_quote(rows, F.col("quote"), F.col("text"), F.col("scanned"))


def confirmed_values(rows: DataFrame) -> DataFrame:
    """Adds shown_quote, norm and confirmed; rows: quote, text, scanned, value, value_type."""
    parsed = found_quotes(rows).withColumn("norm", F.when(F.col("shown_quote").isNotNull(), values.normalized("value", "value_type")))
    return parsed.withColumn("confirmed", F.when(F.col("norm").isNotNull(), values.supported("norm", "shown_quote")))


def checked_once(rows: DataFrame, usable: Column, inputs: list[str], check: Callable[[DataFrame], DataFrame], asked: DataFrame | None = None) -> DataFrame:
    """`check` on the inputs of the usable rows; with `asked` (rows that hold all these inputs) equal inputs are checked once and joined back.

    What was checked is stored, so that Spark knows its size before it plans the join: a small one is broadcast and the rows stay where they are.
    """
    if asked is None:
        plain = [c for c in rows.columns if c not in inputs]
        staged = rows.select(*plain, *[F.col(c).alias(f"_own_{c}") for c in inputs], *[F.when(usable, F.col(c)).alias(c) for c in inputs])
        found = check(staged)
        return found.withColumns({c: F.col(f"_own_{c}") for c in inputs}).drop(*[f"_own_{c}" for c in inputs])
    once = stored(check(asked.select(*inputs).distinct()), "checked").withColumnsRenamed({c: f"_{c}" for c in inputs})
    same = usable
    for c in inputs:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(once, same, "left").drop(*[f"_{c}" for c in inputs])


def check_claims(claims: DataFrame, evidence: DataFrame, aspects: DataFrame, once: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """All claims with `drop_reason` (NULL = verified), the shown quote, the comparable key and the stored location.

    `once`: equal claims on equal passages are checked once, for stored claims that repeat. They are looked for in `asked` (quote, text, extraction_method, value,
    value_type), which has every claim beside the passage that it cites; without it claims and evidence are read and joined one more time. Stored claims and evidence
    are bucketed by run, so the passages of a bucket are hashed, not sorted.
    """
    known = evidence.select("run_id", F.col("eid").alias("evidence"), *LOCATION)
    # the aspects of a run are those of one reply: as an array they join by run alone, and the claims keep the order of the join before
    topics = aspects.groupBy("run_id").agg(F.collect_set("aspect_id").alias("known_aspects"))
    scanned = F.col("extraction_method") == "ocr"
    joined = claims.join(known.hint("shuffle_hash") if once else known, ["run_id", "evidence"], "left").join(topics.hint("merge"), "run_id", "left")
    known_aspect = F.coalesce(F.array_contains("known_aspects", F.col("aspect_id")), F.lit(False))
    early = (F.when(F.col("chunk_id").isNull(), "unknown_evidence").when(~known_aspect, "unknown_aspect")
             .when(~good_length(F.col("quote")), "bad_quote_length"))
    staged = joined.withColumns({"early": early, "scanned": scanned})
    if once:
        pairs = claims.join(known, ["run_id", "evidence"]) if asked is None else asked
        asked = pairs.withColumn("scanned", scanned).filter(good_length(F.col("quote")))
    confirmed = checked_once(staged, F.col("early").isNull(), ["quote", "text", "scanned", "value", "value_type"], confirmed_values, asked if once else None)
    keyed = confirmed.withColumns({
        "position_key": F.when(F.col("confirmed"), F.col("norm.key")),
        "explicit": F.col("explicit") & F.coalesce("confirmed", F.lit(True)),
        "reason": F.coalesce("early", F.when(F.col("shown_quote").isNull(), "quote_not_found"))})
    same = W.partitionBy("run_id", "aspect_id", "chunk_id", "reason", F.coalesce("position_key", F.lower("shown_quote"))).orderBy("claim_no")
    repeated = F.col("reason").isNull() & (F.row_number().over(same) > 1)
    return keyed.withColumn("repeated", repeated).select(
        "run_id", "claim_no", "claim_id", "aspect_id",
        F.when(F.col("position_key").isNotNull(), F.col("norm.display")).otherwise(F.coalesce("value", F.lit(""))).alias("value"),
        "value_type", "position_key", values.scope(F.col("scope")).alias("scope"), "explicit", *[c for c in LOCATION if c not in ("text", "ocr_confidence")],
        F.col("shown_quote").alias("quote"), quality_band(F.col("extraction_method"), F.col("ocr_confidence")).alias("ocr_quality"),
        F.coalesce("reason", F.when(F.col("repeated"), "duplicate")).alias("drop_reason"))


def verified(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def dropped(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("drop_reason").isNotNull()).select("run_id", "claim_no", "claim_id", "drop_reason")


def supersession_notes(entries: DataFrame, evidence: DataFrame, once: bool = False) -> DataFrame:
    """Notes whose own quote says that it replaces or amends something; one per passage and aspect.

    entries: run_id, entry_no, evidence, quote, aspect_id; `once` as for claims
    """
    known = evidence.select("run_id", F.col("eid").alias("evidence"), *LOCATION)
    joined = entries.filter(good_length(F.col("quote"))).join(known, ["run_id", "evidence"]).withColumn("scanned", F.col("extraction_method") == "ocr")
    found = checked_once(joined, F.lit(True), ["quote", "text", "scanned"], found_quotes, joined if once else None)
    cued = found.filter(F.col("shown_quote").rlike(fixed.SUPERSESSION_CUE))
    first = W.partitionBy("run_id", "chunk_id", "aspect_id").orderBy("entry_no")
    kept = cued.withColumn("copy", F.row_number().over(first)).filter("copy = 1")
    return kept.select("run_id", "entry_no", "aspect_id", F.format_string(fixed.NOTE_TEXT, "document").alias("note"),
                       *[c for c in LOCATION if c not in ("text", "ocr_confidence")], F.col("shown_quote").alias("quote"),
                       quality_band(F.col("extraction_method"), F.col("ocr_confidence")).alias("ocr_quality"))


def ungrounded(shown: DataFrame, stored: DataFrame) -> DataFrame:
    """Shown evidence that does not equal its stored passage (location, scope, quote); must come back empty.

    shown and stored: scope, chunk_id, document_id, document, page, section and quote / text.
    """
    return _with_problem(shown, stored).filter("problem IS NOT NULL")


def _with_problem(shown: DataFrame, stored: DataFrame) -> DataFrame:
    place = ["scope", "document_id", "document", "page", "section"]
    kept = stored.select("chunk_id", "text", *[F.col(c).alias(f"stored_{c}") for c in place])
    joined = shown.join(kept, "chunk_id", "left")
    same = F.coalesce(F.contains("text", "quote"), F.lit(False))
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    return joined.withColumn("problem", F.when(F.col("text").isNull(), "unknown passage").when(~same, "differs from passage"))


def audit_runs(runs: DataFrame, stored: DataFrame) -> DataFrame:
    """Per run how many shown claims, related passages and notes there are, how many of them differ from their stored passage, and how many cited ids name no shown claim.

    runs: run_id, scope, claims, related, results (with notes), sentences (with claim_ids); stored: scope, chunk_id, document_id, document, page, section, text.
    Runs are costly to compose, so they are read once: all that a run shows is one array, and its counts go with it. A run that shows nothing keeps a row."""
    kinds, fields = ["claims", "related", "notes"], ["chunk_id", "document_id", "document", "page", "section", "quote"]
    rows = settled(runs, claims=F.col("claims"), related=F.col("related"), _notes=F.flatten(F.transform("results", lambda a: a["notes"])),
                   _ids=F.transform("claims", lambda c: c["claim_id"]), _cited=F.flatten(F.transform("sentences", lambda s: s["claim_ids"])))
    unknown = F.filter("_cited", lambda c: ~F.array_contains("_ids", c))
    items = {"claims": F.col("claims"), "related": F.col("related"), "notes": F.col("_notes")}
    def listed(kind, items):
        return F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[f].alias(f) for f in fields]))

    shown = F.flatten(F.array_compact(F.array(*[listed(k, x) for k, x in items.items()])))
    sizes = F.struct(*[F.size(x).cast("bigint").alias(k) for k, x in items.items()], F.size(unknown).cast("bigint").alias("unknown_citations"))
    rows = rows.select("run_id", "scope", sizes.alias("sizes"), F.explode_outer(shown).alias("x")).select("run_id", "scope", "sizes", "x.*")
    bad = [F.count(F.when((F.col("kind") == k) & F.col("problem").isNotNull(), 1)).alias(f"bad_{k}") for k in kinds]
    audited = _with_problem(rows, stored).groupBy("run_id").agg(F.max("sizes").alias("sizes"), *bad)
    return audited.select("run_id", *[f"sizes.{k}" for k in kinds], *[f"bad_{k}" for k in kinds], "sizes.unknown_citations")
