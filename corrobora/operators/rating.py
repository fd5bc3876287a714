"""Evidence state, reasons, counters and warnings of each run, from its case row. The first matching rule wins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.memo import built_once
from ..functions.text import let
from ..functions.wording import counted, lower_first, sentence, text

SIGNALS = ["evidence_retrieved", "claims_extracted", "claims_verified", "claims_dropped", "documents_cited", "aspects_total", "aspects_covered",
           "conflicting_aspects", "explicit_claims", "ocr_claims", "ocr_low_claims", "ambiguous", "inferred_claims", "aspects_uncovered",
           "agreeing_documents", "evidence_only", "conflict_check_failed", "llm_source"]


def _count(items, test) -> Column:
    return F.size(F.filter(items, test))


def _distinct(items: Column, field: str) -> Column:
    return F.array_distinct(F.transform(items, lambda c: c[field]))


def independent(claims: Column) -> Column:
    """Distinct documents, a passage text copied into several files counted once."""
    return F.least(F.size(_distinct(claims, "document_id")), F.size(_distinct(claims, "text_hash")))


def _support(aspect: Column) -> Column:
    """What the claims of one aspect amount to."""
    def of(own):
        explicit = F.filter(own, lambda c: c["explicit"])
        return let(explicit, lambda ex: F.struct(
            aspect["aspect_id"].alias("aspect_id"), aspect["label"].alias("label"), independent(ex).alias("independent"),
            ((independent(ex) >= 2) & F.exists(ex, lambda c: F.coalesce(c["ocr_quality"] != "low", F.lit(True)))).alias("well_supported"),
            _distinct(own, "document").alias("documents"), F.filter(_distinct(own, "scope"), lambda s: s.isNotNull()).alias("scopes")))
    return let(F.filter("claims", lambda c: c["aspect_id"] == aspect["aspect_id"]), of)


@built_once
def _signals() -> Column:
    verified, aspects = F.size("claims"), F.size("results")
    explicit = _count("claims", lambda c: c["explicit"])
    covered = _count("results", lambda a: a["status"] != "uncovered")
    support = F.array_max(F.flatten(F.transform("results", lambda a: F.transform(a["positions"], lambda p: F.size(p["document_ids"])))))
    values = [F.col("n_evidence"), F.col("extracted"), verified, F.col("lost"), F.size(_distinct(F.col("claims"), "document_id")), aspects, covered,
              _count("results", lambda a: a["status"] == "conflict"), explicit, _count("claims", lambda c: c["extraction_method"] == "ocr"),
              _count("claims", lambda c: c["ocr_quality"] == "low"), F.col("ambiguous"), verified - explicit, aspects - covered,
              F.coalesce(support, F.lit(0)), F.col("evidence_only"), F.col("check_failed"), F.col("llm_source")]
    kinds = {"ambiguous": "boolean", "evidence_only": "boolean", "conflict_check_failed": "boolean", "llm_source": "string"}
    return F.struct(*[v.cast(kinds.get(n, "bigint")).alias(n) for n, v in zip(SIGNALS, values)])


def with_signals(rows: DataFrame) -> DataFrame:
    """Adds `signals`, the counters of a run. Needs results, claims, n_evidence, extracted, lost and the run flags."""
    return rows.withColumn("signals", _signals())


@built_once
def _supports() -> Column:
    return F.transform("results", _support)


def with_rule(rows: DataFrame) -> DataFrame:
    """Adds `support` per aspect, `rule` 1..9 and `state`. Needs signals."""
    rows = rows.withColumn("support", _supports())
    s = lambda name: F.col(f"signals.{name}")
    rule = (F.when(F.col("evidence_only"), 1).when(~F.col("has_documents") | (s("claims_verified") == 0), 2).when(s("conflicting_aspects") > 0, 3)
            .when(F.col("ambiguous"), 4).when(s("aspects_uncovered") > 0, 5).when(s("explicit_claims") == 0, 6)
            .when(s("ocr_low_claims") == s("claims_verified"), 7)
            .when(~F.col("check_failed") & F.forall("support", lambda a: a["well_supported"]), 8).otherwise(9))
    states = {1: "LOW", 2: "INSUFFICIENT", 3: "CONFLICT", 4: "LOW", 5: "LOW", 6: "LOW", 7: "LOW", 8: "HIGH", 9: "MEDIUM"}
    names = F.array(*[F.lit(states[i]) for i in range(1, 10)])
    return rows.withColumn("rule", rule).withColumn("state", F.element_at(names, F.col("rule")))


@built_once
def _reasons() -> Column:
    s = lambda name: F.col(f"signals.{name}")
    rule = F.col("rule")
    n = s("claims_verified")
    confirmed = F.when(n > 0, F.concat(counted(n, "relevant passage"), F.when(n == 1, " was").otherwise(" were"),
                                       F.lit(" confirmed across "), counted(s("documents_cited"), "document"), F.lit(".")))

    def side(p):
        d = F.size(p["document_ids"])
        return F.concat(counted(d, "document"), F.when(d == 1, " states ").otherwise(" state "), p["display"])

    sides = F.transform(F.filter("results", lambda a: a["status"] == "conflict"),
                        lambda a: F.concat(F.array_join(F.transform(a["positions"], side), "; "), F.lit(".")))
    note = F.trim(F.coalesce("ambiguity_note", F.lit("")))
    uncovered = F.transform(F.filter("results", lambda a: a["status"] == "uncovered"), lambda a: lower_first(a["label"]))
    fewest = F.array_min(F.transform("support", lambda a: a["independent"]))

    def shortfall(a):
        one = F.size(a["documents"]) == 1
        what = F.when(F.size("support") == 1, "this").otherwise(lower_first(a["label"]))
        return F.when(one, sentence(fixed.REASON_ONE_DOCUMENT, F.element_at(a["documents"], 1), what)).when(
            a["independent"] < 2, sentence(fixed.REASON_ONE_DIRECT, lower_first(a["label"]))).otherwise(
            sentence(fixed.REASON_ONLY_SCANS, lower_first(a["label"])))

    weak = F.transform(F.filter("support", lambda a: ~a["well_supported"]), shortfall)
    one = lambda c: F.array(c)
    verdict = (F.when(rule == 1, one(F.lit(fixed.REASON_EVIDENCE_ONLY)))
               .when((rule == 2) & ~F.col("has_documents"), one(F.lit(fixed.REASON_NO_DOCUMENTS))).when(rule == 2, one(F.lit(fixed.REASON_NO_CLAIMS)))
               .when(rule == 3, F.concat(sides, one(F.lit(fixed.REASON_DISAGREE))))
               .when(rule == 4, one(F.concat(F.lit(fixed.REASON_AMBIGUOUS), F.when(note != "", F.concat(F.lit(": "), note)).otherwise("."))))
               .when(rule == 5, one(F.concat(F.lit(fixed.REASON_UNCOVERED), F.array_join(uncovered, ", "), F.lit("."))))
               .when(rule == 6, one(F.lit(fixed.REASON_INFERRED))).when(rule == 7, one(F.lit(fixed.REASON_LOW_SCAN)))
               .when(rule == 8, one(sentence(fixed.REASON_AGREE, text(fewest))))
               .otherwise(F.concat(one(F.when(F.col("check_failed"), fixed.REASON_CHECK_FAILED)), weak)))
    notes = F.flatten(F.transform("results", lambda a: F.transform(a["notes"], lambda x: F.when(
        a["status"] == "conflict", sentence(fixed.REASON_NOTE_CONFLICT, x["document"])).otherwise(sentence(fixed.REASON_NOTE, x["document"])))))
    ocr = s("ocr_claims")
    scans = F.when(ocr > 0, F.concat(counted(ocr, "passage"), F.when(ocr == 1, " comes").otherwise(" come"), F.lit(" from scanned images.")))

    def conditions(a, own):
        return F.array(
            F.when((a["basis"] == "text") & (F.size(a["positions"]) > 1), sentence(fixed.REASON_TEXT_BASIS, lower_first(a["label"]))),
            F.when(a["status"] == "complementary", F.concat(F.lit(fixed.REASON_CONDITIONS), F.when(
                F.size(own["scopes"]) > 0, F.concat(F.lit(": "), F.array_join(own["scopes"], ", "), F.lit("."))).otherwise("."))))

    applied = F.flatten(F.zip_with("results", "support", conditions))
    lost = s("claims_dropped")
    discarded = F.when(lost > 0, F.concat(counted(lost, "extracted statement"), F.when(lost == 1, " was").otherwise(" were"),
                                          F.lit(" discarded "), F.lit(fixed.REASON_DISCARDED)))
    every = F.concat(one(confirmed), verdict, notes, one(scans), applied, one(discarded))
    return F.array_distinct(F.filter(every, lambda r: r.isNotNull()))


def with_reasons(rows: DataFrame) -> DataFrame:
    """Adds `reasons`: fixed sentences in a fixed order, without repeats. Needs rule, support and signals."""
    return rows.withColumn("reasons", _reasons())


def with_warnings(rows: DataFrame, keyword_only: Column | None = None) -> DataFrame:
    n = F.col("signals.ocr_claims")
    keyword_only = F.lit(False) if keyword_only is None else keyword_only
    listed = F.array_compact(F.array(
        F.when(F.col("evidence_only"), fixed.WARNING_NO_ANALYSIS),
        F.when(n > 0, F.concat(counted(n, "passage"), F.when(n == 1, " comes").otherwise(" come"), F.lit(" from scanned images."))),
        F.when(F.col("check_failed"), fixed.REASON_CHECK_FAILED), F.when(keyword_only, fixed.WARNING_KEYWORD_ONLY)))
    return rows.withColumn("warnings", F.when(F.col("has_documents"), listed).otherwise(F.slice(listed, 1, 0)))


def rated(rows: DataFrame, keyword_only: Column | None = None, reasons: bool = True) -> DataFrame:
    """Without `reasons` the results need no notes."""
    ruled = with_rule(with_signals(rows))
    return with_warnings(with_reasons(ruled) if reasons else ruled, keyword_only)


def facts(signals: Column) -> Column:
    """Short facts shown next to an answer; zero counts are left out, except passages and documents."""
    s = lambda n: signals[n]
    def when(name, tail):
        return F.when(s(name) > 0, F.concat(text(s(name)), F.lit(tail)))
    return F.array_compact(F.array(
        counted(s("claims_verified"), "verified passage"), counted(s("documents_cited"), "supporting document"), when("explicit_claims", " stated directly"),
        when("inferred_claims", " inferred"), when("ocr_claims", " from scans"), F.when(s("conflicting_aspects") > 0, counted(s("conflicting_aspects"), "conflict")),
        F.when(s("aspects_uncovered") > 0, F.concat(counted(s("aspects_uncovered"), "part"), F.lit(" unanswered"))),
        when("claims_dropped", " discarded as unverifiable")))
