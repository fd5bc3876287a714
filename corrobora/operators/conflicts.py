"""Where documents disagree: merged aspects, positions, status, notes. No side is preferred.

Two forms. The table form reduces claims before comparing them and never collects a group; it works for any number of
claims. The run form keeps one row per run (`aspects`, `claims`, `notes` arrays, all of one model reply, which is one
bounded input row) and feeds rating and composition without another shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..functions.memo import built_once
from ..functions.text import let, settled, squeeze

CLAIM = ["claim_no", "claim_id", "aspect_id", "value", "value_type", "position_key", "scope", "explicit", "chunk_id", "text_hash",
         "document_id", "document", "page", "section", "paragraph", "quote", "extraction_method", "ocr_quality"]
# what statuses and positions are made of, and what rating reads besides
POSITION = ["claim_no", "claim_id", "aspect_id", "value", "position_key", "scope", "text_hash", "document_id", "document"]
RATED = POSITION + ["explicit", "extraction_method", "ocr_quality"]
NOTE = ["entry_no", "aspect_id", "note", "chunk_id", "document_id", "document", "page", "section", "paragraph", "quote",
        "extraction_method", "ocr_quality"]


def label_key(label: Column, aspect_id: Column) -> Column:
    return let(squeeze(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}_\s]", " ")), lambda k: F.when(k != "", k).otherwise(aspect_id))


# --- table form ----------------------------------------------------------------------------------
def merge_aspects(aspects: DataFrame) -> DataFrame:
    """Every aspect with the first aspect of its run that has an equal label."""
    same = W.partitionBy("run_id", "label_key").orderBy("aspect_no")
    return aspects.withColumn("label_key", label_key(F.col("label"), F.col("aspect_id"))).withColumn(
        "merged_id", F.first("aspect_id").over(same)).drop("label_key")


def repoint(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Claims or notes moved to their merged aspect."""
    ids = merged.select("run_id", "aspect_id", "merged_id")
    return rows.join(ids, ["run_id", "aspect_id"], "left").withColumn("aspect_id", F.coalesce("merged_id", "aspect_id")).drop("merged_id")


def reduced(claims: DataFrame) -> DataFrame:
    """One row per (run, aspect, key, scope) with the smallest and largest text hash and the claim count."""
    return claims.filter("position_key IS NOT NULL").groupBy("run_id", "aspect_id", "position_key", "scope").agg(
        F.min("text_hash").alias("low"), F.max("text_hash").alias("high"), F.count(F.lit(1)).alias("claims")).withColumns({
            "family": values.family_of(F.col("position_key")),
            "unit": F.when(values.family_of(F.col("position_key")) == "quantity", values.unit_of(F.col("position_key"))).otherwise("")})


def _compatible(a, b) -> Column:
    units = (a("unit") == "") | (b("unit") == "") | (a("unit") == b("unit"))
    scopes = a("scope").isNull() | b("scope").isNull() | (a("scope") == b("scope"))
    # all four hashes equal: every pair is the same passage text, so nothing contradicts
    one_text = (a("low") == a("high")) & (b("low") == b("high")) & (a("low") == b("low"))
    return units & scopes & ~one_text


def conflicting_positions(claims: DataFrame) -> DataFrame:
    """run_id, aspect_id, key_a < key_b: pairs of positions with at least one conflicting pair of claims.

    A different passage text implies a different passage, so each side needs only its hash range, and claims are
    reduced to distinct values before the join.
    """
    rows = reduced(claims)
    keys = ["run_id", "aspect_id", "family"]
    fields = ["position_key", "unit", "scope", "low", "high"]
    a = rows.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = rows.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields])
    pairs = a.join(b, keys).filter((F.col("a_position_key") < F.col("b_position_key")) & _compatible(
        lambda f: F.col(f"a_{f}"), lambda f: F.col(f"b_{f}")))
    return pairs.select("run_id", "aspect_id", F.col("a_position_key").alias("key_a"), F.col("b_position_key").alias("key_b")).distinct()


def aspect_status(merged: DataFrame, claims: DataFrame) -> DataFrame:
    """Status and basis of every merged aspect; claims already repointed."""
    own = claims.groupBy("run_id", "aspect_id").agg(
        F.count(F.lit(1)).alias("claims"), F.countDistinct("position_key").alias("positions"),
        F.max(values.family_of(F.col("position_key")) == "text").alias("any_text"))
    clash = conflicting_positions(claims).groupBy("run_id", "aspect_id").agg(F.lit(True).alias("clash"))
    rows = merged.filter("merged_id = aspect_id").join(own, ["run_id", "aspect_id"], "left").join(clash, ["run_id", "aspect_id"], "left")
    return rows.select(
        "run_id", "aspect_no", "aspect_id", "label",
        F.when(F.col("claims").isNull(), "uncovered").when(F.col("clash"), "conflict").when(F.col("positions") > 1, "complementary")
         .otherwise("consistent").alias("status"),
        F.when(F.col("any_text"), "text").otherwise("typed").alias("basis"), F.coalesce("positions", F.lit(0)).cast("bigint").alias("positions"))


def scanned_claims(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """Runs with `ocr_claims`, the verified claims that come from scans; none where there is no analysis."""
    counts = checked.groupBy("run_id").agg(F.count(F.when(F.col("drop_reason").isNull() & (F.col("extraction_method") == "ocr"), 1)).alias("n"))
    return runs.join(counts.hint("merge"), "run_id", "left").withColumn(
        "ocr_claims", F.when(~F.col("evidence_only") & F.col("has_documents"), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint")).drop("n")


# --- run form -------------------------------------------------------------------------------------
def gathered(rows: DataFrame, order: str, fields: list[str], name: str) -> DataFrame:
    """One ordered array of structs per run."""
    first = [order] + [f for f in fields if f != order]
    return rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*first))).alias(name))


def claim_cases(checked: DataFrame, fields: list[str] = CLAIM) -> DataFrame:
    """Per run: verified claims in order, how many were extracted, how many were lost (repeats do not count)."""
    kept = F.when(F.col("drop_reason").isNull(), F.struct(*fields))
    return checked.groupBy("run_id").agg(
        F.sort_array(F.collect_list(kept)).alias("claims"), F.count(F.lit(1)).alias("extracted"),
        F.count(F.when(F.col("drop_reason") != "duplicate", 1)).alias("lost"))


def case_rows(runs: DataFrame, aspects: DataFrame, checked: DataFrame, notes: DataFrame | None, fields: list[str] = CLAIM) -> DataFrame:
    """One row per run: its aspects with status, positions and notes, and its claims with merged aspect ids.

    Runs without analysis (`evidence_only`, or no ready documents) have no claims and no aspects. Spark cannot prune fields inside gathered
    arrays, so a reader names those it needs: `fields` of the claims (POSITION at least); without notes the results have none.
    """
    rows, names = runs, ["aspects", "claims"] + (["notes"] if notes is not None else [])
    frames = [gathered(aspects, "aspect_no", ["aspect_no", "aspect_id", "label"], "aspects"), claim_cases(checked, fields)]
    for frame in frames + ([gathered(notes, "entry_no", NOTE, "notes")] if notes is not None else []):
        rows = rows.join(frame.hint("merge"), "run_id", "left")
    analysed = ~F.col("evidence_only") & F.col("has_documents")
    for name in names:
        kind = rows.schema[name].dataType.simpleString()
        rows = rows.withColumn(name, F.when(analysed & F.col(name).isNotNull(), F.col(name)).otherwise(F.expr(f"cast(array() as {kind})")))
    rows = rows.withColumns({n: F.when(analysed, F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint") for n in ("extracted", "lost")})
    return with_results(rows)


@built_once
def _label_keys() -> Column:
    return F.transform("aspects", lambda a: label_key(a["label"], a["aspect_id"]))


@built_once
def _merged_topics(check_failed: str) -> Column:
    return F.when(F.col(check_failed), F.col("aspects")).otherwise(
        F.filter("aspects", lambda a, i: F.array_position("_keys", F.element_at("_keys", i + 1)) == i + 1))


@built_once
def _homes() -> Column:
    """For each aspect of the run the first one with the same label."""
    return F.transform("_keys", lambda k: F.get("_ids", F.array_position("_keys", k).cast("int") - 1))


def _home(aspect_id: Column) -> Column:
    return F.coalesce(F.get("_homes", F.array_position("_ids", aspect_id).cast("int") - 1), aspect_id)


def _moved(items: str, fields: list[str], check_failed: str) -> Column:
    """Nothing moves where no two labels are equal, which is so in most runs, or where the check failed."""
    still = F.col(check_failed) | (F.size(F.array_distinct("_keys")) == F.size("_keys"))
    return F.when(still, F.col(items)).otherwise(F.transform(items, lambda c: F.struct(*[(_home(c[f]) if f == "aspect_id" else c[f]).alias(f) for f in fields])))


@built_once
def _moved_claims(check_failed: str, *fields: str) -> Column:
    return _moved("claims", list(fields), check_failed)


@built_once
def _moved_notes(check_failed: str) -> Column:
    return _moved("notes", NOTE, check_failed)


@built_once
def _results(check_failed: str, *with_notes: str) -> Column:
    failed = F.col(check_failed)

    def notes_of(a):
        def known(n):
            return F.coalesce(F.exists("topics", lambda t: t["aspect_id"] == n["aspect_id"]), F.lit(False))
        return F.filter("notes", lambda n: ~failed & (
            F.coalesce(n["aspect_id"] == a["aspect_id"], F.lit(False)) | ((F.size("topics") == 1) & ~known(n))))

    def result(a):
        own = F.filter("claims", lambda c: c["aspect_id"] == a["aspect_id"])
        return let(own, lambda cs: let(_positions(cs), lambda ps: F.struct(
            a["aspect_no"].alias("aspect_no"), a["aspect_id"].alias("aspect_id"), a["label"].alias("label"),
            F.when(F.size(cs) == 0, "uncovered").when(failed, "consistent").when((F.size(ps) > 1) & _any_conflict(cs), "conflict")
             .when(F.size(ps) > 1, "complementary").otherwise("consistent").alias("status"),
            F.when(~failed & F.exists(ps, lambda p: values.family_of(p["key"]) == "text"), "text").otherwise("typed").alias("basis"),
            F.when(failed, F.slice(ps, 1, 0)).otherwise(ps).alias("positions"), *[notes_of(a).alias(n) for n in with_notes])))

    return F.transform("topics", result)


def with_results(rows: DataFrame, check_failed: str = "check_failed") -> DataFrame:
    """Adds `results`; needs the arrays aspects and claims, and notes where the results are to have them."""
    fields = [f.name for f in rows.schema["claims"].dataType.elementType.fields]
    noted = ["notes"] if "notes" in rows.columns else []
    rows = settled(rows, _keys=_label_keys(), _ids=F.transform("aspects", lambda a: a["aspect_id"]))
    rows = settled(rows, _homes=_homes())
    # the results name these arrays inside lambdas: merged into them, every claim of a run would be moved once for each of its topics
    rows = settled(rows, claims=_moved_claims(check_failed, *fields), topics=_merged_topics(check_failed), **{n: _moved_notes(check_failed) for n in noted})
    return rows.drop("_keys", "_ids", "_homes", "aspects").withColumn("results", _results(check_failed, *noted)).drop("topics")


def _positions(claims: Column) -> Column:
    """Claims grouped by key: first display, claim ids in order, documents of the first claim of each passage text."""
    comparable = F.filter(claims, lambda c: c["position_key"].isNotNull())

    def position(key, members):
        firsts = F.filter(members, lambda c, i: ~F.exists(F.slice(members, F.lit(1), i), lambda e: e["text_hash"] == c["text_hash"]))
        return F.struct(
            key.alias("key"), F.element_at(members, 1)["value"].alias("display"), F.transform(members, lambda c: c["claim_id"]).alias("claim_ids"),
            F.array_distinct(F.transform(firsts, lambda c: c["document_id"])).alias("document_ids"),
            F.array_distinct(F.transform(members, lambda c: c["document"])).alias("documents"))

    def build(cs):
        keys = F.array_distinct(F.transform(cs, lambda c: c["position_key"]))
        found = F.transform(keys, lambda k: let(F.filter(cs, lambda c: c["position_key"] == k), lambda m: position(k, m)))
        # stable sort: equal support keeps the order of first claims
        return F.array_sort(found, lambda a, b: F.signum(F.size(b["document_ids"]) - F.size(a["document_ids"])).cast("int"))
    return let(comparable, build)


def _any_conflict(claims: Column) -> Column:
    def clash(a, b):
        def unit(c):
            return F.when(values.family_of(c["position_key"]) == "quantity", values.unit_of(c["position_key"])).otherwise("")
        return F.coalesce(
            (a["position_key"] != b["position_key"]) & (values.family_of(a["position_key"]) == values.family_of(b["position_key"]))
            & ((unit(a) == "") | (unit(b) == "") | (unit(a) == unit(b))) & (a["text_hash"] != b["text_hash"])
            & (a["scope"].isNull() | b["scope"].isNull() | (a["scope"] == b["scope"])), F.lit(False))
    return F.exists(claims, lambda a: F.exists(claims, lambda b: clash(a, b)))


def grouped_claims(rows: DataFrame) -> DataFrame:
    """Claims as shown: by position where aspects conflict, the rest as other evidence; one untitled group otherwise."""
    clashing = F.filter("results", lambda a: a["status"] == "conflict")

    def titled(a, p):
        return F.when(F.trim(a["label"]) != "", F.concat(a["label"], F.lit(": "), p["display"])).otherwise(p["display"])

    sides = F.flatten(F.transform(clashing, lambda a: F.transform(a["positions"], lambda p: F.struct(titled(a, p).alias("title"), p["claim_ids"].alias("claim_ids")))))
    everything = F.transform("claims", lambda c: c["claim_id"])
    staged = rows.withColumns({"_sides": sides, "_all": everything}).withColumn(
        "_rest", F.array_except("_all", F.flatten(F.transform("_sides", lambda s: s["claim_ids"]))))
    kind = "array<struct<title:string,claim_ids:array<string>>>"
    groups = F.when(F.size("_all") == 0, F.expr(f"cast(array() as {kind})")).when(
        F.size(clashing) == 0, F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("_all").alias("claim_ids")))).when(
        F.size("_rest") > 0, F.concat("_sides", F.array(F.struct(F.lit("Other evidence").alias("title"), F.col("_rest").alias("claim_ids"))))).otherwise(F.col("_sides"))
    return staged.select("run_id", F.posexplode(groups).alias("group_no", "g")).select("run_id", "group_no", "g.title", "g.claim_ids")


def rollup(conflicts: DataFrame) -> DataFrame:
    """Distinct conflicts of a scope, keyed by their sorted position keys; the newest run wins.

    conflicts: scope, run_order, run_id, question, label, sides array<struct<key,display,documents>>
    """
    keyed = conflicts.withColumn("conflict_key", F.array_join(F.array_sort(F.transform("sides", lambda s: s["key"])), "|"))
    return keyed.groupBy("scope", "conflict_key").agg(F.max_by(
        F.struct("run_id", "question", "label", "sides"), F.col("run_order")).alias("newest"), F.count(F.lit(1)).alias("runs")).select(
            "scope", "conflict_key", "newest.*", "runs")
