"""Queries over positions and conflicts between documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts as cf
from ..sources import tables
from . import q_verification as qv
from . import views
from .catalog import query


def cases(spark: SparkSession, sf: str, flagged: bool = False, fields: list[str] = cf.POSITION, noted: bool = False) -> DataFrame:
    runs = views.run_flags(spark, sf, "runs", flagged)
    return cf.case_rows(runs, views.claim_table(spark, sf, "aspects"), qv.checked(spark, sf), qv.notes(spark, sf) if noted else None, fields)


def topics(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("run_id", *keep, F.explode("results").alias("a"))


def positions(rows: DataFrame) -> DataFrame:
    return topics(rows).select("run_id", "a.aspect_id", F.col("a.label").alias("label"), F.col("a.status").alias("status"), F.posexplode("a.positions").alias("pos_no", "p"))


def repointed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    merged = cf.merge_aspects(views.claim_table(spark, sf, "aspects"))
    return merged, cf.repoint(qv.verified(spark, sf), merged)


@query("cfl_merge_aspects", views.conflicts_sql("""SELECT run_id, aspect_id, merged_id, (SELECT count(*) FROM verified v WHERE v.run_id = c.run_id AND v.aspect_id = c.aspect_id) AS moved_claims FROM canon c"""))
def cfl_merge_aspects(spark, sf):
    merged = cf.merge_aspects(views.claim_table(spark, sf, "aspects"))
    moved = qv.verified(spark, sf).groupBy("run_id", "aspect_id").agg(F.count(F.lit(1)).alias("n"))
    return merged.join(moved, ["run_id", "aspect_id"], "left").select("run_id", "aspect_id", "merged_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("moved_claims"))


@query("cfl_positions", views.conflicts_sql("SELECT run_id, aspect_id, position_key AS key, display, array_to_string(ids, ',') AS claim_ids, document_ids FROM positions"))
def cfl_positions(spark, sf):
    return positions(cases(spark, sf)).select("run_id", "aspect_id", "p.key", "p.display", F.array_join("p.claim_ids", ",").alias("claim_ids"),
                                              F.array_join(F.transform("p.document_ids", lambda d: d.cast("string")), ",").alias("document_ids"))


@query("cfl_pairs", views.conflicts_sql("SELECT DISTINCT run_id, aspect_id, key_a, key_b FROM pairs"))
def cfl_pairs(spark, sf):
    claims = repointed(spark, sf)[1].select("run_id", "aspect_id", "position_key", "scope", "text_hash")
    return cf.conflicting_positions(tables.stored(claims, "verified"))


@query("cfl_status", views.conflicts_sql("SELECT run_id, aspect_no, aspect_id, label, status, np AS positions FROM results"))
def cfl_status(spark, sf):
    merged, claims = repointed(spark, sf)
    # counted once and compared with itself: verified once, read three times
    claims = tables.stored(claims.select("run_id", "aspect_id", "position_key", "scope", "text_hash"), "verified")
    return cf.aspect_status(merged, claims).drop("basis")


@query("cfl_basis", views.conflicts_sql("SELECT run_id, aspect_id, basis FROM results"))
def cfl_basis(spark, sf):
    return topics(cases(spark, sf)).select("run_id", "a.aspect_id", "a.basis")


@query("cfl_position_order", views.conflicts_sql("SELECT run_id, aspect_id, pos_no, position_key AS key, n_docs FROM positions"))
def cfl_position_order(spark, sf):
    return positions(cases(spark, sf)).select("run_id", "aspect_id", "pos_no", "p.key", F.size("p.document_ids").cast("bigint").alias("n_docs"))


@query("cfl_attach_notes", views.conflicts_sql("SELECT run_id, aspect_id, status, entry_no, note FROM attached JOIN results USING (run_id, aspect_id)"))
def cfl_attach_notes(spark, sf):
    return topics(cases(spark, sf, noted=True)).select("run_id", "a.aspect_id", "a.status", F.explode("a.notes").alias("n")).select("run_id", "aspect_id", "status", "n.entry_no", "n.note")


@query("cfl_fallback", views.conflicts_sql("SELECT run_id, aspect_id, check_failed, status, basis, np AS positions FROM results", True))
def cfl_fallback(spark, sf):
    return topics(cases(spark, sf, True), "check_failed").select("run_id", "a.aspect_id", "check_failed", "a.status", "a.basis", F.size("a.positions").cast("bigint").alias("positions"))


_GROUPS_SQL = """
sides AS (SELECT run_id, aspect_no * 1000 + pos_no AS o, label || ': ' || display AS title, ids FROM positions JOIN results USING (run_id, aspect_id) WHERE status = 'conflict'),
rest AS (SELECT run_id, list(claim_id ORDER BY claim_no) AS ids FROM vclaims v WHERE NOT EXISTS (SELECT 1 FROM sides s WHERE s.run_id = v.run_id AND list_contains(s.ids, v.claim_id)) GROUP BY 1),
groups AS (SELECT * FROM sides UNION ALL SELECT run_id, 1000000, CASE WHEN run_id IN (SELECT run_id FROM sides) THEN 'Other evidence' END, ids FROM rest)"""


@query("cfl_groups_view", views.conflicts_sql("SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS INTEGER) AS group_no, title, array_to_string(ids, ',') AS claim_ids FROM groups", False, _GROUPS_SQL))
def cfl_groups_view(spark, sf):
    return cf.grouped_claims(cases(spark, sf)).withColumn("claim_ids", F.array_join("claim_ids", ","))


@query("cfl_rollup", views.conflicts_sql("""SELECT scope, conflict_key, arg_max(run_id, (o_orderdate, run_id)) AS run_id, arg_max(label, (o_orderdate, run_id)) AS label, arg_max(sides, (o_orderdate, run_id)) AS sides, count(*) AS runs
FROM (SELECT o_custkey % 20 AS scope, o_orderdate, run_id, label, string_agg(position_key, '|' ORDER BY position_key) AS conflict_key, string_agg(display || '=' || array_to_string(names, '+'), '; ' ORDER BY pos_no) AS sides
  FROM positions JOIN results USING (run_id, aspect_id) JOIN orders ON o_orderkey = run_id WHERE status = 'conflict' GROUP BY ALL) GROUP BY ALL"""))
def cfl_rollup(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 20).alias("scope"), "o_orderdate", F.col("o_orderpriority").alias("question"))
    clashing = topics(cases(spark, sf)).filter("a.status = 'conflict'").select("run_id", F.col("a.label").alias("label"), F.transform("a.positions", lambda p: F.struct(
        p["key"].alias("key"), p["display"].alias("display"), p["documents"].alias("documents"))).alias("sides"))
    found = cf.rollup(clashing.join(o, "run_id").withColumn("run_order", F.struct("o_orderdate", "run_id", "label")))
    shown = F.array_join(F.transform("sides", lambda s: F.concat(s["display"], F.lit("="), F.array_join(s["documents"], "+"))), "; ")
    return found.select("scope", "conflict_key", "run_id", "label", shown.alias("sides"), "runs")
