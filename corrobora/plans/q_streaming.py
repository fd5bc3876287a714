"""Streaming queries over the given tables, with the SQL of their batch form."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming import jobs
from . import q_uploads, views
from .catalog import query


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream, one file or a folder of parts: as a pattern the path may be either."""
    return spark.readStream.schema(views.table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")


@query("str_ingest", views.chunks_sql("SELECT doc_id, source, ordinal, page, section, paragraph, text, text_hash FROM chunks"))
def str_ingest(spark, sf):
    arriving = views.raw_from(stream(spark, sf, "documents"))
    path = jobs.run(lambda out, check: jobs.ingest(arriving, ["doc_id", "source"], out, check), spark, "ingest")
    return spark.read.parquet(path).drop("extraction_method", "ocr_confidence")


@query("str_dedup", f"WITH {q_uploads._ARRIVALS_SQL} SELECT doc_id, scope, status, stored_path FROM marked")
def str_dedup(spark, sf):
    rows = q_uploads.arrivals(spark, sf)
    landing = shared_folder(spark, "landing")
    edges = rows.selectExpr("min(doc_id) AS low", "max(doc_id) AS high").first()  # two numbers: three deliveries in id order
    step = (edges.high - edges.low) // 3 + 1
    out = shared_folder(spark, "dedup")
    for part in range(3):
        low = edges.low + part * step
        rows.filter((F.col("doc_id") >= low) & (F.col("doc_id") < low + step)).write.mode("append").parquet(landing)
        arriving = spark.readStream.schema(rows.schema).parquet(landing)
        jobs.mark_duplicates(arriving, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    path = f"{out}/out"
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("doc_id", "scope", "status", "stored_path")


@query("str_dedup_keyed", f"WITH {q_uploads._ARRIVALS_SQL} SELECT doc_id, scope, status, stored_path FROM marked")
def str_dedup_keyed(spark, sf):
    """The same deliveries with the originals in keyed state, the stream started anew for each of them."""
    rows = q_uploads.arrivals(spark, sf)
    base = shared_folder(spark, "keyed")
    edges = rows.selectExpr("min(doc_id) AS low", "max(doc_id) AS high").first()
    step = (edges.high - edges.low) // 2 + 1
    for part in range(2):
        low = edges.low + part * step
        rows.filter((F.col("doc_id") >= low) & (F.col("doc_id") < low + step)).write.mode("append").parquet(f"{base}/landing")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{base}/landing")
        jobs.keyed_duplicates(arriving, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "scope", "status", "stored_path")


@query("str_late_lines", """WITH p AS (SELECT *, user_id % 3 AS part FROM events),
seen AS (SELECT part, max(ts) AS highest FROM p GROUP BY 1), marks AS (SELECT a.part, max(b.highest) AS mark FROM seen a JOIN seen b ON b.part < a.part GROUP BY 1)
SELECT event_type AS stage, count(*) FILTER (NOT coalesce(ts < mark - INTERVAL '10 days', false)) AS counted, count(*) FILTER (coalesce(ts < mark - INTERVAL '10 days', false)) AS late,
  round(coalesce(sum(value) FILTER (NOT coalesce(ts < mark - INTERVAL '10 days', false)), 0), 4) AS total FROM p LEFT JOIN marks USING (part) GROUP BY 1""")
def str_late_lines(spark, sf):
    """Three deliveries out of time order: lines behind the watermark are reported, the others counted."""
    base = shared_folder(spark, "late")
    lines = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        lines.filter(F.col("user_id") % 3 == part).write.mode("append").parquet(f"{base}/landing")
        arriving = spark.readStream.schema(lines.schema).parquet(f"{base}/landing")
        jobs.split_late(arriving, f"{base}/out", f"{base}/checkpoint", delay="10 days").awaitTermination()
    marked = spark.read.option("basePath", f"{base}/out/lines").parquet(f"{base}/out/lines/batch=*")
    on_time = ~F.col("late")
    return marked.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.when(on_time, 1)).alias("counted"), F.count(F.when(~on_time, 1)).alias("late"),
                                                                  F.round(F.coalesce(F.sum(F.when(on_time, F.col("value"))), F.lit(0.0)), 4).alias("total"))


@query("str_latest_status", "SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def str_latest_status(spark, sf):
    latest = jobs.latest_status(stream(spark, sf, "events").withColumnRenamed("user_id", "doc_id"), "doc_id", "event_type", F.struct("ts", "event_id"))
    path = jobs.run(lambda out, check: jobs.changed_groups(latest, out, check, ["doc_id"]), spark, "status")
    return jobs.current_groups(spark, path, ["doc_id"], ["status"])


@query("str_stage_metrics", """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS stage, count(*) AS lines, round(sum(value), 4) AS total, max(value) AS highest FROM events GROUP BY ALL""")
def str_stage_metrics(spark, sf):
    metrics = jobs.stage_metrics(stream(spark, sf, "events").withColumnRenamed("event_type", "stage").withColumn("ts", F.col("ts").cast("timestamp")))
    path = jobs.run(lambda out, check: jobs.changed_groups(metrics, out, check), spark, "metrics")
    current = jobs.current_groups(spark, path, ["window_start", "stage"], ["lines", "total", "highest"])
    return current.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
