"""Queries over uploads and stored tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..operators import documents as docs
from ..operators import reports
from ..sources import files, tables
from . import views
from .catalog import query

_LARGE = fixed.MAX_FILE_MB * 1024 * 1024 + 1


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files: extension by id, one in five with the wrong first bytes, some empty, some too large."""
    doc = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("pdf", "docx", "txt", "PNG", "jpg", "jpeg", "xlsx")]), (doc % 7 + 1).cast("int"))
    magic = F.element_at(F.array(*[F.lit(m) for m in ("25504446", "504B0304", "", "89504E47", "FFD8FF", "FFD8FF", "")]), (doc % 7 + 1).cast("int"))
    body = F.encode("text", "UTF-8")
    content = F.when(doc % 11 == 0, F.unhex(F.lit(""))).when(doc % 5 == 0, F.concat(F.unhex(F.lit("0102")), body, F.unhex(F.lit("00")))) \
        .otherwise(F.concat(F.unhex(magic), body))
    return views.table(spark, sf, "documents").select(
        doc, "source", F.concat(F.col("source"), F.lit("\\doc_"), doc.cast("string"), F.when(doc % 17 == 0, "").otherwise(F.concat(F.lit("."), ext))).alias("upload_name"),
        content.alias("content"), F.when(doc % 11 == 0, 0).when(doc % 13 == 0, _LARGE).otherwise(F.col("n_chars")).cast("bigint").alias("size"))


_UPLOADS_SQL = rf"""
up AS (SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN '' ELSE lower(['pdf', 'docx', 'txt', 'PNG', 'jpg', 'jpeg', 'xlsx'][doc_id % 7 + 1]) END AS ext,
  CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN {_LARGE} ELSE n_chars END AS size FROM documents)"""


@query("src_validate", f"""WITH {_UPLOADS_SQL}
SELECT doc_id, CASE WHEN ext = 'jpeg' THEN 'jpg' ELSE ext END AS ext,
  CASE WHEN ext NOT IN ('pdf', 'docx', 'txt', 'png', 'jpg', 'jpeg') THEN 'Unsupported file type' WHEN size = 0 THEN 'File is empty'
       WHEN size > 20971520 THEN 'File is larger than 20 MB' WHEN doc_id % 5 = 0 THEN 'File content does not match its extension' END AS reject_reason
FROM up""")
def src_validate(spark, sf):
    named = uploads(spark, sf).withColumn("name", tx.base_name(F.col("upload_name")))
    return files.validate(named).select("doc_id", "ext", "reject_reason")


@query("src_decode_text", """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS text FROM documents""")
def src_decode_text(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "text")
    latin = (F.col("doc_id") % 3 == 0) & ~F.col("text").rlike(r"[^\x00-\x7f\xa0-\xff]")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(raw, F.unhex(F.lit("00")))).otherwise(raw)
    return d.select("doc_id", content.alias("content")).select("doc_id", files.decode_text(F.col("content")).alias("text"))


@query("src_basename_ext", r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name,
  CASE WHEN position('.' IN regexp_extract(url, '[^/]*$')) > 0 THEN lower(regexp_extract(url, '[^./]*$')) ELSE '' END AS ext FROM pages""")
def src_basename_ext(spark, sf):
    name = tx.base_name(F.col("url"))
    return views.table(spark, sf, "pages").select("page_id", name.alias("name"), tx.extension(name).alias("ext"))


@query("src_content_hash", r"""SELECT doc_id, sha256(text) AS sha256, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_hash FROM documents""")
def src_content_hash(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), tx.text_hash(F.col("text")).alias("text_hash"))


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """documents as arriving files of four scopes, one in nineteen failed."""
    return views.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("inv"), (F.regexp_replace("source", "src", "").cast("int") % 4).cast("string")).alias("scope"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.concat(F.lit("files/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 19 == 0, "failed").otherwise("queued").alias("status"), F.length("text").alias("chars"))


_ARRIVALS_SQL = """
arr AS (SELECT doc_id, 'inv' || (CAST(replace(source, 'src', '') AS INTEGER) % 4) AS scope, sha256(text) AS sha256, 'files/' || doc_id AS path,
  CASE WHEN doc_id % 19 = 0 THEN 'failed' ELSE 'queued' END AS status, length(text) AS chars FROM documents),
ranked AS (SELECT *, row_number() OVER w AS rn, first_value(path) OVER w AS first_path FROM arr
  WINDOW w AS (PARTITION BY scope, sha256, status ORDER BY doc_id)),
marked AS (SELECT doc_id, scope, CASE WHEN status = 'queued' AND rn > 1 THEN 'duplicate' ELSE status END AS status,
  CASE WHEN status = 'queued' AND rn > 1 THEN first_path ELSE path END AS stored_path FROM ranked)"""


@query("src_dedup_in_scope", f"WITH {_ARRIVALS_SQL} SELECT * FROM marked")
def src_dedup_in_scope(spark, sf):
    marked = files.mark_duplicates(arrivals(spark, sf), "scope", "sha256", "doc_id", "path")
    return marked.select("doc_id", "scope", "status", "stored_path")


@query("src_manifest_match", """WITH corpora AS (
  SELECT source AS title, source || '/' || c AS corpus, c AS created, sha256(text) AS sha, doc_id % 97 = 0 AND c = 1 AS failed, doc_id % 113 = 1 AND c = 2 AS missing
  FROM documents, unnest([0, 1, 2]) AS t(c)),
lists AS (SELECT title, corpus, created, list_sort(list(sha)) AS shas, bool_or(failed) AS failed FROM corpora WHERE NOT missing GROUP BY ALL),
wanted AS (SELECT source AS title, list_sort(list(sha256(text))) AS shas FROM documents GROUP BY 1)
SELECT title, arg_max(corpus, created) AS corpus FROM lists JOIN wanted USING (title, shas) WHERE NOT failed GROUP BY title""")
def src_manifest_match(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    loaded = d.withColumn("created", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("NOT (doc_id % 113 = 1 AND created = 2)")
    loaded = loaded.select("title", "sha", "created", F.concat_ws("/", "title", F.col("created").cast("string")).alias("corpus"),
                           F.when((F.col("doc_id") % 97 == 0) & (F.col("created") == 1), "failed").otherwise("ready").alias("status"))
    return files.match_manifest(loaded, d.select("title", "sha"))


@query("rpt_document_list", f"""WITH {_ARRIVALS_SQL} SELECT scope, doc_id, stored_path, status FROM marked ORDER BY scope, doc_id""")
def rpt_document_list(spark, sf):
    marked = files.mark_duplicates(arrivals(spark, sf), "scope", "sha256", "doc_id", "path")
    return reports.document_list(marked, "scope", "doc_id", ["stored_path", "status"])


@query("rpt_status_counts", f"""WITH {_ARRIVALS_SQL} SELECT scope, count(*) AS documents, count(*) FILTER (status = 'ready') AS ready,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'queued') AS in_progress
FROM marked GROUP BY 1""")
def rpt_status_counts(spark, sf):
    return reports.status_counts(files.mark_duplicates(arrivals(spark, sf), "scope", "sha256", "doc_id", "path"), "scope")


@query("sink_tables", views.chunks_sql("SELECT source, count(*) AS passages, count(DISTINCT doc_id) AS documents, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1"))
def sink_tables(spark, sf):
    path = tables.shared_folder(spark, "passages")
    tables.write_table(views.passages(spark, sf), path, "source")
    return spark.read.parquet(path).groupBy("source").agg(
        F.count(F.lit(1)).alias("passages"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length("text")).alias("chars"))
