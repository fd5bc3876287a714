"""Queries from text and layout to passages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as docs
from ..operators import layout
from . import views
from .catalog import query


def _exploded(frame: DataFrame, paras, fields: str) -> DataFrame:
    return frame.select("doc_id", F.explode(paras).alias("p")).select("doc_id", *[f"p.{f}" for f in fields.split()])


@query("txt_paragraphs", r"""WITH blocks AS (
  SELECT doc_id, o, b FROM (SELECT doc_id, string_split_regex(replace(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), chr(13) || chr(10), chr(10)), '\n\s*\n') AS bs FROM documents),
    unnest(bs) WITH ORDINALITY AS u(b, o))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS pos, b AS raw, position(chr(10) IN trim(b, ' ' || chr(10) || chr(9) || chr(13))) = 0 AS single_line
FROM blocks WHERE regexp_matches(b, '\S')""")
def txt_paragraphs(spark, sf):
    spaced = F.replace("text", F.lit(".\n"), F.lit(".\n \n"))
    d = views.table(spark, sf, "documents").select("doc_id", F.posexplode(docs.text_paragraphs(spaced)).alias("pos", "raw"))
    return d.select("doc_id", "pos", "raw", docs.single_line(F.col("raw")).alias("single_line"))


@query("txt_table_rows", """SELECT n_regionkey AS table_no, n_nationkey AS row_no, string_agg(trim(v), ' | ' ORDER BY c) AS text
FROM (SELECT n_regionkey, n_nationkey, 0 AS c, ' ' || n_name AS v FROM nation UNION ALL SELECT n_regionkey, n_nationkey, 1, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_nationkey || ' ' END FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey + 100, c, '  ' FROM nation, unnest([0, 1]) AS t(c)) GROUP BY 1, 2 HAVING bool_or(trim(v) <> '')""")
def txt_table_rows(spark, sf):
    n = views.table(spark, sf, "nation")
    key, cell = F.col("n_nationkey"), lambda no, v: F.struct(F.lit(no).alias("c"), v.alias("v"))
    cells = n.select(F.col("n_regionkey").alias("table_no"), key.alias("row_no"), F.explode(F.array(
        cell(0, F.concat(F.lit(" "), "n_name")), cell(1, F.when(key % 5 == 0, " ").otherwise(F.concat(key.cast("string"), F.lit(" ")))))).alias("x"))
    blank = n.select(F.col("n_regionkey").alias("table_no"), (key + 100).alias("row_no"), F.explode(F.array(cell(0, F.lit("  ")), cell(1, F.lit("  ")))).alias("x"))
    return layout.table_rows(cells.unionByName(blank).select("table_no", "row_no", "x.c", "x.v"), ["table_no", "row_no"], "c", "v")


# --- layout spans made from order lines -----------------------------------------------------------
def spans(spark: SparkSession, sf: str) -> DataFrame:
    """One span per order line: document = order, page = line number, three blocks, two lines each."""
    li, key = views.table(spark, sf, "lineitem"), F.col("l_partkey")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (key % 3).cast("int").alias("block"), (F.floor(key / 3) % 2).cast("int").alias("line"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag").alias("span"),
        F.when(key % 7 == 0, "  ").when(key % 5 == 0, F.concat(F.lit("TERMS "), F.col("l_returnflag"), F.lit(" ")))
         .otherwise(F.concat(F.lit("part "), key.cast("string"), F.lit(" qty "), F.col("l_quantity").cast("int").cast("string"), F.lit(". "))).alias("text"),
        F.round(8 + 40 * F.col("l_discount"), 1).alias("size"), F.when(F.col("l_returnflag") == "A", 16).otherwise(4).alias("flags"),
        F.when(F.col("l_linestatus") == "F", "Arial-BoldMT").otherwise("Arial").alias("font"))


_SPANS_SQL = """
spans AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(l_partkey % 3 AS INTEGER) AS block, CAST((l_partkey // 3) % 2 AS INTEGER) AS line,
  l_partkey AS s1, l_suppkey AS s2, l_quantity AS s3, l_discount AS s4, l_returnflag AS s5,
  CASE WHEN l_partkey % 7 = 0 THEN '  ' WHEN l_partkey % 5 = 0 THEN 'TERMS ' || l_returnflag || ' ' ELSE 'part ' || l_partkey || ' qty ' || CAST(l_quantity AS INTEGER) || '. ' END AS text,
  round(8 + 40 * l_discount, 1) AS size, l_returnflag = 'A' OR l_linestatus = 'F' AS bold FROM lineitem),
lines AS (SELECT doc_id, page, block, line, string_agg(text, '' ORDER BY s1, s2, s3, s4, s5) AS text, bool_or(trim(text) <> '') AS shown,
  max(size) FILTER (trim(text) <> '') AS max_size, bool_and(bold) FILTER (trim(text) <> '') AS all_bold FROM spans GROUP BY ALL),
blocks AS (SELECT doc_id, page, block, string_agg(trim(text), ' ' ORDER BY line) AS text, count(*) AS lines, sum(length(text))::BIGINT AS chars, max(max_size) AS max_size, bool_and(all_bold) AS all_bold
  FROM lines WHERE shown GROUP BY ALL),
sizes AS (SELECT doc_id, size, sum(length(text)) AS chars FROM spans WHERE trim(text) <> '' GROUP BY ALL),
running AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY size) AS r, sum(chars) OVER (PARTITION BY doc_id) AS t FROM sizes),
body AS (SELECT doc_id, min(size) AS body_size FROM running WHERE r * 2 >= t GROUP BY 1)"""


@query("txt_body_size", f"WITH {_SPANS_SQL} SELECT * FROM body")
def txt_body_size(spark, sf):
    return layout.body_size(spans(spark, sf))


@query("txt_block_assembly", f"WITH {_SPANS_SQL} SELECT doc_id, page, block, text, lines, chars, max_size, all_bold FROM blocks")
def txt_block_assembly(spark, sf):
    return layout.lines_and_blocks(spans(spark, sf))[1].drop("raw")


@query("txt_ocr_route", f"""WITH {_SPANS_SQL}, pages AS (SELECT DISTINCT doc_id, page FROM spans UNION SELECT DISTINCT doc_id, 99 FROM spans)
SELECT p.doc_id, p.page, coalesce(sum(chars), 0)::BIGINT AS text_chars, coalesce(sum(chars), 0) < 20 AS to_ocr FROM pages p LEFT JOIN blocks b USING (doc_id, page) GROUP BY ALL""")
def txt_ocr_route(spark, sf):
    s = spans(spark, sf)
    pages = s.select("doc_id", F.explode(F.array("page", F.lit(99))).alias("page")).distinct()
    return layout.ocr_route(pages, layout.lines_and_blocks(s)[1])


@query("txt_layout_headings", f"""WITH {_SPANS_SQL} SELECT doc_id, page, block, t AS text,
  lines = 1 AND t <> '' AND length(t) <= 80 AND right(t, 1) NOT IN ('.', ',', ';') AND NOT regexp_matches(t, ':\\s*\\S')
  AND (max_size >= 1.15 * body_size OR all_bold OR regexp_matches(t, '^(\\d+(\\.\\d+)*\\.?|Section|Article|Clause|Schedule|Annex)\\s+\\S') OR (regexp_matches(t, '\\S\\s+\\S') AND upper(t) = t AND lower(t) <> t)) AS heading
FROM (SELECT *, trim(text) AS t FROM blocks JOIN body USING (doc_id))""")
def txt_layout_headings(spark, sf):
    s = spans(spark, sf)
    return layout.block_headings(layout.lines_and_blocks(s)[1], layout.body_size(s)).select("doc_id", "page", "block", "text", "heading")


@query("txt_heading_flag", rf"""SELECT doc_id, CAST(o - 1 AS INTEGER) AS pos, {views.HEADING_SQL} AS heading FROM (
  SELECT doc_id, o, trim(line) AS t FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, o))""")
def txt_heading_flag(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", "pos", tx.is_heading(F.col("line"), F.lit(True)).alias("heading"))


_HYPHENS = r"'([a-z]{4})([a-z]{3,})', '\1-' || chr(10) || ' \2'"


@query("txt_dehyphenate", rf"""SELECT doc_id, replace(regexp_replace(trim(regexp_replace(broken, '\s*\n\s*', chr(10), 'g'), chr(10)), '(\p{{L}})-\n(\p{{Ll}})', '\1\2', 'g'), chr(10), ' ') AS text
FROM (SELECT doc_id, trim(regexp_replace(text, {_HYPHENS}, 'g')) AS broken FROM documents)""")
def txt_dehyphenate(spark, sf):
    broken = F.regexp_replace("text", "([a-z]{4})([a-z]{3,})", "$1-\n $2")
    return views.table(spark, sf, "documents").select("doc_id", tx.join_lines(broken).alias("text"))


@query("txt_clean_nfkc", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS text FROM documents")
def txt_clean_nfkc(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query("txt_drop_page_numbers", views.paragraphs_sql("SELECT doc_id, page, text, heading FROM clean_paras"))
def txt_drop_page_numbers(spark, sf):
    return _exploded(views.cleaned_documents(spark, sf), "paras", "page text heading")


@query("txt_drop_headers_footers", views.paragraphs_sql("SELECT doc_id, page, text, heading FROM body_paras"))
def txt_drop_headers_footers(spark, sf):
    return _exploded(views.cleaned_documents(spark, sf), docs.without_headers(F.col("paras")), "page text heading")


@query("txt_paragraph_numbers", views.paragraphs_sql("SELECT doc_id, no, page, text FROM paras"))
def txt_paragraph_numbers(spark, sf):
    d = views.cleaned_documents(spark, sf)
    return _exploded(d, docs.numbered(docs.without_headers(F.col("paras"))), "no page text")


@query("txt_section_carry", views.paragraphs_sql("""SELECT doc_id, no, heading, last_value(CASE WHEN heading THEN text END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS section FROM paras"""))
def txt_section_carry(spark, sf):
    d = views.cleaned_documents(spark, sf)
    return _exploded(d, docs.with_sections(docs.numbered(docs.without_headers(F.col("paras")))), "no heading section")


@query("chunk_split_long", views.chunks_sql("SELECT doc_id, no, piece_no, piece FROM pieces"))
def chunk_split_long(spark, sf):
    d = views.cleaned_documents(spark, sf)
    long = _exploded(d, docs.numbered(docs.without_headers(F.col("paras"))), "no text heading").filter("NOT heading AND length(text) > 1200")
    return long.select("doc_id", "no", F.posexplode(tx.split_long(F.col("text"))).alias("piece_no", "piece"))


@query("chunk_pack", views.chunks_sql("SELECT doc_id, page, section, CAST(paragraph AS INTEGER) AS paragraph, text FROM chunks1"))
def chunk_pack(spark, sf):
    d = views.cleaned_documents(spark, sf)
    return _exploded(d, docs.chunked(docs.numbered(docs.without_headers(F.col("paras")))), "page section paragraph text")


@query("chunk_merge_small", views.chunks_sql("SELECT doc_id, page, section, paragraph, text FROM chunks"))
def chunk_merge_small(spark, sf):
    d = views.cleaned_documents(spark, sf)
    return _exploded(d, docs.small_merged(docs.chunked(docs.numbered(docs.without_headers(F.col("paras"))))), "page section paragraph text")


@query("chunk_finalize", views.chunks_sql("SELECT doc_id, ordinal, page, section, paragraph, text_hash FROM chunks"))
def chunk_finalize(spark, sf):
    return views.passages(spark, sf).select("doc_id", "ordinal", "page", "section", "paragraph", "text_hash")


def _with_scans(chunks: DataFrame) -> DataFrame:
    scanned = (F.col("doc_id") % 6 == 0) & (F.coalesce("page", F.lit(1)) % 2 == 1)
    return chunks.withColumn("extraction_method", F.when(scanned, "ocr").otherwise("text"))


@query("doc_rollup", views.chunks_sql("""SELECT doc_id, max(page) AS page_count, count(*) AS chunk_count, CASE WHEN count(DISTINCT m) > 1 THEN 'mixed' ELSE min(m) END AS extraction_method
FROM (SELECT *, CASE WHEN doc_id % 6 = 0 AND coalesce(page, 1) % 2 = 1 THEN 'ocr' ELSE 'text' END AS m FROM chunks) GROUP BY 1"""))
def doc_rollup(spark, sf):
    return docs.document_rollup(_with_scans(views.passages(spark, sf)), ["doc_id"])


@query("doc_status", views.chunks_sql("""SELECT d.doc_id, CASE WHEN d.doc_id % 29 = 0 OR n IS NULL THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN d.doc_id % 29 = 0 THEN 'Could not read this file' WHEN n IS NULL THEN 'No readable text found' END AS error_message,
  CASE WHEN d.doc_id % 29 = 0 THEN 0 ELSE coalesce(n, 0) END AS chunk_count
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks WHERE doc_id % 31 <> 0 GROUP BY 1) USING (doc_id)"""))
def doc_status(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 29 == 0, "Could not read this file").alias("parse_error"))
    return docs.document_status(d, views.passages(spark, sf).filter("doc_id % 31 <> 0"), ["doc_id"])


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One recognised box per order line: document = order, two pages."""
    li = views.table(spark, sf, "lineitem")
    top = (F.col("l_quantity") * 6).alias("top")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        (F.col("l_partkey") % 500).cast("double").alias("left"), top, (F.col("l_quantity") * 6 + 10 + F.col("l_linenumber") % 3).alias("bottom"),
        F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("text"), F.round(1 - 3 * F.col("l_tax"), 4).alias("score"))


@query("ocr_page_stats", """SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS INTEGER) AS page, avg(round(1 - 3 * l_tax, 4)) AS confidence,
  median(CAST(10 + l_linenumber % 3 AS DOUBLE)) AS height, count(*) AS boxes FROM lineitem GROUP BY ALL""")
def ocr_page_stats(spark, sf):
    return layout.ocr_page_stats(boxes(spark, sf))


@query("ocr_line_paragraphs")
def ocr_line_paragraphs(spark, sf):
    return layout.ocr_paragraphs(boxes(spark, sf))


@query("ocr_quality_band", """SELECT l_linestatus, l_returnflag, CASE WHEN l_suppkey % 4 <> 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'good' WHEN round(1 - 3 * l_tax, 4) < 0.8 THEN 'low' ELSE 'good' END AS band,
  count(*) AS passages FROM lineitem GROUP BY ALL""")
def ocr_quality_band(spark, sf):
    li = views.table(spark, sf, "lineitem")
    method = F.when(F.col("l_suppkey") % 4 == 0, "ocr").otherwise("text")
    confidence = F.when(F.col("l_suppkey") % 3 != 0, F.round(1 - 3 * F.col("l_tax"), 4))
    return li.groupBy("l_linestatus", "l_returnflag", layout.quality_band(method, confidence).alias("band")).agg(F.count(F.lit(1)).alias("passages"))
