"""Inputs derived from the given tables: uploads, layout spans, paragraphs, passages, questions, claims, replies, runs.

Each view has a Spark form and, where a query is checked by SQL, the same rows as SQL common table expressions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..operators import documents as docs
from ..sources.tables import remove, shared_folder


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file footer once, not once per reference."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


# --- paragraphs of paged documents ---------------------------------------------------------------
def raw_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, text, paras: five lines make a page (no pages for odd ids); planted headers, headings, footers."""
    return raw_from(table(spark, sf, "documents").select("doc_id", "source", "text"))


def raw_from(documents: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "source", "text", F.split("text", "\n").alias("lines"))
    page = F.when(F.col("doc_id") % 2 == 0, F.lit(1))

    def para(text, i, heading):
        return F.struct((page + F.floor(i / 5)).cast("int").alias("page"), F.lit("text").alias("method"),
                        F.lit(None).cast("double").alias("confidence"), text.alias("text"), heading.alias("heading"))

    def expand(line, i):
        number = (F.floor(i / 7) + 1).cast("string")
        no, last_page = (F.floor(i / 5) + 1).cast("string"), (F.floor((F.size("lines") - 1) / 5) + 1).cast("string")
        doc, ends_page = F.col("doc_id"), (i % 5) == 4
        return F.array(
            F.when((doc % 4 == 0) & (i % 5 == 0), para(F.concat(F.lit("Confidential "), F.col("source")), i, F.lit(False))),
            F.when(i % 7 == 0, para(F.concat(number, F.lit(". Section "), number), i, F.lit(True))),
            para(line, i, tx.is_heading(line, F.lit(True))),
            F.when((doc % 8).isin(0, 2) & ends_page, para(F.lit("Internal use only"), i, F.lit(False))),
            F.when((doc % 3 == 0) & ends_page, para(F.concat(F.lit("Page "), no, F.lit(" of "), last_page), i, F.lit(False))))

    return d.select("doc_id", "source", "text", F.filter(
        F.flatten(F.transform("lines", expand)), lambda p: p.isNotNull()).alias("paras"))


def cleaned_documents(spark: SparkSession, sf: str) -> DataFrame:
    return raw_paragraphs(spark, sf).select("doc_id", "source", docs.cleaned(F.col("paras"), F.col("text")).alias("paras"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return docs.passages(raw_paragraphs(spark, sf), ["doc_id", "source"])


HEADING_SQL = r"""(t <> '' AND length(t) <= 80 AND right(t, 1) NOT IN ('.', ',', ';') AND NOT regexp_matches(t, ':\s*\S')
 AND (regexp_matches(t, '^(\d+(\.\d+)*\.?|Section|Article|Clause|Schedule|Annex)\s+\S')
      OR (regexp_matches(t, '\S\s+\S') AND upper(t) = t AND lower(t) <> t)))"""

PARAGRAPHS_SQL = rf"""
lines AS (SELECT doc_id, source, o - 1 AS i, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, o)),
last_line AS (SELECT doc_id AS d, max(i) AS li FROM lines GROUP BY 1),
raw_paras AS (
  SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 1 + i // 5 END AS page, i * 5 AS pp, 'Confidential ' || source AS raw FROM lines WHERE doc_id % 4 = 0 AND i % 5 = 0
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 1 + i // 5 END, i * 5 + 1, (i // 7 + 1) || '. Section ' || (i // 7 + 1) FROM lines WHERE i % 7 = 0
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 1 + i // 5 END, i * 5 + 2, line FROM lines
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 1 + i // 5 END, i * 5 + 3, 'Internal use only' FROM lines WHERE doc_id % 8 IN (0, 2) AND i % 5 = 4
  UNION ALL SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 1 + i // 5 END, i * 5 + 4, 'Page ' || (i // 5 + 1) || ' of ' || (li // 5 + 1) FROM lines JOIN last_line ON d = doc_id WHERE doc_id % 3 = 0 AND i % 5 = 4),
clean_paras AS (
  SELECT doc_id, source, CAST(page AS INTEGER) AS page, pp, text, heading FROM (
    SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text, {HEADING_SQL} AS heading FROM (SELECT *, trim(raw) AS t FROM raw_paras))
  WHERE text <> '' AND NOT regexp_matches(text, '(?i)^\s*(page\s*)?\d+(\s*(of|/)\s*\d+)?\s*$')),
paged AS (SELECT doc_id, count(DISTINCT page) AS np FROM clean_paras GROUP BY 1),
f1 AS (SELECT *, page IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, page ORDER BY pp) = 1 AS edge FROM clean_paras),
r1 AS (SELECT doc_id, text FROM f1 JOIN paged USING (doc_id) WHERE edge AND np >= 3 AND length(text) <= 60 GROUP BY doc_id, text, np HAVING count(*) * 2 > np),
c1 AS (SELECT f1.* EXCLUDE (edge) FROM f1 WHERE NOT (edge AND EXISTS (SELECT 1 FROM r1 WHERE r1.doc_id = f1.doc_id AND r1.text = f1.text))),
f2 AS (SELECT *, page IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, page ORDER BY pp DESC) = 1 AS edge FROM c1),
r2 AS (SELECT doc_id, text FROM f2 JOIN paged USING (doc_id) WHERE edge AND np >= 3 AND length(text) <= 60 GROUP BY doc_id, text, np HAVING count(*) * 2 > np),
body_paras AS (SELECT f2.* EXCLUDE (edge) FROM f2 WHERE NOT (edge AND EXISTS (SELECT 1 FROM r2 WHERE r2.doc_id = f2.doc_id AND r2.text = f2.text))),
paras AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pp) AS INTEGER) AS no FROM body_paras)"""

PIECES_SQL = rf"""
long_paras AS (SELECT doc_id, no, text FROM paras WHERE NOT heading AND length(text) > 1200),
units AS (
  SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id, no ORDER BY so, u) AS k, substr(s, u * 900 + 1, 900) AS unit
  FROM (SELECT doc_id, no, so, s, unnest(range(0, greatest(1, CAST(ceil(length(s) / 900.0) AS BIGINT)))) AS u
        FROM (SELECT doc_id, no, s, so FROM long_paras, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) WITH ORDINALITY AS x(s, so)))),
packed AS (
  SELECT doc_id, no, k, CAST(NULL AS VARCHAR) AS done, unit AS cur FROM units WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.no, u.k, CASE WHEN length(cur) + 1 + length(unit) > 900 THEN cur END,
    CASE WHEN length(cur) + 1 + length(unit) > 900 THEN unit ELSE cur || ' ' || unit END
  FROM packed p JOIN units u ON u.doc_id = p.doc_id AND u.no = p.no AND u.k = p.k + 1),
pieces AS (
  SELECT doc_id, no, CAST(row_number() OVER (PARTITION BY doc_id, no ORDER BY k, final) - 1 AS INTEGER) AS piece_no, piece FROM (
    SELECT doc_id, no, k, 0 AS final, done AS piece FROM packed WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, no, k, 1, cur FROM packed QUALIFY k = max(k) OVER (PARTITION BY doc_id, no)))"""

CHUNKS_SQL = rf"""
fold AS (
  SELECT doc_id, source, 0 AS no, CAST(NULL AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS txt, 0 AS first, false AS body, CAST(NULL AS VARCHAR) AS section,
    false AS emits, CAST(NULL AS INTEGER) AS e_page, CAST(NULL AS VARCHAR) AS e_section, 0 AS e_first, CAST(NULL AS VARCHAR) AS e_text, false AS lng, false AS attach
  FROM (SELECT DISTINCT doc_id, source FROM paras)
  UNION ALL
  SELECT f.doc_id, f.source, p.no, p.page,
    CASE WHEN is_long THEN NULL WHEN joins THEN f.txt || chr(10) || p.text ELSE p.text END,
    CASE WHEN joins THEN f.first ELSE p.no END, NOT is_long AND NOT p.heading, CASE WHEN p.heading THEN p.text ELSE f.section END,
    f.txt IS NOT NULL AND (NOT held OR p.heading OR (is_long AND f.body) OR (NOT is_long AND overflow)),
    f.page, f.section, f.first, f.txt, is_long, held AND NOT f.body AND is_long
  FROM fold f JOIN paras p ON p.doc_id = f.doc_id AND p.no = f.no + 1,
    LATERAL (SELECT f.txt IS NOT NULL AND f.page IS NOT DISTINCT FROM p.page AS held, NOT p.heading AND length(p.text) > 1200 AS is_long,
                    f.body AND f.txt IS NOT NULL AND length(f.txt) + 1 + length(p.text) > 900 AS overflow) a,
    LATERAL (SELECT held AND NOT p.heading AND NOT overflow AS joins) b),
chunks0 AS (
  SELECT doc_id, source, no * 100000 AS seq, e_page AS page, e_section AS section, e_first AS paragraph, e_text AS text FROM fold WHERE emits
  UNION ALL
  SELECT f.doc_id, f.source, f.no * 100000 + 1 + piece_no, f.page, f.section, CASE WHEN attach AND piece_no = 0 THEN e_first ELSE f.no END,
    CASE WHEN attach AND piece_no = 0 THEN e_text || chr(10) || piece ELSE piece END
  FROM fold f JOIN pieces USING (doc_id, no) WHERE lng
  UNION ALL
  SELECT doc_id, source, no * 100000 + 99999, page, section, first, txt FROM fold WHERE txt IS NOT NULL QUALIFY no = max(no) OVER (PARTITION BY doc_id)),
last_step AS (SELECT doc_id, max(no) AS mx FROM fold GROUP BY 1),
chunks1 AS (SELECT c.* FROM chunks0 c JOIN last_step USING (doc_id) WHERE seq % 100000 <> 99999 OR seq // 100000 = mx),
grp AS (SELECT *, count(CASE WHEN length(text) >= 40 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM chunks1),
heads AS (SELECT doc_id, g, page AS h_page FROM grp WHERE length(text) >= 40),
merged AS (
  SELECT doc_id, min(source) AS source, min(seq) AS seq, min(h_page) AS page, arg_min(section, seq) AS section0, min(paragraph) AS paragraph0,
    string_agg(text, chr(10) ORDER BY seq) AS text
  FROM grp JOIN heads USING (doc_id, g) WHERE length(text) >= 40 OR page IS NOT DISTINCT FROM h_page GROUP BY doc_id, g),
chunks AS (
  SELECT m.doc_id, m.source, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY m.seq) - 1 AS INTEGER) AS ordinal, m.page, c.section,
    CAST(c.paragraph AS INTEGER) AS paragraph, m.text, sha256(trim(regexp_replace(lower(m.text), '\s+', ' ', 'g'))) AS text_hash
  FROM merged m JOIN chunks1 c ON c.doc_id = m.doc_id AND c.seq = m.seq)"""


def paragraphs_sql(select: str) -> str:
    return f"WITH RECURSIVE {PARAGRAPHS_SQL}\n{select}"


def chunks_sql(select: str) -> str:
    return f"WITH RECURSIVE {PARAGRAPHS_SQL},{PIECES_SQL},{CHUNKS_SQL}\n{select}"


# --- claims from templated order lines; one SQL text for both engines ------------------------------------------
CLAIM_ROWS_SQL = """WITH b AS (
  SELECT l_orderkey AS run_id, l_linenumber AS tpl,
         CAST(l_suppkey % 40 AS INT) AS document_id, l_suppkey AS s,
         CASE WHEN CAST(l_quantity AS INT) % 3 = 2 THEN 45 ELSE 30 END AS t,
         CAST(round(l_discount * 100) AS INT) % 3 + 1 AS d,
         l_returnflag AS rf, l_linestatus AS ls, round(1 - 3 * l_tax, 4) AS conf,
         'k' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
             || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) || l_returnflag || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) AS chunk_id
  FROM lineitem),
c AS (
  SELECT *, CASE WHEN tpl IN (1, 2) THEN 1 WHEN tpl IN (3, 4) THEN tpl - 1 WHEN tpl = 5 THEN 4 WHEN tpl = 6 THEN 1 ELSE 5 END AS aspect_no,
    CASE tpl WHEN 1 THEN 'Payment is due within ' || CAST(t AS STRING) || ' days of the invoice date.'
             WHEN 2 THEN 'Clause 2 says net ' || CAST(t AS STRING) || ' payment terms apply to every order.'
             WHEN 3 THEN 'A late fee of ' || CAST(d AS STRING) || '.50% per month applies to overdue amounts.'
             WHEN 4 THEN 'The total amount due is USD ' || CAST(t AS STRING) || ',000.00 for this order.'
             WHEN 5 THEN CASE WHEN t = 30 THEN 'Remote work is permitted for all staff.' ELSE 'Remote work is not permitted for all staff.' END
             WHEN 6 THEN 'Payment is due within 2 weeks of receipt.'
             ELSE 'This order is governed by the laws of ' || CASE rf WHEN 'A' THEN 'Delaware' WHEN 'N' THEN 'New York' ELSE 'India' END || '.' END AS text,
    CASE tpl WHEN 1 THEN CAST(t AS STRING) || ' days' WHEN 2 THEN 'net ' || CAST(t AS STRING)
             WHEN 3 THEN CAST(d AS STRING) || '.5 percent' WHEN 4 THEN '$' || CAST(t AS STRING) || ',000'
             WHEN 5 THEN CASE WHEN t = 30 THEN 'yes' ELSE 'no' END WHEN 6 THEN '14 days'
             ELSE 'The ' || CASE rf WHEN 'A' THEN 'Delaware' WHEN 'N' THEN 'New York' ELSE 'India' END END AS value0,
    CASE tpl WHEN 3 THEN 'percent' WHEN 4 THEN 'money' WHEN 5 THEN 'boolean' WHEN 7 THEN 'text' ELSE 'duration' END AS value_type
  FROM b)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id, t, d, rf, ls, conf) AS claim_no, aspect_no,
  CASE aspect_no WHEN 1 THEN 'Payment period' WHEN 2 THEN 'Late fee' WHEN 3 THEN 'Total' WHEN 4 THEN 'Remote work' ELSE 'Governing law' END AS aspect_label,
  chunk_id, document_id, text, value_type,
  CASE WHEN s % 10 = 5 AND value_type = 'duration' THEN '99 days' ELSE value0 END AS value,
  CASE s % 10 WHEN 0 THEN replace(text, ' the ', ' thc ') WHEN 1 THEN 'this sentence is not in any passage'
              WHEN 2 THEN substring(text, 1, 8) WHEN 3 THEN upper(text) ELSE text END AS quote,
  CASE WHEN s % 25 = 4 THEN NULL ELSE chunk_id END AS cited_chunk_id,
  CASE rf WHEN 'A' THEN 'Domestic  Orders' WHEN 'N' THEN NULL ELSE ' General ' END AS scope,
  ls = 'F' AS explicit, CASE WHEN s % 4 = 0 THEN 'ocr' ELSE 'text' END AS extraction_method,
  CASE WHEN s % 4 = 0 THEN conf END AS ocr_confidence
FROM c"""

# claims as extracted (unknown aspects, repeats), their evidence, and the aspects of each run
_BASE_SQL = f"""
v4 AS ({CLAIM_ROWS_SQL}),
base AS (SELECT *, CASE WHEN run_id % 3 = 0 AND value = '14 days' THEN 'A7' ELSE 'A' || CAST(aspect_no AS STRING) END AS topic FROM v4)"""
CLAIM_COLUMNS = """run_id, CAST(no AS INT) AS claim_no, 'C' || CAST(no AS STRING) AS claim_id,
    CASE WHEN (claim_no + document_id) % 23 = 0 THEN 'A9' ELSE topic END AS aspect_id,
    CASE WHEN cited_chunk_id IS NULL THEN 'E0' ELSE 'E' || CAST(claim_no AS STRING) END AS evidence, quote, value, value_type, scope, explicit"""
_DERIVED_SQL = f"""
claims AS (
  SELECT {CLAIM_COLUMNS}
  FROM (SELECT *, claim_no AS no FROM base UNION ALL SELECT *, claim_no + 1000 AS no FROM base WHERE claim_no % 7 = 1) x),
evidence AS (
  SELECT run_id, 'E' || CAST(claim_no AS STRING) AS eid, chunk_id, document_id, 'File_' || CAST(document_id AS STRING) || '.pdf' AS document,
    CASE WHEN document_id % 3 <> 0 THEN document_id % 5 + 1 END AS page, CASE WHEN document_id % 2 = 0 THEN '4.' || CAST(document_id AS STRING) || ' Terms' END AS section,
    CAST(claim_no AS INT) AS paragraph, text, extraction_method, ocr_confidence FROM base),
aspects AS (
  SELECT DISTINCT run_id, aspect_no, 'A' || CAST(aspect_no AS STRING) AS aspect_id, aspect_label AS label FROM base
  UNION ALL SELECT DISTINCT run_id, 7, 'A7', 'Payment --  PERIOD' FROM base WHERE topic = 'A7'
  UNION ALL SELECT DISTINCT run_id, 6, 'A6', 'Warranty' FROM base WHERE run_id % 8 = 0),
note_rows AS (SELECT run_id, CAST(claim_no AS INT) AS claim_no, document_id, chunk_id, CASE WHEN run_id % 2 = 0 THEN 'A1' ELSE NULL END AS aspect_id,
  'Notice ' || CAST(document_id AS STRING) || CASE WHEN document_id % 3 = 0 THEN ' follows' ELSE ' replaces' END || ' clause 9.1 of the original order.' AS text FROM base WHERE value_type = 'text'),
note_evidence AS (SELECT run_id, 'N' || CAST(claim_no AS STRING) AS eid, 'n' || chunk_id AS chunk_id, document_id, 'File_' || CAST(document_id AS STRING) || '.pdf' AS document,
  1 AS page, 'Amendments' AS section, claim_no AS paragraph, text, 'text' AS extraction_method, CAST(NULL AS DOUBLE) AS ocr_confidence FROM note_rows),
entries AS (
  SELECT run_id, claim_no AS entry_no, 'N' || CAST(claim_no AS STRING) AS evidence, CASE WHEN document_id % 5 = 0 THEN 'too short' ELSE upper(text) END AS quote, aspect_id FROM note_rows
  UNION ALL SELECT run_id, claim_no + 1000, 'N' || CAST(claim_no AS STRING), text, aspect_id FROM note_rows)"""
CLAIMS_SQL = f"{_BASE_SQL},{_DERIVED_SQL}"

_bases: dict[tuple[str, str], str] = {}
# what is stored of an order line: numbers already rounded, everything that can be told from them left to the readers
_LINE = {"round(1 - 3 * l_tax, 4)": "conf", "CAST(round(l_discount * 100) AS INT)": "discount", "CAST(l_quantity AS INT)": "quantity",
         "l_orderkey": "run_id", "l_linenumber": "tpl", "l_suppkey": "s", "l_partkey": "part", "l_returnflag": "rf", "l_linestatus": "ls"}
_NUMBERED = "row_number() OVER (PARTITION BY run_id ORDER BY chunk_id, t, d, rf, ls, conf) AS claim_no"
BUCKET_ROWS = 500_000

ASPECT_LABELS = {1: "Payment period", 2: "Late fee", 3: "Total", 4: "Remote work", 5: "Governing law", 7: "Payment --  PERIOD", 6: "Warranty"}
ASPECT_FLAGS = f"""{", ".join(f"max(aspect_no = {n}) AS has{n}" for n in range(1, 6))}, max(topic = 'A7') AS has7, run_id % 8 = 0 AS has6"""
# the same aspects as in _DERIVED_SQL, from one reading of the claim rows: what a run has is grouped as flags, then unfolded
_SPARK_ASPECTS_SQL = f"""
aspects AS (SELECT run_id, a.* FROM (SELECT run_id, {ASPECT_FLAGS} FROM base GROUP BY run_id)
  LATERAL VIEW inline(array_compact(array({", ".join(f"CASE WHEN has{n} THEN named_struct('aspect_no', CAST({n} AS BIGINT), 'aspect_id', 'A{n}', 'label', '{label}') END" for n, label in ASPECT_LABELS.items())}))) a),"""


def _spark_derived() -> str:
    before, rest = _DERIVED_SQL.split("\naspects AS (", 1)
    return before + _SPARK_ASPECTS_SQL + "\nnote_rows AS (" + rest.split("\nnote_rows AS (", 1)[1]


def claim_base(spark: SparkSession, sf: str) -> DataFrame:
    """The claim rows, derived anew by each reader from order lines that are stored with their claim numbers, bucketed by run: what is joined by run needs no
    exchange. Only short columns are sorted and written, numbers already rounded, and a reader builds only the texts it asks for. Lines are brought together by run as
    files of a first bucketed table, whose encoded columns take a fraction of what shuffled rows do; it goes once they are numbered. Written once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _bases or not spark.catalog.tableExists(_bases[key]):
        lines = table(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for e, c in _LINE.items()])
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // BUCKET_ROWS))
        placed = _bucketed(spark, lines, buckets, "lines")
        _bases[key] = _bucketed(spark, numbered_lines(spark, spark.table(placed)), buckets, "claims")
        remove(spark.table(placed))
        spark.sql(f"DROP TABLE {placed}")
    derived = _of_lines(_BASE_SQL, "run_id, claim_no").replace(_NUMBERED, "claim_no")
    return spark.sql(f"WITH {derived} SELECT * FROM base", lines=spark.table(_bases[key]))


def numbered_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Order lines in their stored form with the number of their claim; without an exchange where they are bucketed by run."""
    numbered = _of_lines(CLAIM_ROWS_SQL, "run_id, part, quantity, discount").split("),\nc AS (")[0]
    return spark.sql(f"{numbered}) SELECT {', '.join(_LINE.values())}, {_NUMBERED} FROM b", lines=lines)


def _bucketed(spark: SparkSession, rows: DataFrame, buckets: int, name: str) -> str:
    """Stores rows bucketed by run; the name of the table."""
    path = shared_folder(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    rows.write.bucketBy(buckets, "run_id").sortBy("run_id").option("path", path).saveAsTable(table_name)
    return table_name


def _of_lines(sql: str, kept: str) -> str:
    """The claim SQL over order lines in their stored form, of which `kept` is carried along."""
    for expression, column in _LINE.items():
        sql = sql.replace(f"{expression} AS {column}", column).replace(expression, column)
    return sql.replace("SELECT run_id, ", f"SELECT {kept}, ", 1).replace("FROM lineitem", "FROM {lines}")


def claim_table(spark: SparkSession, sf: str, name: str, more: str = "") -> DataFrame:
    """claims, evidence, aspects, note_evidence, entries (or v4, the raw templated rows)."""
    frame = spark.sql(f"WITH base AS (SELECT * FROM {{base}}), v4 AS (SELECT * FROM base),{_spark_derived()}{more} SELECT * FROM {name}", base=claim_base(spark, sf))
    if "text" in frame.columns and "eid" in frame.columns:
        frame = frame.withColumn("text_hash", tx.text_hash(F.col("text")))
    return frame


VERIFIED_SQL = r"""
joined AS (SELECT c.*, e.* EXCLUDE (run_id, eid), trim(c.quote) AS q, a.label IS NOT NULL AS known, sha256(lower(e.text)) AS text_hash
  FROM claims c LEFT JOIN evidence e ON e.run_id = c.run_id AND e.eid = c.evidence LEFT JOIN aspects a ON a.run_id = c.run_id AND a.aspect_id = c.aspect_id),
reasons AS (SELECT *, CASE WHEN chunk_id IS NULL THEN 'unknown_evidence' WHEN NOT known THEN 'unknown_aspect' WHEN length(q) NOT BETWEEN 10 AND 300 THEN 'bad_quote_length'
    WHEN lower(q) <> lower(text) AND replace(q, ' thc ', ' the ') <> text THEN 'quote_not_found' END AS reason,
  left(text, length(text) - 1) AS shown, value = '99 days' AS wrong,
  CASE value_type WHEN 'duration' THEN 'quantity:' || regexp_extract(value, '[0-9]+') || '|day' WHEN 'percent' THEN 'percent:' || regexp_extract(value, '[0-9.]+')
    WHEN 'money' THEN 'money:USD|' || replace(regexp_extract(value, '[0-9,]+'), ',', '') WHEN 'boolean' THEN 'boolean:' || value ELSE 'text:' || lower(replace(value, 'The ', '')) END AS key0,
  CASE value_type WHEN 'duration' THEN regexp_extract(value, '[0-9]+') || ' days' WHEN 'percent' THEN regexp_extract(value, '[0-9.]+') || '%'
    WHEN 'money' THEN 'USD ' || substr(value, 2) WHEN 'boolean' THEN upper(left(value, 1)) || substr(value, 2) ELSE value END AS display FROM joined),
checked AS (SELECT run_id, claim_no, claim_id, aspect_id, CASE WHEN wrong OR reason IS NOT NULL AND (reason <> 'quote_not_found' OR true) THEN value ELSE display END AS value, value_type,
    CASE WHEN reason IS NULL AND NOT wrong THEN key0 END AS position_key,
    CASE WHEN scope LIKE 'Domestic%' THEN 'domestic orders' END AS scope, explicit AND NOT (reason IS NULL AND wrong) AS explicit, chunk_id, document_id, document, page, section, paragraph, text_hash, extraction_method,
    CASE WHEN reason IS NULL THEN shown END AS quote, CASE WHEN extraction_method = 'ocr' THEN CASE WHEN ocr_confidence < 0.8 THEN 'low' ELSE 'good' END END AS ocr_quality,
    coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY run_id, aspect_id, chunk_id, reason ORDER BY claim_no) > 1 THEN 'duplicate' END) AS drop_reason
  FROM reasons),
verified AS (SELECT * EXCLUDE (drop_reason) FROM checked WHERE drop_reason IS NULL)"""

NOTES_SQL = """
notes AS (SELECT n.run_id, x.entry_no, x.aspect_id, n.document || ' states that it replaces or amends an earlier provision.' AS note, n.chunk_id, n.document_id, n.document, n.page, n.section, n.paragraph,
    n.extraction_method, left(n.text, length(n.text) - 1) AS quote
  FROM entries x JOIN note_evidence n ON n.run_id = x.run_id AND n.eid = x.evidence WHERE length(x.quote) >= 10 AND contains(n.text, 'replaces')
  QUALIFY row_number() OVER (PARTITION BY n.run_id, n.chunk_id, x.aspect_id ORDER BY x.entry_no) = 1)"""


def claims_sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([CLAIMS_SQL, VERIFIED_SQL, *parts])}\n{select}"


# --- runs with their flags, and what must follow from them ----------------------------------------------------
RUNS_SQL = """
runs AS (SELECT run_id, {flag} AND run_id % 11 = 0 AS ambiguous, CASE WHEN run_id % 22 = 0 THEN 'two readings' END AS ambiguity_note, {flag} AND run_id % 37 = 0 AS evidence_only,
  {flag} AND run_id % 13 = 0 AS check_failed, NOT ({flag} AND run_id % 41 = 0) AS has_documents FROM v4 GROUP BY run_id),
drafts AS (SELECT run_id, CAST(claim_no AS INT) AS sentence_no, 'Statement ' || CAST(claim_no AS STRING) || ' (E' || CAST(claim_no AS STRING) || ', C2) holds [C1 and E2].' AS text,
  CASE WHEN claim_no % 4 <> 0 THEN 'C' || CAST(claim_no AS STRING) END AS c1, CASE WHEN claim_no % 3 = 0 THEN 'C' || CAST(claim_no - 1 AS STRING) END AS c2 FROM v4 WHERE run_id % 3 <> 1)"""


def run_flags(spark: SparkSession, sf: str, name: str, flagged: bool) -> DataFrame:
    return claim_table(spark, sf, name, "," + RUNS_SQL.replace("{flag}", str(flagged).lower()))


CONFLICTS_SQL = r"""
live AS (SELECT * FROM runs WHERE has_documents AND NOT evidence_only),
canon AS (SELECT run_id, aspect_no, aspect_id, label, check_failed, CASE WHEN check_failed THEN aspect_id ELSE first_value(aspect_id) OVER (PARTITION BY run_id, k ORDER BY aspect_no) END AS merged_id
  FROM (SELECT *, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9_]+', ' ', 'g')), ''), aspect_id) AS k FROM aspects) JOIN live USING (run_id)),
topics AS (SELECT run_id, aspect_no, aspect_id, label, check_failed FROM canon WHERE merged_id = aspect_id),
vclaims AS (SELECT v.* REPLACE (merged_id AS aspect_id), check_failed FROM verified v JOIN canon USING (run_id, aspect_id)),
pos0 AS (SELECT run_id, aspect_id, position_key, arg_min(value, claim_no) AS display, list(claim_id ORDER BY claim_no) AS ids, min(claim_no) AS first_no FROM vclaims WHERE position_key IS NOT NULL AND NOT check_failed GROUP BY ALL),
firsts AS (SELECT run_id, aspect_id, position_key, text_hash, arg_min(document_id, claim_no) AS document_id, min(claim_no) AS no FROM vclaims WHERE position_key IS NOT NULL GROUP BY ALL),
pdocs AS (SELECT run_id, aspect_id, position_key, count(*) AS n_docs, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY no) AS document_ids
  FROM (SELECT run_id, aspect_id, position_key, document_id, min(no) AS no FROM firsts GROUP BY ALL) GROUP BY ALL),
pnames AS (SELECT run_id, aspect_id, position_key, list(document ORDER BY no) AS names FROM (SELECT run_id, aspect_id, position_key, document, min(claim_no) AS no FROM vclaims WHERE position_key IS NOT NULL GROUP BY ALL) GROUP BY ALL),
positions AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, aspect_id ORDER BY n_docs DESC, first_no) - 1 AS INTEGER) AS pos_no FROM pos0 JOIN pdocs USING (run_id, aspect_id, position_key) JOIN pnames USING (run_id, aspect_id, position_key)),
pairs AS (SELECT a.run_id, a.aspect_id, least(a.position_key, b.position_key) AS key_a, greatest(a.position_key, b.position_key) AS key_b FROM vclaims a JOIN vclaims b ON a.run_id = b.run_id AND a.aspect_id = b.aspect_id AND a.claim_no < b.claim_no
  AND a.position_key <> b.position_key AND string_split(a.position_key, ':')[1] = string_split(b.position_key, ':')[1] AND a.chunk_id <> b.chunk_id AND a.text_hash <> b.text_hash
  AND (NOT starts_with(a.position_key, 'quantity') OR string_split(a.position_key, '|')[2] = '' OR string_split(b.position_key, '|')[2] = '' OR string_split(a.position_key, '|')[2] = string_split(b.position_key, '|')[2])
  AND (a.scope IS NULL OR b.scope IS NULL OR a.scope = b.scope) AND NOT a.check_failed),
results AS (SELECT t.run_id, t.aspect_no, t.aspect_id, t.label, t.check_failed, coalesce(np, 0) AS np, CASE WHEN own IS NULL THEN 'uncovered' WHEN t.check_failed THEN 'consistent' WHEN clash THEN 'conflict' WHEN np > 1 THEN 'complementary' ELSE 'consistent' END AS status,
    CASE WHEN any_text THEN 'text' ELSE 'typed' END AS basis
  FROM topics t LEFT JOIN (SELECT run_id, aspect_id, count(*) AS own FROM vclaims GROUP BY ALL) o USING (run_id, aspect_id)
    LEFT JOIN (SELECT run_id, aspect_id, count(*) AS np, bool_or(starts_with(position_key, 'text:')) AS any_text FROM positions GROUP BY ALL) p USING (run_id, aspect_id)
    LEFT JOIN (SELECT DISTINCT run_id, aspect_id, true AS clash FROM pairs) c USING (run_id, aspect_id)),
attached AS (SELECT n.run_id, coalesce(t.aspect_id, o.aspect_id) AS aspect_id, n.entry_no, n.note, n.document FROM notes n JOIN live l ON l.run_id = n.run_id AND NOT l.check_failed
  LEFT JOIN canon c ON c.run_id = n.run_id AND c.aspect_id = n.aspect_id LEFT JOIN topics t ON t.run_id = n.run_id AND t.aspect_id = coalesce(c.merged_id, n.aspect_id)
  LEFT JOIN (SELECT run_id, min(aspect_id) AS aspect_id FROM topics GROUP BY 1 HAVING count(*) = 1) o ON o.run_id = n.run_id WHERE coalesce(t.aspect_id, o.aspect_id) IS NOT NULL)"""


def conflicts_sql(select: str, flagged: bool = False, *parts: str) -> str:
    return claims_sql(select, NOTES_SQL, RUNS_SQL.replace("{flag}", str(flagged).lower()), CONFLICTS_SQL, *parts)
