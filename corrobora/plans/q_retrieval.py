"""Queries over search tables and rankings: benchmark items ask, documents answer, sources are the scopes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..operators import indexing as ix
from ..operators import retrieval as rt
from ..sources import tables
from . import views
from .catalog import query

DIM = 64


def with_status(spark: SparkSession, sf: str) -> DataFrame:
    """documents with their scope and a status: one file in twenty-nine could not be read."""
    return views.table(spark, sf, "documents").select("source", "doc_id", "text").select(
        F.col("source").alias("scope"), "doc_id", "text", F.when(F.col("doc_id") % 29 == 0, "failed").otherwise("ready").alias("status"))


def ready_documents(spark: SparkSession, sf: str) -> DataFrame:
    return with_status(spark, sf).filter("status = 'ready'")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """scope, doc_id, ordinal, text: five lines of a ready document make a passage."""
    d = ready_documents(spark, sf).select("scope", "doc_id", F.split("text", "\n").alias("lines"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 5).cast("int")),
                        lambda k: F.array_join(F.slice("lines", k * 5 + 1, 5), "\n"))
    return d.select("scope", "doc_id", F.posexplode(pages).alias("ordinal", "text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"), F.col("text").alias("question"))


def passage_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """First passage of each document that has a vector; one vector in ten is stored with a wrong dimension."""
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(
        F.col("vec_id") % 10 == 3, F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding")).alias("vector"))
    d = ready_documents(spark, sf).select("doc_id", "scope")
    return d.join(ix.valid_vectors(e, DIM, "vector"), "doc_id").withColumn("ordinal", F.lit(0))


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf).join(e, "question_id")


def bm25(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> DataFrame:
    posts = tables.stored(ix.postings(corpus(spark, sf)), "postings")
    stats = ix.corpus_stats(posts)
    return rt.bm25_top(asked if asked is not None else questions(spark, sf), posts, ix.term_stats(posts, stats), stats)


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return rt.fuse(bm25(spark, sf), rt.dense_top(question_vectors(spark, sf), passage_vectors(spark, sf)))


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    return rt.diverse(fused(spark, sf))


_CORPUS_SQL = """
corpus AS (SELECT source AS scope, doc_id, CAST((o - 1) // 5 AS INTEGER) AS ordinal, string_agg(line, chr(10) ORDER BY o) AS text
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, o) WHERE doc_id % 29 <> 0 GROUP BY ALL),
toks AS (SELECT scope, doc_id, ordinal, CASE WHEN len(t) = 0 THEN ['_'] ELSE t END AS t FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM corpus)),
posts AS (SELECT scope, doc_id, ordinal, CAST(len(t) AS INTEGER) AS length, token, CAST(count(*) AS INTEGER) AS tf FROM toks, unnest(t) AS u(token) GROUP BY ALL),
cstats AS (SELECT scope, count(*) AS n, avg(len(t)) AS avg_length FROM toks GROUP BY 1),
raw_terms AS (SELECT scope, token, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS ri FROM posts JOIN cstats USING (scope) GROUP BY scope, token, n),
terms AS (SELECT scope, token, df, CASE WHEN ri < 0 THEN 0.25 * avg(ri) OVER (PARTITION BY scope) ELSE ri END AS idf FROM raw_terms),
questions AS (SELECT item_id AS question_id, 'src' || (item_id % 20) AS scope, text AS question FROM benchmark)"""
_BM25_SQL = """
qtoks AS (SELECT question_id, scope, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM questions),
scored AS (SELECT question_id, doc_id, ordinal, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))), 9) AS score
  FROM qtoks JOIN posts USING (scope, token) JOIN terms USING (scope, token) JOIN cstats USING (scope) GROUP BY ALL),
bm25 AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, ordinal) AS INTEGER) AS bm25_rank FROM scored WHERE score > 0 QUALIFY bm25_rank <= 20)"""
_DENSE_SQL = """
dense AS (SELECT question_id, doc_id, 0 AS ordinal, round(list_dot_product(CAST(qe.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score,
    CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(list_dot_product(CAST(qe.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, doc_id) AS INTEGER) AS dense_rank
  FROM questions q JOIN embeddings qe ON qe.vec_id = q.question_id
    JOIN documents d ON d.source = q.scope AND d.doc_id % 29 <> 0 JOIN embeddings e ON e.vec_id = d.doc_id AND e.vec_id % 10 <> 3
  QUALIFY dense_rank <= 20)"""
_FUSE_SQL = """
lists AS (SELECT question_id, doc_id, ordinal, bm25_rank AS r, 'b' AS src FROM bm25 UNION ALL SELECT question_id, doc_id, ordinal, dense_rank, 'd' FROM dense),
fused AS (SELECT question_id, doc_id, ordinal, round(sum(1.0::DOUBLE / (60 + r)), 12) AS fused, max(r) FILTER (src = 'b') AS bm25_rank, max(r) FILTER (src = 'd') AS dense_rank FROM lists GROUP BY ALL)"""
_CHOSEN_SQL = """
by_doc AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY fused DESC, ordinal) > 1 AS again FROM fused),
picked AS (SELECT * FROM by_doc QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY again, fused DESC, doc_id, ordinal) <= 10),
chosen AS (SELECT question_id, doc_id, ordinal, fused, bm25_rank, dense_rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, doc_id, ordinal) AS INTEGER) AS rank FROM picked)"""


def _sql(select: str, *parts: str) -> str:
    return f"WITH {','.join([_CORPUS_SQL, *parts])}\n{select}"


@query("idx_tokenize", r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(CASE WHEN len(t) = 0 THEN ['_'] ELSE t END, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""")
def idx_tokenize(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"), F.array_join(tx.passage_tokens(F.col("text")), " ").alias("tokens"))


@query("idx_postings", _sql("SELECT * FROM posts"))
def idx_postings(spark, sf):
    return ix.postings(corpus(spark, sf)).drop("slot")


@query("idx_term_stats", _sql("SELECT scope, token, df, round(idf, 9) AS idf, n, round(avg_length, 9) AS avg_length FROM terms JOIN cstats USING (scope)"))
def idx_term_stats(spark, sf):
    posts = tables.stored(ix.postings(corpus(spark, sf)), "postings")
    stats = ix.corpus_stats(posts)
    return ix.term_stats(posts, stats).join(stats, "scope").select(
        "scope", "token", "df", F.round("idf", 9).alias("idf"), "n", F.round("avg_length", 9).alias("avg_length"))


@query("idx_passage_text", views.chunks_sql("SELECT doc_id, ordinal, 'doc_' || doc_id || '.pdf — ' || coalesce(section, '') || chr(10) || text AS passage FROM chunks"))
def idx_passage_text(spark, sf):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return views.passages(spark, sf).select("doc_id", "ordinal", ix.passage_text(name, F.col("section"), F.col("text")).alias("passage"))


@query("idx_l2_normalize", """SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) + 0.0::DOUBLE AS x FROM (
  SELECT vec_id, i - 1 AS i, CAST(v AS DOUBLE) * (vec_id % 7) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * (vec_id % 7) AS norm
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, i))""")
def idx_l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    unit = views.table(spark, sf, "embeddings").select("vec_id", scaled.alias("v")).select("vec_id", F.posexplode(ix.unit_vector(F.col("v"))).alias("pos", "x"))
    return unit.select("vec_id", "pos", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("idx_embed_batch", _sql("SELECT scope, doc_id, ordinal, 384 AS dim, 1.0::DOUBLE AS norm FROM corpus WHERE regexp_matches(text, '\\S')"))
def idx_embed_batch(spark, sf):
    vectors = ix.embed(corpus(spark, sf).filter(tx.strip(F.col("text")) != ""), "text", ix.hashed_embedding)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("scope", "doc_id", "ordinal", F.size("embedding").alias("dim"), F.round(F.sqrt(norm), 4).alias("norm"))


@query("idx_valid_vectors", """SELECT doc_id, e.vec_id IS NOT NULL AND e.vec_id % 10 <> 3 AS dense, len(e.embedding) IS NULL AS no_vector
FROM documents LEFT JOIN embeddings e ON vec_id = doc_id""")
def idx_valid_vectors(spark, sf):
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(
        F.col("vec_id") % 10 == 3, F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding")).alias("vector"))
    valid = ix.valid_vectors(e, DIM, "vector").select("doc_id", F.lit(True).alias("valid"))
    d = views.table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left").join(valid, "doc_id", "left")
    return d.select("doc_id", F.coalesce("valid", F.lit(False)).alias("dense"), F.col("vector").isNull().alias("no_vector"))


@query("idx_freshness", """WITH cur AS (SELECT source AS scope, count(*) AS passages, max(doc_id) AS last_row FROM documents GROUP BY 1),
old AS (SELECT CASE WHEN source = 'src7' THEN 'gone' ELSE source END AS scope, count(*) AS p, max(doc_id) AS l FROM documents JOIN labels USING (doc_id) GROUP BY 1
  UNION ALL SELECT source, count(*), max(doc_id) FROM documents WHERE source = 'src7' AND n_chars < 0 GROUP BY 1)
SELECT scope, coalesce(passages, 0) AS passages, last_row, CASE WHEN p IS NULL THEN 'build' WHEN passages IS NULL THEN 'drop' ELSE 'rebuild' END AS action
FROM cur FULL JOIN old USING (scope) WHERE (passages, last_row) IS DISTINCT FROM (p, l)""")
def idx_freshness(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.col("source").alias("scope"), F.col("doc_id").alias("row_no"))
    indexed = d.join(views.table(spark, sf, "labels").select("doc_id"), "doc_id").withColumn(
        "scope", F.when(F.col("scope") == "src7", "gone").otherwise(F.col("scope")))
    return ix.stale_scopes(ix.signatures(d), ix.signatures(indexed))


@query("ret_scope_filter", _sql("SELECT scope, doc_id, ordinal FROM corpus"))
def ret_scope_filter(spark, sf):
    d = with_status(spark, sf)
    pages = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n")) - 1) / 5).cast("int"))).alias("ordinal"))
    return rt.in_ready_scope(pages, d.drop("text")).select("scope", "doc_id", "ordinal")


@query("ret_bm25_topk", _sql("SELECT * FROM bm25", _BM25_SQL))
def ret_bm25_topk(spark, sf):
    return bm25(spark, sf)


@query("ret_dense_topk", _sql("SELECT * FROM dense", _DENSE_SQL))
def ret_dense_topk(spark, sf):
    return rt.dense_top(question_vectors(spark, sf), passage_vectors(spark, sf))


@query("ret_rrf_fuse", _sql("SELECT * FROM fused", _BM25_SQL, _DENSE_SQL, _FUSE_SQL))
def ret_rrf_fuse(spark, sf):
    return fused(spark, sf)


@query("ret_bm25_only_fallback", _sql("""SELECT question_id, count(*) AS hits, count(bm25_rank) AS keyword_hits, count(dense_rank) AS vector_hits, count(dense_rank) = 0 AS keyword_only
FROM fused GROUP BY 1""", _BM25_SQL, _DENSE_SQL.replace("qe.vec_id = q.question_id", "qe.vec_id = q.question_id AND q.question_id % 5 <> 4"), _FUSE_SQL))
def ret_bm25_only_fallback(spark, sf):
    some = question_vectors(spark, sf).filter(F.col("question_id") % 5 != 4)      # the feature: the others have no vector and are answered by keywords alone
    return rt.fuse(bm25(spark, sf), rt.dense_top(some, passage_vectors(spark, sf))).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count("bm25_rank").alias("keyword_hits"), F.count("dense_rank").alias("vector_hits"),
        (F.count("dense_rank") == 0).alias("keyword_only"))


@query("ret_doc_diversity", _sql("SELECT * FROM chosen", _BM25_SQL, _DENSE_SQL, _FUSE_SQL, _CHOSEN_SQL))
def ret_doc_diversity(spark, sf):
    return chosen(spark, sf)


_EVIDENCE = "question_id, 'E' || rank AS eid, doc_id, ordinal, 'doc_' || doc_id || '.pdf' AS document, text, round(fused, 5) AS fused_score, dense_rank, bm25_rank"


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    located = corpus(spark, sf).withColumns({
        "document": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")),
        "extraction_method": F.when(F.col("doc_id") % 6 == 0, "ocr").otherwise("text"),
        "ocr_confidence": F.when(F.col("doc_id") % 6 == 0, F.when(F.col("doc_id") % 12 == 0, 0.7).otherwise(0.9))})
    return rt.evidence_items(chosen(spark, sf), located)


@query("ret_evidence_items", _sql(f"SELECT {_EVIDENCE} FROM chosen JOIN corpus USING (doc_id, ordinal)", _BM25_SQL, _DENSE_SQL, _FUSE_SQL, _CHOSEN_SQL))
def ret_evidence_items(spark, sf):
    return evidence(spark, sf).select("question_id", "eid", "doc_id", "ordinal", "document", "text", "fused_score", "dense_rank", "bm25_rank")


@query("ret_neighbours", _sql("""SELECT doc_id, ordinal, text, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM corpus WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)"""))
def ret_neighbours(spark, sf):
    return rt.neighbours(corpus(spark, sf), ["text"])


@query("ret_related", _sql("""SELECT question_id, rank, doc_id, ordinal, left(text, 240) AS quote, CASE WHEN doc_id % 12 = 0 THEN 'low' WHEN doc_id % 6 = 0 THEN 'good' END AS ocr_quality
FROM chosen JOIN corpus USING (doc_id, ordinal) WHERE rank <= 5""", _BM25_SQL, _DENSE_SQL, _FUSE_SQL, _CHOSEN_SQL))
def ret_related(spark, sf):
    return rt.related(evidence(spark, sf), fixed.RELATED_EVIDENCE_ONLY).select("question_id", "rank", "doc_id", "ordinal", "quote", "ocr_quality")


_TRUTH_SQL = """
item_runs AS (SELECT DISTINCT item_id, array_to_string(x[i:i + 7], ' ') AS run FROM (SELECT item_id, x, unnest(range(1, greatest(len(x) - 7, 1) + 1)) AS i
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM benchmark) WHERE len(x) > 0)),
planted AS (SELECT DISTINCT item_id, t.scope, t.doc_id FROM toks t JOIN item_runs ON contains(' ' || array_to_string(t.t, ' ') || ' ', ' ' || run || ' ')),
truth AS (SELECT item_id || '@' || scope AS question_id, scope, doc_id FROM planted),
asked AS (SELECT DISTINCT p.item_id, p.item_id || '@' || scope AS question_id, p.scope, b.text AS question FROM planted p JOIN benchmark b USING (item_id)),
no_dense AS (SELECT question_id, doc_id, ordinal, CAST(NULL AS INTEGER) AS dense_rank FROM bm25 WHERE false)"""
_ASKED_BM25_SQL = _BM25_SQL.replace("FROM questions)", "FROM asked)")
_KEYWORD_FUSE_SQL = _FUSE_SQL.replace("FROM dense)", "FROM no_dense)")
_PLANTED_SQL = _TRUTH_SQL.rpartition(",\nno_dense")[0]
_NO_DENSE_SQL = _TRUTH_SQL.rpartition(",\n")[2]


@query("ret_quality_eval", _sql("""SELECT scope, count(*) AS expected, count(fr) AS found, count(*) FILTER (fr <= 1) AS found_at_1, count(*) FILTER (fr <= 5) AS found_at_5,
  count(*) FILTER (fr <= 10) AS found_at_10, round(avg(coalesce(1.0::DOUBLE / fr, 0)), 6) AS mrr
FROM truth LEFT JOIN (SELECT question_id, doc_id, min(rank) AS fr FROM chosen GROUP BY ALL) USING (question_id, doc_id) GROUP BY 1""",
    _PLANTED_SQL, _ASKED_BM25_SQL, _NO_DENSE_SQL, _KEYWORD_FUSE_SQL, _CHOSEN_SQL))
def ret_quality_eval(spark, sf):
    truth, asked = planted_questions(spark, sf)
    return rt.recall(keyword_chosen(spark, sf, asked), truth.select("question_id", "scope", "doc_id"))


def planted_questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every item asked in every scope that holds a run of its words: the documents to be found, and the questions."""
    c, items = corpus(spark, sf), views.table(spark, sf, "benchmark")
    places = c.select("doc_id", "scope").distinct()
    # found once, read by every step of the ranking
    truth = tables.stored(rt.planted_in(items, c).join(places, "doc_id").withColumn("question_id", F.concat_ws("@", "item_id", "scope")), "planted")
    asked = truth.select("item_id", "question_id", "scope").distinct().join(items, "item_id").select("item_id", "question_id", "scope", F.col("text").alias("question"))
    return truth, asked


def keyword_chosen(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    ranked = bm25(spark, sf, asked)
    empty = ranked.filter(F.lit(False)).withColumn("dense_rank", F.lit(None).cast("int"))
    return rt.diverse(rt.fuse(ranked, empty))
