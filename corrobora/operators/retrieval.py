"""Ranking passages for many questions at once.

Passages are named by (doc_id, ordinal), which is also their corpus order and the tie-break of every ranking.
Text joins in only at the end, for the passages that were chosen.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import text as tx
from ..operators import layout
from ..sources.tables import stored

KEY = ["doc_id", "ordinal"]


def in_ready_scope(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages of ready documents, with their scope."""
    return passages.join(documents.filter("status = 'ready'").select("doc_id", "scope"), "doc_id")


def _top(frame: DataFrame, order: list[Column], limit: int, rank: str) -> DataFrame:
    # a row_number bound is applied before the shuffle as well as after it
    return frame.withColumn(rank, F.row_number().over(W.partitionBy("question_id").orderBy(*order))).filter(F.col(rank) <= limit)


def bm25_top(questions: DataFrame, postings: DataFrame, terms: DataFrame, corpus: DataFrame, limit: int = fixed.CANDIDATES) -> DataFrame:
    """question_id, doc_id, ordinal, score, bm25_rank: question words meet the postings; repeated words count again.

    The weighted words are stored, so that Spark knows their size before it plans the join: few are broadcast and the postings stay where they are.
    """
    words = (questions.select("question_id", "scope", F.explode(tx.tokens(F.col("question"))).alias("token"))
             .groupBy("question_id", "scope", "token").agg(F.count(F.lit(1)).alias("times")))
    weighted = words.join(terms.select("scope", "token", "idf"), ["scope", "token"]).join(corpus.select("scope", "avg_length"), "scope")
    weighted = stored(weighted, "words")
    k1, b, tf = fixed.BM25_K1, fixed.BM25_B, F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    scored = postings.join(weighted, ["scope", "token"]).groupBy("question_id", *KEY).agg(F.round(F.sum(part), 9).alias("score"))
    return _top(scored.filter("score > 0"), [F.desc("score"), *KEY], limit, "bm25_rank")


_HITS = T.ArrayType(T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("ordinal", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def _block_top(limit: int):
    @F.pandas_udf(_HITS)
    def best(question_ids: pd.Series, question_vectors: pd.Series, doc_ids: pd.Series, ordinals: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for qids, qflat, docs, ords, flat in zip(question_ids, question_vectors, doc_ids, ordinals, vectors):
            scores = np.round(np.reshape(qflat, (len(qids), -1)).astype(np.float64) @ np.reshape(flat, (len(docs), -1)).astype(np.float64).T, 9)
            hits = []
            for qid, row in zip(qids, scores):
                keep = np.arange(len(row))
                if len(row) > limit:  # everything tied with the last kept score stays until the exact ordering
                    keep = np.flatnonzero(row >= np.partition(row, len(row) - limit)[len(row) - limit])
                for i in keep[np.lexsort((ords[keep], docs[keep], -row[keep]))][:limit]:
                    hits.append({"question_id": int(qid), "doc_id": int(docs[i]), "ordinal": int(ords[i]), "score": float(row[i])})
            out.append(hits)
        return pd.Series(out)
    return best


def dense_top(questions: DataFrame, vectors: DataFrame, limit: int = fixed.CANDIDATES, vector_block: int = 1024, question_block: int = 256) -> DataFrame:
    """Exact best passages by dot product, as blocked matrix products.

    questions: question_id, scope, vector; vectors: scope, doc_id, ordinal, vector (all of one dimension).
    A scope is cut into blocks of about `vector_block` vectors, so a scope with most of the rows becomes many small,
    evenly spread join keys; a task never holds more than one vector block and one question block, and a block pair
    returns at most `limit` hits per question.
    """
    def blocks(frame, size, key, block):
        counts = frame.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
        placed = frame.join(counts, "scope").withColumn(block, F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
        return counts, placed.groupBy("scope", block)

    def packed(rows, name):
        return F.transform(rows, lambda r: r[name])

    counts, by_block = blocks(vectors, vector_block, KEY, "block")
    stored = by_block.agg(F.collect_list(F.struct(*KEY, "vector")).alias("rows")).select(
        "scope", "block", packed(F.col("rows"), "doc_id").alias("docs"), packed(F.col("rows"), "ordinal").alias("ords"),
        F.flatten(packed(F.col("rows"), "vector")).alias("flat"))
    _, asked_by_block = blocks(questions.select("question_id", "scope", "vector"), question_block, ["question_id"], "question_block")
    asked = asked_by_block.agg(F.collect_list(F.struct("question_id", "vector")).alias("rows")).select(
        "scope", packed(F.col("rows"), "question_id").alias("qids"), F.flatten(packed(F.col("rows"), "vector")).alias("qflat"))
    asked = asked.join(counts, "scope").select("scope", "qids", "qflat", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    hits = stored.join(asked, ["scope", "block"]).select(F.explode(_block_top(limit)("qids", "qflat", "docs", "ords", "flat")).alias("h")).select("h.*")
    return _top(hits, [F.desc("score"), *KEY], limit, "dense_rank")


def fuse(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """Reciprocal rank fusion; a passage found by one list only keeps a NULL rank for the other."""
    none = F.lit(None).cast("int")
    both = bm25.select("question_id", *KEY, "bm25_rank", none.alias("dense_rank")).unionByName(
        dense.select("question_id", *KEY, none.alias("bm25_rank"), "dense_rank"))
    share = 1 / (fixed.RRF_K + F.coalesce("bm25_rank", "dense_rank"))
    return both.groupBy("question_id", *KEY).agg(
        F.round(F.sum(share), 12).alias("fused"), F.max("bm25_rank").alias("bm25_rank"), F.max("dense_rank").alias("dense_rank"))


def diverse(fused: DataFrame, top_k: int = fixed.TOP_K) -> DataFrame:
    """The best passage of every document first, then the rest by score; kept rows are numbered by score."""
    per_doc = W.partitionBy("question_id", "doc_id").orderBy(F.desc("fused"), "ordinal")
    marked = fused.withColumn("again", F.row_number().over(per_doc) > 1)
    chosen = _top(marked, [F.col("again"), F.desc("fused"), *KEY], top_k, "pick")
    by_score = W.partitionBy("question_id").orderBy(F.desc("fused"), *KEY)
    return chosen.withColumn("rank", F.row_number().over(by_score)).drop("again", "pick")


def evidence_items(chosen: DataFrame, passages: DataFrame) -> DataFrame:
    """E1..En with the stored text and location columns; only chosen passages are joined to their text. They are stored for their size to be known, as the words of questions."""
    return stored(chosen, "chosen").join(passages, KEY).withColumns({
        "eid": F.concat(F.lit("E"), F.col("rank").cast("string")), "fused_score": F.round("fused", 5)}).drop("fused")


def neighbours(passages: DataFrame, brief: list[str]) -> DataFrame:
    """Every passage with the one before and after it in its document (a document is one bounded file)."""
    w = W.partitionBy("doc_id").orderBy("ordinal")
    side = [f(F.col(c)).over(w).alias(f"{name}_{c}") for name, f in (("prev", F.lag), ("next", F.lead)) for c in brief]
    return passages.select(*KEY, *brief, *side)


def related(evidence: DataFrame, limit: int) -> DataFrame:
    return evidence.filter(F.col("rank") <= limit).withColumns({
        "quote": F.substring("text", 1, fixed.RELATED_CHARS),
        "ocr_quality": layout.quality_band(F.col("extraction_method"), F.col("ocr_confidence"))})


def recall(evidence: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per scope: how often the expected document was retrieved, by rank, and the mean reciprocal rank.

    truth: question_id, scope, doc_id.
    """
    first = evidence.groupBy("question_id", "doc_id").agg(F.min("rank").alias("first_rank"))
    joined = truth.join(first, ["question_id", "doc_id"], "left")
    return joined.groupBy("scope").agg(
        F.count(F.lit(1)).alias("expected"), F.count("first_rank").alias("found"),
        *[F.count(F.when(F.col("first_rank") <= k, 1)).alias(f"found_at_{k}") for k in cutoffs],
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def planted_in(items: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """item_id, doc_id where a passage holds a run of `words` words of the item, or all of a shorter item: equi-joins on words, never all pairs.

    What the items ask for is stored, so that Spark knows its size: where it is small, the runs of the passages are not shuffled."""
    def runs(t):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, words), " ")))
    toks = tx.tokens(F.col("text"))
    wanted = items.select("item_id", toks.alias("t")).filter(F.size("t") > 0)
    have = passages.select("doc_id", toks.alias("t"))
    long_items = stored(wanted.filter(F.size("t") >= words).select("item_id", F.explode(runs(F.col("t"))).alias("run")), "runs")
    found = have.filter(F.size("t") >= words).select("doc_id", F.explode(runs(F.col("t"))).alias("run")).join(long_items, "run").select("item_id", "doc_id")
    # a short item is met through its first word and then compared in full
    padded = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    short_items = stored(wanted.filter(F.size("t") < words).select("item_id", padded(F.col("t")).alias("run"), F.get("t", F.lit(0)).alias("word")), "short-items")
    short = have.select("doc_id", padded(F.col("t")).alias("whole"), F.explode(F.array_distinct("t")).alias("word")).join(short_items, "word").filter(F.contains("whole", "run"))
    return found.union(short.select("item_id", "doc_id")).distinct()
