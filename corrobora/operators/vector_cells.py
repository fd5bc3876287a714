"""Exact dense ranking that skips vectors: cells with centre and radius, kept with the vectors.

Each scope has pivots, drawn by a hash of the passage; a vector belongs to the cell of its nearest pivot, and a large cell is cut into chunks. For a question q and a chunk with centre c and radius r
every score is at most q . c + |q| * r. The chunks with the largest bounds are scored first; the worst of the best scores found there must be reached, so chunks with a smaller bound are skipped.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..sources.tables import stored
from .retrieval import KEY, _block_top, _top

PIVOTS = 64              # of a scope at most
BLOCK = 1024             # vectors looked at together when cells are assigned
CHUNK = 256              # vectors of a chunk
FIRST = 2                # chunks scored at first
QUESTIONS = 256          # of a block
SLACK = 1e-8

_SHAPE = T.StructType([T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _nearest(flat: pd.Series, n: pd.Series, pivots: pd.Series, m: pd.Series) -> pd.Series:
    out = []
    for f, rows, p, columns in zip(flat, n, pivots, m):
        x, c = (np.reshape(a, (k, -1)).astype(np.float64) for a, k in ((f, rows), (p, columns)))
        out.append((2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1).astype(np.int32))
    return pd.Series(out)


@F.pandas_udf(_SHAPE)
def _shape(flat: pd.Series, n: pd.Series) -> pd.DataFrame:
    out = []
    for f, rows in zip(flat, n):
        x = np.reshape(f, (rows, -1)).astype(np.float64)
        c = x.mean(axis=0)
        out.append({"centre": c, "radius": float(np.sqrt(((x - c)**2).sum(axis=1)).max())})
    return pd.DataFrame(out, columns=["centre", "radius"])


def _packed(rows: str, name: str):
    return F.transform(rows, lambda r: r[name])


def cells(vectors: DataFrame) -> DataFrame:
    """scope, cell, chunk, centre, radius, docs, ords, flat from scope, doc_id, ordinal, vector (all of one dimension). Every chunk is one row of bounded size."""
    vectors = vectors.select("scope", *KEY, "vector")
    by_hash = W.partitionBy("scope").orderBy(F.xxhash64(*KEY, F.lit(3)), *KEY)
    # a row_number bound is applied before the shuffle as well as after it
    drawn = vectors.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= PIVOTS)
    pivots = drawn.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("n", "vector"))).alias("p")).select("scope", F.flatten(_packed("p", "vector")).alias("pivots"), F.size("p").alias("m"))
    sizes = vectors.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = vectors.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64(*KEY), F.col("blocks"))).groupBy("scope", "block").agg(F.collect_list(F.struct(*KEY, "vector")).alias("rows"))
    placed = blocks.join(pivots, "scope").withColumn("own", _nearest(F.flatten(_packed("rows", "vector")), F.size("rows"), "pivots", "m"))
    rows = stored(placed.select("scope", F.explode(F.arrays_zip("rows", "own")).alias("z")).select("scope", "z.rows.*", F.col("z.own").alias("cell")), "placed")
    chunks = rows.groupBy("scope", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cut = rows.join(chunks, ["scope", "cell"]).withColumn("chunk", F.pmod(F.xxhash64(*KEY, F.lit(5)), F.col("chunks")).cast("int"))
    packed = cut.groupBy("scope", "cell", "chunk").agg(F.collect_list(F.struct(*KEY, "vector")).alias("rows"))
    flat = packed.select("scope", "cell", "chunk", _packed("rows", "doc_id").alias("docs"), _packed("rows", "ordinal").alias("ords"), F.flatten(_packed("rows", "vector")).alias("flat"))
    return stored(flat.withColumn("s", _shape("flat", F.size("docs"))).select("scope", "cell", "chunk", "s.centre", "s.radius", "docs", "ords", "flat"), "cells")


def _bounded(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, scope, vector, cell, chunk, n, bound of every question and chunk of its scope; chunks come without their vectors."""
    dot = F.aggregate(F.zip_with("centre", "vector", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    met = questions.select("question_id", "scope", "vector").join(chunks.select("scope", "cell", "chunk", "centre", "radius", F.size("docs").alias("n")), "scope")
    return met.select("question_id", "scope", "vector", "cell", "chunk", "n", (dot + norm * F.col("radius")).alias("bound"))


def _hits(pairs: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    key = ["scope", "cell", "chunk"]
    asked = pairs.withColumn("part", F.pmod(F.xxhash64("question_id"), F.lit(16))).groupBy(*key, "part").agg(F.collect_list(F.struct("question_id", "vector")).alias("q"))
    asked = asked.select(*key, F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("q") - 1) / QUESTIONS).cast("int")), lambda i: F.slice("q", i * QUESTIONS + 1, QUESTIONS))).alias("q"))
    met = asked.select(*key, _packed("q", "question_id").alias("qids"), F.flatten(_packed("q", "vector")).alias("qflat")).join(chunks.select(*key, "docs", "ords", "flat"), key)
    return met.select(F.explode(_block_top(limit)("qids", "qflat", "docs", "ords", "flat")).alias("h")).select("h.*")


def dense_top(questions: DataFrame, chunks: DataFrame, limit: int = fixed.CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(question_id, doc_id, ordinal, score, dense_rank of the best passages, the same as from every product; and question_id, vectors, scored: of how many vectors how many were looked at).

    questions: question_id, scope, vector; chunks: from `cells`."""
    mine = W.partitionBy("question_id")
    bounded = stored(_bounded(questions, chunks).withColumn("place", F.row_number().over(mine.orderBy(F.desc("bound"), "cell", "chunk"))), "bounds")
    first = stored(_hits(bounded.filter(F.col("place") <= FIRST), chunks, limit), "hits")
    least = _top(first, [F.desc("score"), *KEY], limit, "n").filter(F.col("n") == limit).select("question_id", F.col("score").alias("least"))
    rest = bounded.filter(F.col("place") > FIRST).join(least, "question_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    rest = stored(rest.drop("least"), "reachable")
    found = _top(first.unionByName(_hits(rest, chunks, limit)), [F.desc("score"), *KEY], limit, "dense_rank")
    looked = bounded.filter(F.col("place") <= FIRST).select("question_id", "n").unionByName(rest.select("question_id", "n")).groupBy("question_id").agg(F.sum("n").alias("scored"))
    return found, bounded.groupBy("question_id").agg(F.sum("n").alias("vectors")).join(looked, "question_id")
