"""Search tables: tokens, postings, term statistics, vectors, freshness."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..functions.text import let
from ..sources.tables import stored

PASSAGE = ["scope", "doc_id", "ordinal"]


def token_counts(tokens: Column) -> Column:
    """array<struct<token,tf>>: sort once and measure the runs; no shuffle is needed for term frequencies."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
        return let(starts, lambda st: F.transform(st, lambda p, k: F.struct(
            F.element_at(s, p).alias("token"), (F.coalesce(F.get(st, k + 1), F.size(s) + 1) - p).cast("int").alias("tf"))))
    return let(F.sort_array(tokens), runs)      # not array_sort, which calls a function of columns for each comparison


def postings(passages: DataFrame, *keep: str) -> DataFrame:
    """scope, doc_id, ordinal, length, slot, token, tf; slot numbers the distinct tokens of a passage."""
    counted = passages.select(*PASSAGE, *keep, let(tx.passage_tokens(F.col("text")), lambda t: F.struct(
        F.size(t).alias("length"), token_counts(t).alias("counts"))).alias("p"))
    return counted.select(*PASSAGE, *keep, "p.length", F.posexplode("p.counts").alias("slot", "c")).select(*PASSAGE, *keep, "length", "slot", "c.token", "c.tf")


def corpus_stats(terms: DataFrame) -> DataFrame:
    """Passages and mean length per scope, from the postings: every passage has one first slot."""
    return terms.filter("slot = 0").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))


def term_stats(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """scope, token, df, idf; a negative idf becomes a quarter of the mean idf of the scope's vocabulary."""
    return weighed(terms.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df")), corpus)


def weighed(counted: DataFrame, corpus: DataFrame) -> DataFrame:
    """Counted terms (scope, token, df and further columns) with their idf; stored once counted, as they are read twice."""
    counted = stored(counted, "counted")
    raw = counted.join(corpus.select("scope", "n"), "scope").withColumn(
        "raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("scope").agg((fixed.BM25_EPSILON * F.avg("raw_idf")).alias("floor"))
    return raw.join(mean, "scope").select(
        *counted.columns, F.when(F.col("raw_idf") < 0, F.col("floor")).otherwise(F.col("raw_idf")).alias("idf"))


def passage_text(filename: Column, section: Column, text: Column) -> Column:
    return F.concat(filename, F.lit(" — "), F.coalesce(section, F.lit("")), F.lit("\n"), text)


def unit_vector(vector: Column) -> Column:
    """Vector over its length, computed in double; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def valid_vectors(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) == dim))


def hashed_embedding(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """Offline stand-in for an embedding model: hashed word counts."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                out[row, zlib.crc32(word.encode()) % dim] += 1.0
        return out
    return embed


def embed(frame: DataFrame, text: str, make_embedder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Adds `embedding`, unit length, in batches of 32. The model is built once per task.

    If the model cannot be built or fails on a batch, that batch keeps NULL vectors and stays searchable by keyword.
    """
    size = fixed.EMBED_BATCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = make_embedder()
        except Exception:
            model = None
        for pdf in batches:
            vectors: list = []
            for start in range(0, len(pdf), size):
                texts = pdf[text].iloc[start:start + size].tolist()
                try:
                    raw = np.asarray(model(texts), dtype=np.float32)
                    norms = np.linalg.norm(raw, axis=1, keepdims=True)
                    vectors += list(np.divide(raw, norms, out=raw.copy(), where=norms > 0))
                except Exception:
                    vectors += [None] * len(texts)
            yield pdf.assign(embedding=vectors)

    from pyspark.sql import types as T
    schema = T.StructType(frame.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return frame.mapInPandas(run, schema)


def signatures(passages: DataFrame) -> DataFrame:
    return passages.groupBy("scope").agg(F.count(F.lit(1)).alias("passages"), F.max("row_no").alias("last_row"))


def stale_scopes(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Scopes whose signature differs from the one the index was built with (new, changed or emptied)."""
    old = indexed.select("scope", F.col("passages").alias("old_passages"), F.col("last_row").alias("old_last_row"))
    joined = current.join(old, "scope", "full_outer")
    return joined.filter(~(F.col("passages").eqNullSafe(F.col("old_passages")) & F.col("last_row").eqNullSafe(F.col("old_last_row")))).select(
        "scope", F.coalesce("passages", F.lit(0)).cast("bigint").alias("passages"), F.col("last_row"),
        F.when(F.col("old_passages").isNull(), "build").when(F.col("passages").isNull(), "drop").otherwise("rebuild").alias("action"))
