"""MinHash near-duplicates of documents: many universal hash minima, banding, signature verification, exact check, star components.

A document's set is its distinct 5-word shingles (words are runs of other than white space, A-Z lower-cased; fewer words: the whole sequence is
one shingle). Two documents are linked if 100 * |intersection| >= 75 * |union|; the result has the components of these links.

Nulls: a null text has an empty set, as has one without words; both are linked with nothing. A row without an id never
joins others: its component is null. Repeated rows of one id count once per row in n_shingles but share one
component. Other columns are ignored. An empty table gives an empty result.

Scale: equal sets are collapsed first (by their 128-bit set sums), so copies cost one row each; similar sets meet in buckets (links.py). Ids that
share a bucket but are not in one component after the first comparisons meet again by their rarest shingles only, which loses no link.
With 16 bands of 3 minima a pair at similarity 0.75 is missed with probability 1.6e-4, at 0.8 with 1e-5.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .graph import star_components
from .links import linked_components, list_sets, rarest_keys, set_checker, shared_buckets
from .runtime import compact, kept

WORDS, PERCENT = 5, 75
BANDS, ROWS = 16, 3
AGREEING = 22          # of 48 minima; a pair at 0.75 has fewer with probability 4e-6
SEED = 7


def _sets(pieces: H.Pieces, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles, text by text, and their bounds."""
    h, bounds = H.shingles(pieces, words)
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(parts) if parts else h), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _sketcher(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, pieces in H.slices(batch.column(1), H.SPACED):
                h, bounds = _sets(pieces, words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sums = np.zeros((2, high - low), dtype=np.uint64)
                keys = signatures = None
                if len(full):
                    starts = np.append(bounds[:-1][full], bounds[-1])
                    sums[0, full] = np.add.reduceat(H.mixed(h), starts[:-1])
                    sums[1, full] = np.add.reduceat(H.mixed(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts[:-1])
                    signatures = H.minima(h, starts, bands * rows, SEED)
                    keys = H.band_keys(signatures, rows)
                where = np.full(high - low, -1)
                where[full] = np.arange(len(full))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, high - low), pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.array([signatures[i].tobytes() if i >= 0 else None for i in where], pa.binary()),
                    pa.array([keys[i] if i >= 0 else None for i in where], pa.list_(pa.int64()))], ["id", "n_shingles", "sum1", "sum2", "signature", "keys"])
    return run


def _set_lists(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, pieces in H.slices(batch.column(1), H.SPACED):
                h, bounds = _sets(pieces, words)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["id", "set"])
    return run


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(batch), -1) for i in (2, 3))
            good = (a == b).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))
    return run


def components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component (smallest id of the group of near-duplicates, or its own)."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketches = kept(texts.mapInArrow(_sketcher(words, BANDS, ROWS), "id long, n_shingles long, sum1 long, sum2 long, signature binary, keys array<long>"), "sketches")
    # the row of the smallest id stands for all rows with its set
    classes = kept(compact(sketches.where("n_shingles > 0 AND id IS NOT NULL").groupBy("sum1", "sum2", "n_shingles").agg(F.min(F.struct("id", "signature", "keys")).alias("head"))
                           .select("sum1", "sum2", "n_shingles", "head.*")), "classes")
    shared = shared_buckets(classes.select(F.explode("keys").alias("key"), "id"))
    signatures = classes.select("id", "signature")

    def sets_of(ids: DataFrame) -> DataFrame:
        return kept(texts.join(ids.distinct().hint("merge"), "id", "left_semi").mapInArrow(_set_lists(words), "id long, set array<long>"), "sets")

    def verify(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        left, right = signatures.toDF("u", "a"), signatures.toDF("v", "b")
        likely = kept(compact(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")).mapInArrow(_agreeing(AGREEING), "u long, v long"), "likely")
        sets = sets or sets_of(likely.select(F.explode(F.array("u", "v")).alias("id")))
        left, right = sets.toDF("u", "a"), sets.toDF("v", "b")
        return compact(likely.join(left, "u").join(right, "v").select("u", "v", "a", "b")).mapInArrow(set_checker(percent), "u long, v long")

    open_sets: list[DataFrame] = []

    def narrow(named: DataFrame) -> DataFrame:
        open_sets.append(sets_of(named.select("id")))
        sets = open_sets[0]
        return rarest_keys(named, sets.select("id", F.explode("set").alias("key")), sets.select("id", F.size("set").alias("n")), percent)

    contents = (lambda ids: open_sets[0].select("id", F.col("set").alias("content")), "array<long>", list_sets)
    groups = linked_components(shared, lambda pairs: verify(pairs, *open_sets), star_components, narrow, contents, percent)
    named = classes.join(groups, "id", "left").select("sum1", "sum2", "n_shingles", F.coalesce("component", "id").alias("component"))
    return (sketches.select("id", "n_shingles", "sum1", "sum2").join(named, ["sum1", "sum2", "n_shingles"], "left")
            .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")))
