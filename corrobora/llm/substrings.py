"""Substring deduplication by seed and extend: repeated passages of at least 35 words are cut out of the texts.

Words are runs of other than white space, unchanged. A window is 35 consecutive words of one document; it is repeated if its words also start
anywhere else, in the same document or another. Every word inside a repeated window is removed, judged on the texts as given.

Seeds: winnowing takes the smallest of the 20 hashes of 16-word runs in each window, so two equal windows have the same seed at the same
place. Windows that follow each other with one seed occurrence are a block. Documents are joined on seeds: blocks whose seed stands
nowhere else are out. Extension: a block's whole span, from its first window's first word to its last window's last, is compared first; a span
found twice settles all its windows at once, and copies of a passage cost one row each. Where the span is unique (the ends of a repeat), the
block's windows are compared one by one with each other and with one copy of each repeated span that has the same seed. Overlapping repeated
windows then merge into maximal repeats. Contents are compared by 64-bit hashes.

Nulls: a null text has no words; a null id is a document of its own that takes no part, with nothing removed. Rows that share an id are one
document written twice: a window that both have is repeated. Short texts have no window. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .runtime import free_name, kept

WINDOW, SEED_WORDS = 35, 16


def blocks_of(pieces: H.Pieces, window: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """Of each block: seed hash, span hash, text, first word within the text, number of windows."""
    counts, prefix = pieces.counts(), pieces.prefix()
    runs = np.maximum(counts - window + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(runs)))
    if not bounds[-1]:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    starts = np.repeat(pieces.first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    at = np.arange(len(pieces.hashes) - seed_words + 1)
    grams = H.span_hashes(prefix, H.WORD_BASE, at, at + seed_words)
    mask = np.uint64((1 << max(20, int(len(grams)).bit_length())) - 1)
    low = (grams & ~mask) | at.astype(np.uint64)
    width, have = window - seed_words + 1, 1
    while have < width:                      # sliding minimum: windows of `have` become windows of `have + step`
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    seed = (low[starts] & mask).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), runs)
    new = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.append(new, len(seed)))
    first = starts[new]
    spans = H.span_hashes(prefix, H.WORD_BASE, first, first + n + window - 1)
    return grams[seed[new]].view(np.int64), spans.view(np.int64), text[new], first - pieces.first[text[new]], n


def _blocks(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, pieces in H.slices(batch.column(1), H.SPACED, H.EXACT_VALUES):
                seeds, spans, text, at, n = blocks_of(pieces, window, seed_words)
                yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(spans), batch.column(0).take(pa.array(text + low)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                                                 ["seed", "span", "doc", "at", "n"])
    return run


def _windows(window: int):
    """From (doc, text, blocks) to one row per window of these blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for low, high, pieces in H.slices(batch.column(1), H.SPACED, H.EXACT_VALUES):
                parts = [(d, b["at"], b["n"], b["copies"]) for d in range(low, high) for b in lists[d]
                         if b["at"] + b["n"] + window - 1 <= pieces.first[d - low + 1] - pieces.first[d - low]]    # else: another row of the same id
                d, at, n, copies = (np.array(x, dtype=np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(at, n) + inner
                starts = np.repeat(pieces.first[d - low], n) + place
                hashes = H.span_hashes(pieces.prefix(), H.WORD_BASE, starts, starts + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(copies, n)), batch.column(0).take(pa.array(np.repeat(d, n))), pa.array(place.astype(np.int32))],
                                                 ["hash", "copies", "doc", "at"])
    return run


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc, at, n): the n windows of document `doc` that start at its words at .. at+n-1 are repeated."""
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    found = kept(texts.mapInArrow(_blocks(window, seed_words), "seed long, span long, doc long, at int, n int"), "blocks")
    seeds = found.groupBy("seed").agg(F.count("*").alias("places")).where("places > 1").select("seed")
    blocks = kept(found.join(seeds, "seed", "left_semi"), "seeded")
    spans = kept(blocks.groupBy("span").agg(F.count("*").alias("copies"), F.min("seed").alias("seed"), F.min(F.struct("doc", "at", "n")).alias("first")), "spans")
    repeated = blocks.join(spans.where("copies > 1").select("span"), "span", "left_semi").select("doc", "at", "n")

    lone = spans.where("copies = 1")
    probes = lone.union(spans.where("copies > 1").join(lone.select("seed").distinct(), "seed", "left_semi").select(*spans.columns))
    lists = probes.select("first.*", "copies").groupBy("doc").agg(F.collect_list(F.struct("at", "n", "copies")).alias("blocks"))
    windows = kept(texts.join(lists.hint("merge"), "doc").select("doc", "text", "blocks").mapInArrow(_windows(window), "hash long, copies long, doc long, at int"), "windows")
    twice = windows.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash")
    edges = windows.where("copies = 1").join(twice, "hash", "left_semi").select("doc", "at", F.lit(1).alias("n"))
    return repeated.union(edges)


def covered(n_words: int, windows: list[dict], window: int) -> np.ndarray:
    """Which words stand in one of the windows."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    at = np.array([w["at"] for w in windows], dtype=np.int64)
    end = at + np.array([w["n"] for w in windows], dtype=np.int64) + window - 1
    fits = end <= n_words
    np.add.at(steps, at[fits], 1)
    np.add.at(steps, end[fits], -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(window: int):
    @F.arrow_udf("text string, n_words long, n_removed long, n_repeats long")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        kept_texts, words, removed, repeats = [], [], [], []
        for text, windows in zip(texts.cast(pa.large_binary()), found):
            tokens, windows = (text.as_py() or b"").split(), windows.as_py()
            gone = covered(len(tokens), windows, window) if windows else np.zeros(len(tokens), dtype=bool)
            words.append(len(tokens))
            removed.append(int(gone.sum()))
            repeats.append(int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))))
            kept_texts.append(b" ".join([t for t, g in zip(tokens, gone) if not g] if windows else tokens).decode())
        return pa.StructArray.from_arrays([pa.array(kept_texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, pa.int64())],
                                          ["text", "n_words", "n_removed", "n_repeats"])
    return cut


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """All rows and columns of `docs` and a last column `rest` (or rest_, ...): struct<text, n_words, n_removed, n_repeats>; its text has the kept
    words joined by one space, n_repeats counts the maximal repeats that were cut."""
    found = repeated_windows(docs, id_column, text_column, window, seed_words).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias((windows := free_name(docs, "windows"))))
    key = free_name(docs, "doc_key")
    joined = docs.join(kept(found, "repeats").withColumnRenamed("doc", key).hint("merge"), F.col(id_column).cast("long") == F.col(key), "left")
    empty = F.array().cast("array<struct<at:int,n:int>>")
    return joined.withColumn(free_name(docs, "rest"), _cut(window)(F.col(text_column), F.coalesce(windows, empty))).drop(key, windows)
