"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. A window is 10 consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

The index is a stored table of postings (term, doc, at) of the training texts, for the terms that the items' windows need. For each window the
three terms that are rarest in the corpus are taken (counted over all documents); their lists are intersected after shifting each by its term's
place in the item, which leaves documents and alignments that hold all three at the right distance. These are then compared word by word over
the whole alignment. Allowing the shifts to differ by up to `slop` gives proximity matches instead.

Items are taken in batches of at most BATCH_WORDS words (usually one batch), so that what tasks hold of them has a bound however many there are.

Nulls: a null text has no words; rows with a null id take no part. Rows that share an id are one document; a word is hit if it is in either.
Repeated items are items of their own. Empty tables give empty results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .runtime import kept

WINDOW, RAREST = 10, 3
BATCH_WORDS = 1_000_000


def word_counts(frame: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n_words) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, pieces in H.slices(batch.column(1), H.ALNUM):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(pieces.counts().astype(np.int64))], ["id", "n_words"])
    return frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, n_words long")


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, terms): the word hashes of each item in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, pieces in H.slices(batch.column(1), H.ALNUM):
                lists = pa.ListArray.from_arrays(pa.array(pieces.first.astype(np.int32)), pa.array(pieces.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["item", "terms"])
    return items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("item"), F.col(text_column).alias("text")).mapInArrow(run, "item long, terms array<long>")


class Vocabulary:
    """Sorted terms with a bit table in front, to pick their occurrences out of a long array of word hashes."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.unique(terms.astype(np.int64)).view(np.uint64)
        self.terms.sort()
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.terms & np.uint64(0xFFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` that hold a term, and which one."""
        at = np.flatnonzero(self.bits[hashes & np.uint64(0xFFFFF)]) if len(self.terms) else np.zeros(0, np.int64)
        which = np.searchsorted(self.terms, hashes[at])
        which[which == len(self.terms)] = 0
        good = self.terms[which] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[good], which[good]


def term_counts(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(term, n) over all documents; each task sends one row per term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.terms), dtype=np.int64)
        for batch in batches:
            for _, _, pieces in H.slices(batch.column(1), H.ALNUM):
                total += np.bincount(vocabulary.find(pieces.hashes)[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.terms[seen].view(np.int64)), pa.array(total[seen])], ["term", "n"])
    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The positional index: (term, doc, at) of every occurrence of a term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, pieces in H.slices(batch.column(1), H.ALNUM):
                at, which = vocabulary.find(pieces.hashes)
                text = np.searchsorted(pieces.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(vocabulary.terms[which].view(np.int64)), batch.column(0).take(pa.array(text + low)), pa.array((at - pieces.first[text]).astype(np.int32))],
                                                 ["term", "doc", "at"])
    return texts.mapInArrow(run, "term long, doc long, at int")


def rarest_places(terms: list[int], frequency: dict[int, int], window: int, n: int = RAREST) -> list[list[int]]:
    """For each window the places of its n rarest terms, a term that repeats in the window counting at each of its places."""
    last = max(len(terms) - window, 0)
    out = [sorted(sorted(range(s, min(s + window, len(terms))), key=lambda p: (frequency.get(terms[p], 0), terms[p], p))[:n]) for s in range(last + 1)]
    return [list(x) for x in dict.fromkeys(map(tuple, out))]


def alignments(index: DataFrame, probes: DataFrame, slop: int = 0) -> DataFrame:
    """(item, doc, shift): where all the places of one of an item's windows are found; probes has (item, windows array<array<int>>, terms).

    With slop 0 the places stand exactly as in the item, shifted by `shift` words. Otherwise they stand within about `slop` words of that, in
    any order, and `shift` is the smallest of theirs."""
    places = probes.select("item", F.explode(F.array_distinct(F.flatten("windows"))).alias("place"), "terms").select("item", "place", F.col("terms")[F.col("place")].alias("term"))
    hits = index.join(places, "term").select("item", "doc", "place", (F.col("at") - F.col("place")).alias("shift"))
    if not slop:
        # places as bits of a long; places 63 apart share a bit, which only lets through an alignment that the comparison of words then turns down
        bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place % 63)
        found = hits.groupBy("item", "doc", "shift").agg(F.bit_or(bit(F.col("place"))).alias("places"))
        masks = F.transform("windows", lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda m, place: m.bitwiseOR(bit(place))))
        whole = F.exists("masks", lambda m: m.bitwiseAND(F.col("places")) == m)
        return found.join(probes.select("item", masks.alias("masks")), "item").where(whole).select("item", "doc", "shift")
    cell = F.floor(F.col("shift") / (slop + 1))
    hits = hits.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    found = hits.groupBy("item", "doc", "cell").agg(F.collect_set("place").alias("places"), F.min("shift").alias("shift"))
    whole = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("places"))) == 0)
    return found.join(probes.select("item", "windows"), "item").where(whole).select("item", "doc", "shift").distinct()


def _phrases(items: dict[int, np.ndarray], window: int):
    """From (doc, text, alignments) to the maximal runs of at least `window` equal words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column(2).to_pylist(), []
            for low, high, pieces in H.slices(batch.column(1), H.ALNUM):
                for d in range(low, high):
                    words = pieces.hashes[pieces.first[d - low]:pieces.first[d - low + 1]].view(np.int64)
                    for x in lists[d]:
                        terms, shift = items[x["item"]], x["shift"]
                        a, b = max(0, -shift), min(len(terms), len(words) - shift)
                        if b <= a:
                            continue
                        same = np.concatenate(([0], (terms[a:b] == words[a + shift:b + shift]).astype(np.int8), [0]))
                        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
                        least = min(window, len(terms))
                        out += [(d, x["item"], int(s + a + shift), int(e + a + shift)) for s, e in edges if e - s >= least]
            d, item, start, stop = (list(x) for x in zip(*out)) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                                             ["doc", "item", "start", "stop"])
    return run


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
            window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(doc, item, start, stop): exact phrase matches as maximal runs of words [start, stop). With `slop`, proximity matches (doc, item, shift)."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    terms = kept(item_terms(items, item_column, item_text).where(F.size("terms") > 0).withColumn("item_row", F.monotonically_increasing_id()), "items")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = -(-total // BATCH_WORDS)
    found = [_batch_matches(spark, texts, terms.where(F.pmod(F.xxhash64("item_row"), F.lit(batches)) == b), window, slop) for b in range(batches)]
    if not found:
        return spark.createDataFrame([], "doc long, item long, start int, stop int" if slop is None else "doc long, item long, shift int")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _batch_matches(spark: SparkSession, texts: DataFrame, terms: DataFrame, window: int, slop: int | None) -> DataFrame:
    rows = terms.collect()                                  # at most about BATCH_WORDS words
    by_row = {r.item_row: np.array(r.terms, dtype=np.int64) for r in rows}
    item_of = {r.item_row: r.item for r in rows}
    vocabulary = Vocabulary(np.concatenate([*by_row.values(), np.zeros(0, np.int64)]))
    frequency = {r.term: r.n for r in term_counts(texts, vocabulary).collect()}      # no more rows than the batch has words
    windows = {k: rarest_places(list(t.tolist()), frequency, window) for k, t in by_row.items()}
    needed = np.array([by_row[k][p] for k, w in windows.items() for p in {p for x in w for p in x}], dtype=np.int64)
    index = kept(postings(texts, Vocabulary(needed)), "postings")
    probes = spark.createDataFrame([(k, windows[k], by_row[k].tolist()) for k in by_row], "item long, windows array<array<int>>, terms array<long>")
    candidates = alignments(index, probes, slop or 0)
    names = spark.createDataFrame(list(item_of.items()), "item_row long, item long")
    if slop is not None:
        return candidates.join(names, F.col("item_row") == candidates["item"]).select("doc", names["item"], "shift")
    lists = kept(candidates.groupBy("doc").agg(F.collect_list(F.struct("item", "shift")).alias("at")), "candidates")
    runs = texts.join(lists.hint("merge"), "doc").select("doc", "text", "at").mapInArrow(_phrases(by_row, window), "doc long, item_row long, start int, stop int")
    return runs.join(names, "item_row").select("doc", "item", "start", "stop").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, items (ids of the items found, sorted as strings)."""
    found = kept(matches(docs, items, id_column, text_column, item_column, item_text, window), "matches")
    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))
    # spans in order: each adds what it reaches beyond all before it
    step = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.stop - F.greatest(acc.end, x.start))).alias("n"), F.greatest(acc.end, x.stop).alias("end"))
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc.n.cast("long"))
    per_doc = found.groupBy("doc").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")).select(F.col("doc").alias("id"), hit.alias("n_hit"), "items")
    counts = word_counts(docs, id_column, text_column)
    return counts.join(per_doc, "id", "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
