"""Hard negatives by Fagin's threshold algorithm over integer inner products.

For every anchor the best `positives` rows of its label are found, then for each of them the best rows of other labels whose score lies in a window below the
positive's score. Higher scores come first, ties by smaller id.

Rows are dealt into blocks. A block holds, for every dimension, its rows sorted by that component. For an anchor the lists are read in step from the end
that its component's sign prefers; each row that appears is scored in full (random access) once. No row that has not appeared can score above the threshold, the sum of
the anchor's components times the values where the lists stand. A list of the best k is complete when k rows have been found and the threshold is strictly below
the last of them (strictly, since a tie may go to a smaller id), a window also when the threshold is strictly below it. The blocks' best k are then merged.

Nulls and ties: rows without id, label or vector, with an empty vector, or with null or non-finite components take no part, nor do vectors with a component beyond
MOST / scale, whose scores would not fit a long. Vectors of different lengths are never compared. Rows that share an id are one row (the one with
the largest label and vector). Other columns are ignored. An empty table gives an empty result.

Scale: anchors meet rows block by block: a task has one block of rows and one part of the anchors, both of bounded size whatever the label's share of all
rows, and returns at most k rows for each window. Positives are looked for among the anchor's own label only.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import kept

SCALE = 256
BLOCK, PART = 4096, 1024
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90               # per cent of the positive's score
MOST = 2.0**27                   # of a scaled component: 2**9 products of 2**54 fit a long
FIRST_DEPTH = 8


def scaled(vectors: DataFrame, id_column: str, label: Column, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, label, size, v): rows that take part, with v = floor(scale * component)."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & good)
    rows = rows.groupBy("id").agg(F.max(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return rows.select("id", "label", F.size("v").alias("size"), F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


class Lists:
    """The rows of a block and, for each dimension, their order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.most = int(np.abs(x).max(initial=0))
        self.exact = x.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 2**53:     # then sums of doubles are exact too
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor

    def descend(self, anchor: np.ndarray, enough: Callable[[np.ndarray, np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores seen until enough(rows, scores, threshold) or all rows are seen."""
        n, active = len(self.ids), np.flatnonzero(anchor)
        if not len(active):
            return np.arange(n), np.zeros(n, dtype=np.int64)
        falling = anchor[active] > 0
        seen, depth, step = np.zeros(n, dtype=bool), 0, FIRST_DEPTH
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while True:
            stop = min(n, depth + step)
            ranks = np.arange(depth, stop)[:, None]
            entries = self.order[np.where(falling[None, :], n - 1 - ranks, ranks), active[None, :]]
            fresh = np.zeros(n, dtype=bool)
            fresh[entries] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self.scores(new, anchor)))
            threshold = int((anchor[active] * self.x[entries[-1], active]).sum())
            if stop == n or enough(rows, scores, threshold):
                return rows, scores
            depth, step = stop, step * 2


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _kth(scores: np.ndarray, k: int) -> int | None:
    return int(-np.partition(-scores, k - 1)[k - 1]) if len(scores) >= k else None


def _searched(windows: bool, k: int, low: int, high: int):
    """For groupBy.applyInArrow: of the rows of one block and one part of the anchors, the k best of each anchor or of each of its windows."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role, ids, labels = (table[c].to_numpy() for c in ("anchor", "id", "label"))
        flat = table["v"].combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), dtype=np.int64)
        positives = table["positives"].to_pylist() if windows else None
        block = Lists(ids[~role], x[~role])
        own_labels, out = labels[~role], []
        for at in np.flatnonzero(role):
            anchor, me = x[at], ids[at]
            if not windows:
                def enough(rows, scores, threshold, me=me):
                    kth = _kth(scores[block.ids[rows] != me], k)
                    return kth is not None and threshold < kth
                rows, scores = block.descend(anchor, enough)
                others = block.ids[rows] != me
                rows, scores = rows[others], scores[others]
                best = _best(block.ids[rows], scores, k)
                out += [(me, None, None, block.ids[rows[i]], scores[i]) for i in best]
                continue
            spans = [(p["id"], p["score"]) for p in positives[at] if p["score"] >= 0]        # below 0 a window is empty

            def inside(scores, other, score):
                return other & (low * score <= 100 * scores) & (100 * scores <= high * score)

            def enough(rows, scores, threshold, label=labels[at], spans=spans):
                other = own_labels[rows] != label
                for _, score in spans:
                    if 100 * threshold >= low * score:
                        kth = _kth(scores[inside(scores, other, score)], k)
                        if kth is None or threshold >= kth:
                            return False
                return True
            if spans:
                rows, scores = block.descend(anchor, enough)
                other = own_labels[rows] != labels[at]
                for positive, score in spans:
                    fits = np.flatnonzero(inside(scores, other, score))
                    best = fits[_best(block.ids[rows[fits]], scores[fits], k)]
                    out += [(me, positive, score, block.ids[rows[i]], scores[i]) for i in best]
        names = ["anchor", "positive", "positive_score", "found", "score"]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})
    return run


def _blockwise(rows: DataFrame, anchors: DataFrame, by: list[str], search, block: int, part: int) -> DataFrame:
    """Every anchor against every row that agrees in the columns `by`, in blocks of rows and parts of anchors."""
    shape = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(
        anchors.groupBy(*by).agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), by)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    sides = [rows.select("*", F.lit(False).alias("anchor"), F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives")).join(shape, by)
             .withColumn("block", dealt("blocks", 1)).withColumn("part", every("parts")),
             anchors.select("*", F.lit(True).alias("anchor")).join(shape, by).withColumn("part", dealt("parts", 2)).withColumn("block", every("blocks"))]
    keys = list(dict.fromkeys([*by, "block", "part"]))
    columns = list(dict.fromkeys([*keys, "anchor", "id", "label", "v", "positives"]))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))        # blocks are few bytes and much work: not to be put together again
    return sides[0].select(*columns).union(sides[1].select(*columns)).repartition(tasks, *keys).groupBy(*keys).applyInArrow(search, "anchor long, positive long, positive_score long, found long, score long")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows as `scaled` gives them; `is_anchor` tells from id and label which are anchors."""
    rows = kept(rows, "scaled")
    anchors = rows.where(is_anchor)
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    near = _blockwise(rows, anchors.withColumn("positives", none), ["size", "label"], _searched(False, positives, low, high), block, part)
    near = kept(near.withColumn("n", F.row_number().over(order("anchor"))).where(F.col("n") <= positives), "positives")
    pairs = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("found").alias("id"), "score")).alias("positives"))      # at most `positives` each
    asked = anchors.join(pairs, F.col("id") == F.col("anchor")).drop("anchor")
    found = _blockwise(rows, asked, ["size"], _searched(True, negatives, low, high), block, part)
    ranked = found.withColumn("rank", F.row_number().over(order("anchor", "positive"))).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
