"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

A table's hash of a normalised vector v is floor((a . v + b) / width) for several random directions a, packed into one bucket number. Vectors meet
if they share a bucket in one of the tables; every such pair is compared once, by its cosine in double precision, in the first table where it meets.
With 8 directions of width 2 and 32 tables a pair at cosine 0.9 (distance 0.447) is missed with probability 7e-4, at 0.95 with 2e-6.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths are never compared. A
null id gets a null component. Rows that share an id are one vector (the largest by its components). Other columns are ignored.

Scale: pairs are never rows. A bucket is cut into blocks of at most about 1024 vectors, and a task multiplies two blocks at a time and sends one row
per vector: how many links it found, and the smallest id it is connected to there.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import star_components
from .runtime import compact, kept

COSINE = 0.9
TABLES, DIRECTIONS, WIDTH = 32, 8, 2.0
BLOCK = 1024
SEED = 8


def bucket_numbers(units: np.ndarray, tables: int, directions: int, width: float, seed: int) -> np.ndarray:
    """(vectors, tables) of packed cells, 4 bits each; beyond 4 bits cells are clipped, which only makes the outermost ones wider."""
    rng = np.random.Generator(np.random.PCG64(seed * 1_000_003 + units.shape[1]))
    a = rng.standard_normal((units.shape[1], tables * directions))
    b = rng.uniform(0, width, tables * directions)
    cells = np.clip(np.floor((units @ a + b) / width), -8, 7).astype(np.int64) + 8
    return (cells.reshape(len(units), tables, directions) << (4 * np.arange(directions))).sum(axis=2).astype(np.uint32).view(np.int32)


def _hashed(tables: int, directions: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, tuple[list, list]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None and v and None not in v:
                    by_size.setdefault(len(v), ([], []))[0].append(i)
                    by_size[len(v)][1].append(v)
            for size, (ids, vectors) in by_size.items():
                x = np.array(vectors, dtype=np.float64)
                scale = np.abs(x).max(axis=1)
                good = np.isfinite(x).all(axis=1) & (scale > 0)
                x = x[good] / scale[good][:, None]
                units = x / np.linalg.norm(x, axis=1)[:, None]
                numbers = bucket_numbers(units, tables, directions, width, SEED)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[good]), pa.array(np.full(len(x), size, np.int32)), pa.array([u.tobytes() for u in units], pa.binary()),
                                                  pa.array([n.tobytes() for n in numbers], pa.binary()), pa.array(list(numbers), pa.list_(pa.int32()))], ["id", "size", "unit", "numbers", "buckets"])
    return run


def connected(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each vector of a block the smallest id it reaches by links inside the block."""
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (low == label).all():
            return label
        label = low


def _block_links(table: int, left: tuple, right: tuple, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of links first met in this table, smallest id reached) of two blocks, or of one with itself."""
    (ids, units, numbers), (other, other_units, other_numbers) = left, right
    linked = units @ other_units.T >= cosine
    if same:
        np.fill_diagonal(linked, False)
    new = linked.copy()
    at = np.flatnonzero(linked.any(axis=1))
    for earlier in range(table if len(at) else 0):
        new[at] &= numbers[at, earlier][:, None] != other_numbers[:, earlier][None, :]
    if same:
        keep = at
        return ids[keep], new[keep].sum(axis=1), connected(linked[np.ix_(keep, keep)], ids[keep])
    at2 = np.flatnonzero(linked.any(axis=0))
    all_ids = np.concatenate((ids[at], other[at2]))
    square = np.zeros((len(all_ids), len(all_ids)), dtype=bool)
    square[:len(at), len(at):] = linked[np.ix_(at, at2)]
    square[len(at):, :len(at)] = square[:len(at), len(at):].T
    counts = np.concatenate((new[np.ix_(at, at2)].sum(axis=1), new[np.ix_(at, at2)].sum(axis=0)))
    return all_ids, counts, connected(square, all_ids)


def _compared(cosine: float, tables: int):
    def one(rows: dict) -> pa.RecordBatch:      # the key is (table, size, bucket, i, j)
        table, i, j = rows["key"][0], rows["key"][3], rows["key"][4]
        block, ids = np.array(rows["block"]), np.array(rows["id"], dtype=np.int64)
        units = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(ids), -1)
        numbers = np.frombuffer(b"".join(rows["numbers"]), np.int32).reshape(len(ids), tables)
        pick = lambda m: (ids[m], units[m], numbers[m])
        found = _block_links(table, pick(block == i), pick(block == j), i == j, cosine)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int64)), pa.array(found[2])], ["id", "n", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict = {"key": None}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, block, i, unit, numbers in zip(*columns):
                if key != rows["key"]:
                    if rows["key"] is not None:
                        yield one(rows)
                    rows = {"key": key, "block": [], "id": [], "unit": [], "numbers": []}
                rows["block"].append(block)
                rows["id"].append(i)
                rows["unit"].append(unit)
                rows["numbers"].append(numbers)
        if rows["key"] is not None:
            yield one(rows)
    return run


def components(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, tables: int = TABLES, directions: int = DIRECTIONS,
               width: float = WIDTH) -> DataFrame:
    """(id, n_links, component) of each id: other vectors it is linked with, and the smallest id of its group."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).groupBy("id").agg(F.max("v").alias("v"))
    rows = kept(rows, "vectors")
    hashed = kept(rows.mapInArrow(_hashed(tables, directions, width), "id long, size int, unit binary, numbers binary, buckets array<int>"), "hashed")
    places = hashed.select("id", "size", F.posexplode("buckets").alias("table", "bucket"))
    sizes = places.groupBy("table", "size", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    met = (places.join(sizes, ["table", "size", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))))
    key = ["table", "size", "bucket", "i", "j"]
    met = met.select("id", "table", "size", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    met = met.join(hashed.select("id", "unit", "numbers"), "id").repartition(*key).sortWithinPartitions(*key).select(*key, "block", "id", "unit", "numbers")
    found = kept(met.mapInArrow(_compared(cosine, tables), "id long, n long, low long"), "links")
    links = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    groups = kept(compact(star_components(found.where("low < id").select(F.col("id").alias("u"), F.col("low").alias("v")))), "groups")
    return (rows.select("id").join(links, "id", "left").join(groups, "id", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component")))
