"""From buckets of candidates to components of verified links, without emitting all pairs of a bucket.

Buckets are rows (key, id): ids that share a key may be alike. `verify` takes pairs (u, v) and returns those that are. A bucket of n ids that all
belong together costs about n pairs: its ids are first compared with two of them only, its hubs. What is left to compare afterwards are ids that
share a key but are still in different components. These are never rows of pairs: the ids of a key are cut into blocks, and a task compares two blocks
by the exact intersections of their sets (cross_links). So the result is the same as comparing every pair.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import compact, discard, kept

Verify = Callable[[DataFrame], DataFrame]


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows (key, id) of keys with two different ids, with the lowest and the highest id of the key."""
    hubs = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    return kept(compact(buckets.join(hubs, "key").distinct()), "buckets")


def linked_components(shared: DataFrame, verify: Verify, components: Callable[[DataFrame], DataFrame], narrow: Verify, contents: "Contents", percent: int) -> DataFrame:
    """(id, component) of every id with a verified link; `shared` comes from shared_buckets. `narrow` takes the rows (key, id, component) that are
    still open and returns rows (key, id, size, most): keys of its own, of which every two ids with a link share one, the size of the id's set, and how much
    of it can be in common with any other. `contents` and `percent`: see cross_links."""
    hubs = shared.select(F.explode(F.array("low", "high")).alias("u"), F.col("id").alias("v"))
    tried = kept(compact(_pairs(hubs.where("u <> v"))), "tried")
    links = kept(compact(verify(tried).select("u", "v")), "links")
    groups = kept(components(links), "groups")
    rows = _open(shared.select("key", "id", F.lit(0).alias("size"), F.lit(0).alias("most")), groups)
    rows = _open(narrow(rows), groups)
    if rows.isEmpty():
        return groups
    # once more with the hubs of these keys, then all that is still apart, in blocks
    hubs = rows.groupBy("key").agg(F.min(F.struct("id", "component")).alias("a"), F.max(F.struct("id", "component")).alias("b"))
    hubs = rows.join(hubs, "key").select(F.explode(F.array("a", "b")).alias("hub"), "id", "component").where("hub.component <> component")
    again = kept(compact(_pairs(hubs.select(F.col("hub.id").alias("u"), F.col("id").alias("v"))).join(tried, ["u", "v"], "left_anti")), "tried")
    links = kept(compact(links.union(verify(again).select("u", "v"))), "links")
    groups = kept(components(links), "groups")
    rows = _open(rows.drop("component"), groups)
    more = cross_links(rows.select("key", "id", "component"), contents, percent)
    return groups if more is None else kept(components(links.union(more)), "groups")


def _pairs(hubs: DataFrame) -> DataFrame:
    return hubs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _open(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows (key, id, size, most, component) of keys that hold two components."""
    named = rows.join(groups, "id", "left").select("key", "id", "size", "most", F.coalesce("component", "id").alias("component"))
    keys = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    return kept(compact(named.join(keys, "key", "left_semi")), "open")


BLOCK = 512            # ids of a block that is compared by content: a task holds two
BIT_BLOCK = 2048       # ids of a block that is compared by bits first, which take 8 bytes an id
CELLS = 1 << 22        # of the matrix of ids and elements that is multiplied at a time
SKETCH = 1024          # bits, a power of two
ONE_BY_ONE = 8         # possible pairs for each set of a block up to which they are counted one by one
Contents = tuple[Callable[[DataFrame], DataFrame], str, Callable[[pa.Array], list[np.ndarray]]]


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCH bits for each run of 64-bit values, as rows of 64-bit words: a value sets the bit that its highest bits name."""
    n = len(bounds) - 1
    held = np.zeros(n * SKETCH, dtype=np.uint8)
    held[np.repeat(np.arange(n) * SKETCH, np.diff(bounds)) + (values.view(np.uint64) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(held).view(np.uint64).reshape(n, -1)


def possible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Of sets with these sketches and sizes, which may have 100 * |intersection| >= percent * |union|. No such pair is refused: a bit that only one set has
    stands for an element, at least, that only this set has."""
    own_a, own_b, either = (np.bitwise_count(x).sum(axis=-1, dtype=np.int64) for x in (a, b, a | b))
    most = np.minimum(size_a - (either - own_b), size_b - (either - own_a))
    return 100 * most >= percent * (size_a + size_b - most)


def exact_links(left: list[np.ndarray], right: list[np.ndarray], percent: int, apart: np.ndarray | None = None) -> np.ndarray:
    """Of two lists of sets of distinct values, which pairs (of those in `apart`, a matrix, if it is given) have 100 * |intersection| >= percent * |union|: a matrix,
    exact. Small sets are compared by sketches first; if few pairs are possible, these are counted one by one, else all in a matrix product."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    if left and right and sum(x.sum() for x in sizes) <= SKETCH // 2 * (len(left) + len(right)):
        held = [sketches(np.concatenate(side), np.concatenate(([0], np.cumsum(n)))) for side, n in zip((left, right), sizes)]
        hopeful = np.zeros((len(left), len(right)), dtype=bool)
        for i in range(len(left)):
            at = slice(None) if apart is None else np.flatnonzero(apart[i])
            hopeful[i, at] = possible(held[0][i], held[1][at], sizes[0][i], sizes[1][at], percent)
        rows, columns = np.nonzero(hopeful)
        if len(rows) <= ONE_BY_ONE * (len(left) + len(right)):
            hopeful[rows, columns] = [alike(left[i], right[j], percent) for i, j in zip(rows.tolist(), columns.tolist())]
            return hopeful
    values = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1                  # elements of one set only are common to none
    owner, column = owner[times[column] > 1], number[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column, common = owner[order], column[order], np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(64, min(CELLS // max(1, len(left) + len(right)), int(column[-1]) + 1 if len(column) else 1))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        held = np.zeros((len(left) + len(right), width), dtype=np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        common += held[:len(left)] @ held[len(left):].T
    same = np.rint(common).astype(np.int64)
    linked = (100 * same >= percent * (sizes[0][:, None] + sizes[1][None, :] - same)) & (same > 0)
    return linked if apart is None else linked & apart


def _compared(sets: Callable[[pa.Array], list[np.ndarray]], percent: int):
    """Rows (key, minor, i, j, on_left, on_right, id, component, content) sorted by the first four: of each such group the linked pairs (u, v), one for each two components."""
    def one(rows: pa.Table) -> pa.RecordBatch:
        on_left, on_right, ids, components = (rows[c].to_numpy() for c in ("on_left", "on_right", "id", "component"))
        held = sets(rows["content"].combine_chunks())
        l, r = np.flatnonzero(on_left), np.flatnonzero(on_right)
        linked = exact_links([held[i] for i in l], [held[i] for i in r], percent, components[l][:, None] != components[r][None, :])
        a, b = (side[k] for side, k in zip((l, r), np.nonzero(linked)))
        pairs = np.stack((np.minimum(components[a], components[b]), np.maximum(components[a], components[b])), axis=1)
        first = np.unique(pairs, axis=0, return_index=True)[1] if len(pairs) else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[a[first]]), pa.array(ids[b[first]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["key", "minor", "i", "j"]):
            yield one(rows)
    return run


PAIRS_A_ROW = 1        # of a group compared by sketches: up to here possible pairs are rows, beyond the ids in them meet their contents in blocks


def _possible_pairs(percent: int, piece: int):
    """Rows (key, minor, i, j, on_left, on_right, id, component, size, sketch) sorted by the first four: of each such group the pairs (u, v) across components whose
    sketches allow a link. Where they are more than PAIRS_A_ROW for each row, the rows in them instead, dealt to groups of at most `piece` ids a side."""
    def possible_of(rows: pa.Table, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, components = (rows[c].to_numpy().astype(np.int64) for c in ("size", "component"))
        words = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint64).reshape(len(rows), -1)
        a, b = [], []
        for i in l.tolist():
            low, high = np.minimum(sizes[r], sizes[i]), np.maximum(sizes[r], sizes[i])
            at = r[(components[r] != components[i]) & (100 * low >= percent * high)]
            at = at[possible(words[i], words[at], sizes[i], sizes[at], percent)]
            a.append(np.full(len(at), i))
            b.append(at)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["key", "minor", "i", "j"]):
            ids = rows["id"].to_numpy()
            a, b = possible_of(rows, *(np.flatnonzero(rows[c].to_numpy()) for c in ("on_left", "on_right")))
            pairs = np.unique(np.stack((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])), axis=1), axis=0)
            if len(pairs) <= PAIRS_A_ROW * len(ids):
                yield pa.RecordBatch.from_pydict({"u": pairs[:, 0], "v": pairs[:, 1]} | {f.name: pa.nulls(len(pairs), f.type) for f in _PLACED}, _POSSIBLE)
                continue
            l, r = np.unique(a), np.unique(b)
            for x in range(0, len(l), piece):
                for y in range(0, len(r), piece):
                    if y < x and np.array_equal(l, r):
                        continue                       # met as (y, x)
                    at = np.union1d(l[x:x + piece], r[y:y + piece])
                    own = {c: rows[c].to_numpy()[at] for c in ("key", "minor", "i", "j", "id", "component")}
                    own |= {"i": own["i"] * PARTS + x // piece, "j": own["j"] * PARTS + y // piece, "on_left": np.isin(at, l[x:x + piece]), "on_right": np.isin(at, r[y:y + piece])}
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_pydict({"u": none, "v": none} | {f.name: pa.array(own[f.name], f.type) for f in _PLACED}, _POSSIBLE)
    return run


PARTS = 1024           # more than a block has pieces
_PLACED = [pa.field("key", pa.int64()), *[pa.field(c, pa.int32()) for c in ("minor", "i", "j")], *[pa.field(c, pa.bool_()) for c in ("on_left", "on_right")],
           *[pa.field(c, pa.int64()) for c in ("id", "component")]]
_POSSIBLE = pa.schema([pa.field("u", pa.int64()), pa.field("v", pa.int64()), *_PLACED])


def _hopeful(different: int):
    """Of rows as for _compared, with `bits` instead of content, those with a partner in another component whose bits differ in at most so many places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["key", "minor", "i", "j"]):
            bits, components = rows["bits"].to_numpy(), rows["component"].to_numpy()
            l, r = (np.flatnonzero(rows[c].to_numpy()) for c in ("on_left", "on_right"))
            keep = np.zeros(len(bits), dtype=bool)
            for low in range(0, len(l), 256):
                own = l[low:low + 256]
                close = (np.bitwise_count((bits[own][:, None] ^ bits[r][None, :]).view(np.uint64)) <= different) & (components[own][:, None] != components[r][None, :])
                keep[own[close.any(axis=1)]] = keep[r[close.any(axis=0)]] = True
            if keep.any():
                yield from rows.drop_columns(["bits"]).filter(pa.array(keep)).combine_chunks().to_batches()
    return run


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal long or int keys, whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(batch)]))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(c[low] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def cross_links(rows: DataFrame, contents: Contents, percent: int, block: int | None = None, different: int | None = None, marks: DataFrame | None = None,
                verify: Verify | None = None) -> DataFrame | None:
    """Links (u, v) between ids of a key that are in different components, at least one for each two components that such a link joins; None if there are no rows.

    Rows are (key, id, component), and `bits` if `different` is given: then only ids with a partner whose bits differ in at most so many places are compared,
    by `marks` (id, size, sketch) first, then by content: possible pairs, where they are few, by `verify`. `contents` are a function from a table of ids to (id, content), the type of content, and a function that gives the sets of a column of it.
    Of each key the component with most ids need not be compared with itself: its blocks only meet those of the other ids, which also meet one another."""
    block = block or (BLOCK if different is None else BIT_BLOCK)
    # keys with the same ids, as bands of copies often have, count once
    alike_keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    rows = rows.join(alike_keys.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("all"))
    many = lambda n: F.greatest(F.ceil(n / block).cast("int"), F.lit(1))
    sizes = sizes.select("key", F.col("major.component").alias("major"), many(F.col("major.n")).alias("majors"), many(F.col("all") - F.col("major.n")).alias("minors"), (F.col("all") <= block).alias("single"))
    rows = kept(rows.join(sizes, "key"), "apart")
    if rows.isEmpty():
        return None
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(2)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda minor, i, j, left, right: F.struct(F.lit(minor).alias("minor"), i.alias("i"), j.alias("j"), left.alias("on_left"), right.alias("on_right"))
    yes, no, own = F.lit(True), F.lit(False), dealt("minors")
    of_major = F.transform(every("minors"), lambda i: place(0, i, dealt("majors"), no, yes))
    # a key of one block meets itself as a whole, so that its ids are placed once
    alone = F.array(place(0, F.lit(0), F.lit(0), yes, yes)) if different is not None else None
    of_minor = F.concat(F.transform(every("majors"), lambda j: place(0, own, j, yes, no)),
                        F.transform(every("minors"), lambda j: place(1, F.least(own, j), F.greatest(own, j), own <= j, own >= j)))
    own_columns = ["id", "component", *(["bits"] if different is not None else [])]
    places = F.when(F.col("component") == F.col("major"), of_major).otherwise(of_minor)
    placed = rows.select("key", *own_columns, F.explode(places if alone is None else F.when(F.col("single"), alone).otherwise(places)).alias("at")).select("key", "at.*", *own_columns)
    fetch, kind, sets = contents
    order = ["key", "minor", "i", "j"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = lambda frame: frame.repartition(tasks, *order).sortWithinPartitions(*order)
    if different is not None:
        placed = grouped(placed).mapInArrow(_hopeful(different), "key long, minor int, i int, j int, on_left boolean, on_right boolean, id long, component long")
        placed = kept(placed, "hopeful")
    more = None
    if marks is not None:
        marked = grouped(placed.join(marks.hint("merge"), "id").select(*order, "on_left", "on_right", "id", "component", "size", "sketch"))
        found = kept(marked.mapInArrow(_possible_pairs(percent, BLOCK), "u long, v long, key long, minor int, i int, j int, on_left boolean, on_right boolean, id long, component long"), "possible")
        more = kept(verify(found.where("u IS NOT NULL").select("u", "v")).select("u", "v"), "links")
        discard(placed)
        placed = found.where("u IS NULL").drop("u", "v")
        if placed.isEmpty():
            discard(rows, found)
            return more
    placed = placed.join(fetch(placed.select("id")).hint("merge"), "id").select(*order, "on_left", "on_right", "id", "component", F.col("content").cast(kind).alias("content"))
    links = kept(grouped(placed).mapInArrow(_compared(sets, percent), "u long, v long"), "links")
    discard(rows)
    return links if more is None else links.union(more)


def rarest_keys(named: DataFrame, held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """A `narrow` for sets with elements (id, key) and sizes (id, n): the keys of an id are its rarest elements.

    A linked pair has at least percent / (100 + percent) of the sum of its sizes in common, so with n elements, of which `needed` must be shared with even the
    smallest partner that keys and size allow, one of the n - needed + 1 rarest is shared."""
    sized = named.select("key", "id").join(sizes, "id")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    partner = kept(compact(sized.join(least, "key").groupBy("id").agg(F.max("n").alias("n"), F.min("least").alias("least"))), "partners")
    needed = F.ceil((F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))) * percent / (100 + percent))
    shared_keys = lambda rows: rows.join(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").hint("merge"), "key")
    # an id with too few shared elements has no link; what it shares with others then does not count for them either
    common = shared_keys(held).groupBy("id").agg(F.count("*").alias("common"))
    hopeful = kept(compact(partner.join(common, "id").where(F.col("common") >= needed).select("id")), "hopeful")
    held = held.join(hopeful, "id", "left_semi")
    mine = Window.partitionBy("id")
    ranked = shared_keys(held).withColumn("common", F.count("*").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("df", "key")))
    return ranked.join(partner, "id").where(F.col("rank") <= F.col("common") - needed + 1).select("key", "id", F.col("n").alias("size"), F.col("common").alias("most"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two arrays of distinct values: 100 * |intersection| >= percent * |union|."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high or not low:
        return False
    joined = np.concatenate((a, b))
    joined.sort()
    same = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return 100 * same >= percent * (len(a) + len(b) - same)


def list_sets(column: pa.Array) -> list[np.ndarray]:
    """The sets of a column of lists of distinct values."""
    values, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def set_checker(percent: int):
    """For mapInArrow: of rows (u, v, set of u, set of v) the (u, v) that are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(a, b, percent) for a, b in zip(list_sets(batch.column(2)), list_sets(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))
    return run
