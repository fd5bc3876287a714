"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources in code point order (null last) weigh 3, 1, 2, 3, 1, 2, ...; together the targets are 150% of all tokens, but no source gets more than twice
what it has: the excess goes to the others by weight until none is above. Tokens are runs of other than white space.

The mix is a schedule of slots. Slot i has the golden-ratio point frac((i + 1) * 0.618...), which falls into one source's stretch of the cumulated
target shares; so any part of the schedule is close to the weights. A source's slots are ranked, and slot number k takes block k of the
source: its documents stand in a fixed hashed order, one epoch after another, and are cut into blocks of equal numbers of tokens, target / slots.
The result is (slot, ..., start, stop): which tokens of which document, in which epoch, fill a slot. The order depends on ids alone, so reruns agree.

Nulls: a null text has no tokens; a null id is ordered as one value. Rows that share an id are rows of their own, told apart by their place.
Sources without tokens have target 0. An empty table gives an empty mix.

Scale: places are sums in two levels (within one of 4096 stretches of the hashed order, and over the stretches), so no source is ordered in one
task. Per-source totals are collected: one row for each source.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import kept

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK_TOKENS = 512
GOLDEN = 0.6180339887498949
SEED = 9
CHUNK_BITS = 13


def token_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; a null text has none."""
    spaces = " \t\n\u000b\f\r"
    inner = F.btrim(text, F.lit(spaces))
    return F.coalesce(F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))), F.lit(0)).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, tokens, target) in source order: weights[i] * level, but at most most * tokens, where level makes the sum share * all tokens."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    free = {i: weights[i % len(weights)] for i in range(len(ordered))}
    out, left = [0.0] * len(ordered), share * sum(n for _, n in ordered)
    while free:
        level = left / sum(free.values())
        over = [i for i, w in free.items() if w * level > most * ordered[i][1]]
        if not over:
            for i, w in free.items():
                out[i] = w * level
            break
        for i in over:
            out[i] = most * ordered[i][1]
            left -= out[i]
            del free[i]
    return [(s, n, t) for (s, n), t in zip(ordered, out)]


def _before(frame: DataFrame, key: str, stretch: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the key's rows that come earlier, stretch by stretch and in `order` within a stretch."""
    sums = frame.groupBy(key, stretch).agg(F.sum(value).alias("stretch_sum"))
    offset = F.coalesce(F.sum("stretch_sum").over(Window.partitionBy(key).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(key, stretch, offset.alias("stretch_offset"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(key, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frame.withColumn(name, inner).join(offsets, [key, stretch]).withColumn(name, F.col(name) + F.col("stretch_offset")).drop("stretch_offset")


def schedule(frame: DataFrame, shares: list[tuple[int, float]], n_slots: int) -> DataFrame:
    """(no, rank, slot): the slots of each source number in order, ranked from 0."""
    spark, total, running, bounds = frame.sparkSession, sum(t for _, t in shares), 0.0, []
    for _, t in shares:
        running += t
        bounds.append(running / total)
    bounds[-1] = 1.0
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    at = F.array(*[F.lit(b) for b in bounds])
    numbers = F.array(*[F.lit(no) for no, _ in shares])
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.get(numbers, F.size(F.filter(at, lambda b: b <= point))).alias("no"), F.shiftright("id", CHUNK_BITS).alias("stretch"))
    return _before(slots, "no", "stretch", ["slot"], F.lit(1), "rank").select("no", "rank", "slot")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows, segments). rows: every row with row id, size, source_size, target; segments: (slot, no, place, epoch, start, stop), the mix in slot order."""
    sized = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), token_count(F.col(text_column)).alias("size"))
    sized = kept(sized.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))), "sizes")
    totals = [(r.source, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    plan = [(no, s, n, t) for no, (s, n, t) in enumerate(targets(totals, weights, share, most))]
    drawn = [(no, t) for no, _, _, t in plan if t > 0]
    spark = docs.sparkSession
    sources = spark.createDataFrame([(no, s, n, t) for no, s, n, t in plan], "no int, source string, source_size long, target double")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("stretch", F.shiftright("h", 52))
    rows = kept(_before(rows, "no", "stretch", ["h", "doc_id", "size"], F.col("size"), "place"), "places")
    if not drawn:
        return rows, spark.createDataFrame([], "slot long, no int, place long, epoch int, start long, stop long")
    n_slots = max(len(drawn), round(sum(t for _, t in drawn) / block_tokens))
    slots = kept(schedule(docs, drawn, n_slots), "slots")
    per_source = {r.no: r.n for r in slots.groupBy("no").agg(F.count("*").alias("n")).collect()}
    for no, _ in drawn:                              # a source too small for the points: one slot at the end
        if no not in per_source:
            slots = slots.union(spark.createDataFrame([(no, 0, n_slots)], slots.schema))
            n_slots += 1
    blocks = spark.createDataFrame([(no, t / per_source.get(no, 1)) for no, t in drawn], "no int, tokens double")
    # a document's two places, one epoch after the other, meet the blocks they overlap
    placed = (rows.where("size > 0").join(blocks, "no").select("no", "place", "size", "source_size", "tokens", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
              .withColumn("low", F.col("place") + F.col("epoch") * F.col("source_size")))
    first, last = F.floor(F.col("low") / F.col("tokens")), F.floor((F.col("low") + F.col("size")) / F.col("tokens"))
    placed = placed.withColumn("rank", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last + 1)))
    cut = lambda k: F.floor(k * F.col("tokens"))
    start, stop = F.greatest("low", cut(F.col("rank"))), F.least(F.col("low") + F.col("size"), cut(F.col("rank") + 1))
    placed = placed.withColumn("start", start - F.col("low")).withColumn("stop", stop - F.col("low")).where("stop > start")
    return rows, placed.join(slots, ["no", "rank"]).select("slot", "no", "place", "epoch", "start", "stop")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken (tokens the mix takes from it, both epochs)."""
    rows, segments = mix(docs, **options)
    used = segments.groupBy("no", "place").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    some = rows.where("size > 0").join(used, ["no", "place"], "left")
    return some.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")).union(
        rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long")))
