"""Incremental forms: ingest, duplicates, latest status, stage metrics. Each result equals the batch form on the same rows."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import documents as docs
from ..sources import files
from ..sources.tables import shared_folder


def ingest(arriving: DataFrame, keep: list[str], path: str, checkpoint: str):
    """Documents with raw paragraphs -> passages, appended exactly once. The work is narrow, so no state is kept."""
    return (docs.passages(arriving, keep).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _tables(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """Rows of the batches before this one (a repeated batch does not see itself)."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < batch_id)


def mark_duplicates(arriving: DataFrame, path: str, checkpoint: str, scope: str = "scope", sha: str = "sha256", order: str = "doc_id", name: str = "path"):
    """Marks files whose hash was seen in the scope, in this batch or any earlier one.

    Each batch overwrites its own folder, so a repeated batch leaves the same table.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = None
        if batch_id > 0:
            schema = batch.select(scope, sha, name, "status").schema.add("batch", T.IntegerType())
            stored = _tables(spark, path, batch_id, schema).filter("status = 'queued'").select(scope, sha, name)
        marked = files.mark_duplicates(batch, scope, sha, order, name, stored)
        marked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Originals(StatefulProcessor):
    """State of one (scope, hash): the path of its first file that did not fail."""

    def __init__(self, order: str, name: str):
        self.order, self.name = order, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", T.StructType([T.StructField("path", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # copies of one file in one micro-batch; how many files that takes is set by the source
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        usable = arrived["status"] != "failed"
        known = self.first.get()[0] if self.first.exists() else None
        repeated = usable if known is not None else usable & (usable.cumsum() > 1)
        if known is None and usable.any():
            known = arrived.loc[usable, self.name].iloc[0]
            self.first.update((known,))
        arrived["stored_path"] = arrived[self.name].where(~repeated, known)
        arrived["status"] = arrived["status"].where(~repeated, "duplicate")
        yield arrived

    def close(self) -> None:
        pass


def keyed_duplicates(arriving: DataFrame, path: str, checkpoint: str, scope: str = "scope", sha: str = "sha256", order: str = "doc_id", name: str = "path"):
    """As mark_duplicates, with the originals in keyed state instead of stored batches: a batch looks up the hashes that arrive with it and nothing else.

    The state is in the state store of the checkpoint (RocksDB), so a restart goes on where it ended."""
    spark = arriving.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = T.StructType([*arriving.schema.fields, T.StructField("stored_path", T.StringType())])
    marked = arriving.groupBy(scope, sha).transformWithStateInPandas(statefulProcessor=_Originals(order, name), outputStructType=schema, outputMode="Append", timeMode="None")
    return marked.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def bounded_duplicates(arriving: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """First copies only, with state that expires: copies further apart than the delay are not recognised."""
    return arriving.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


COMPACT_EVERY = 10       # batches after which the change log becomes a snapshot


def changed_groups(aggregated: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, every: int = COMPACT_EVERY):
    """Changed groups of every batch, in one folder per batch; with `keys`, every so many batches they are merged with the last snapshot into a new one.

    A batch and a snapshot overwrite folders of their own numbers, so a repeated batch leaves the same table."""
    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keys and (batch_id + 1) % every == 0:
            values = [c for c in batch.columns if c not in keys]
            newest = _versions(batch.sparkSession, path, batch_id).groupBy(*keys).agg(F.max_by(F.struct(*values, "batch"), F.col("batch")).alias("v"))
            newest.select(*keys, "v.*").withColumnRenamed("batch", "version").write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")
    return aggregated.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders kind=number; folders that were not written to their end have no mark and do not count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getParent().getName() for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")) or []]
    return sorted(int(n.split("=")[1]) for n in names)


def _versions(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """Versions of groups with the batch that made them: the last snapshot and the batches after it, up to a batch; so reading does not grow with the number of batches."""
    up_to = lambda numbers: [n for n in numbers if until is None or n <= until]
    # a snapshot of this very batch may be there from a first try
    snapshots = [n for n in up_to(_numbers(spark, path, "snapshot")) if until is None or n < until]
    last = snapshots[-1] if snapshots else -1
    batches = [n for n in up_to(_numbers(spark, path, "batch")) if n > last]
    parts = [spark.read.parquet(f"{path}/batch={n}").withColumn("batch", F.lit(n)) for n in batches]
    if last >= 0:
        parts.append(spark.read.parquet(f"{path}/snapshot={last}").withColumnRenamed("version", "batch"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def current_groups(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """The newest version of every group: a version of an earlier batch never replaces one of a later batch."""
    return _versions(spark, path).groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v")).select(*keys, "v.*")


def latest_status(changes: DataFrame, key: str, status: str, order: Column) -> DataFrame:
    return changes.groupBy(key).agg(F.max_by(status, order).alias("status"))


def split_late(lines: DataFrame, path: str, checkpoint: str, time: str = "ts", delay: str = "10 minutes"):
    """Writes every line with `late`: whether its time is before the watermark, the largest time of all earlier batches less the delay.

    The largest time of each batch is kept beside the lines, in one folder per batch, so a repeated batch decides alike. The lines that are not late can be
    summed by window without loss, and lines in = lines summed + lines reported late."""
    span = F.expr(f"INTERVAL {delay}")

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id > 0:
            mark = spark.read.parquet(f"{path}/marks/batch={batch_id - 1}").first()["mark"]
        highest = batch.agg(F.max(time).alias("m")).first()["m"]
        marks = [m for m in (mark, highest) if m is not None]
        late = F.lit(False) if mark is None else F.coalesce(F.col(time) < F.lit(mark) - span, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/lines/batch={batch_id}")
        spark.createDataFrame([(max(marks) if marks else None,)], "mark timestamp").write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_metrics(lines: DataFrame, time: str = "ts", delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Lines and values per stage and tumbling window; lines later than the delay are dropped (split_late reports them)."""
    return lines.withWatermark(time, delay).groupBy(F.window(time, size), "stage").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("highest")).select(
            F.col("window.start").alias("window_start"), "stage", "lines", "total", "highest")


def run(start, spark: SparkSession, name: str) -> str:
    """Start a query on fresh shared folders, wait for its available input, return the output folder."""
    base = shared_folder(spark, name)
    query = start(f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return f"{base}/out"
