"""Stored tables: partitioned writes, result JSON, and a shared folder for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(frame: DataFrame, path: str, scope: str, mode: str = "append") -> None:
    """Parquet partitioned by scope; a failed job commits nothing. `overwrite` replaces only the scopes in the frame.

    Rows are brought together by scope first, in pieces of even size (a large scope gets several), so files are few and of useful size.
    """
    writer = frame.hint("rebalance", scope).write.mode(mode).partitionBy(scope)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def stored(frame: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    writer = frame.write
    if scope:
        writer = writer.partitionBy(scope)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove(*frames: DataFrame) -> None:
    """Delete the folders of intermediate tables that `stored` wrote and that nothing reads any more."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def to_result_json(frame: DataFrame, columns: list[str], out: str = "result_json") -> DataFrame:
    return frame.withColumn(out, F.to_json(F.struct(*columns)))


def from_result_json(frame: DataFrame, schema: str, source: str = "result_json", out: str = "result") -> DataFrame:
    return frame.withColumn(out, F.from_json(source, schema))
