"""Session settings and intermediate tables shared by the operators of this subpackage."""

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.tables import remove, stored

SETTINGS = {
    # texts may be long: keep one Arrow batch of them small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # an intermediate table is written in full before it is read, so the shuffle files behind it can go
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def kept(frame: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that no later job repeats the work or depends on an executor's disk."""
    return stored(frame, name)


def discard(*frames: DataFrame) -> None:
    """Remove tables that `kept` wrote, once everything that reads them has been written itself."""
    remove(*frames)


def compact(frame: DataFrame) -> DataFrame:
    """For tables much smaller than the corpus (keys, pairs, edges): a quarter of the usual tasks, and so of the files, after a shuffle."""
    return frame.coalesce(max(4, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def free_name(frame: DataFrame, name: str) -> str:
    """`name`, with underscores added while the table already has such a column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
