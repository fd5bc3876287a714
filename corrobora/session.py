"""Session settings: adaptive execution, skew handling, UTC time."""

import os

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a window or grouping on (run, aspect) can reuse rows already placed by run
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # the JVM interprets generated methods above this size; a stage that needs one runs operator by operator, with small methods that are compiled
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # the filter that Spark infers from an explode (array not empty) is pushed below the projection that builds the array, which then builds it twice
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # batches of long texts in Python workers: a quarter of Spark's own bound of 64 MB
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def local_session(name: str = "corrobora", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that somebody else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
