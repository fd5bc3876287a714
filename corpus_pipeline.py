"""A corpus made ready for training: toxic documents go, repeated lines and near-duplicates go, contaminated documents go, sources are mixed to weights.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Nulls, empty tables, repeated rows and further columns are
handled as the operators' docstrings state; rows with a null doc_id cannot be told apart, so only the toxicity stage removes them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import decontamination, lines, mixing, near_duplicates, toxicity
from corrobora.llm.runtime import free_name, kept, prepare


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents whose id is not in the column `id`; planned alike however few ids there are."""
    key = free_name(docs, "other_id")
    return docs.join(ids.toDF(key).hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labelled rows that are not held out."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line only in the first document that has it; n_chars is the new length. Documents that lose all their lines go, as exact copies do; those
    that had none stay."""
    prepare(spark)
    out, removed = lines.deduplicated(docs), free_name(docs, "removed")
    rest = out.where(F.col(removed).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rest.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of rows that share an id one stays."""
    prepare(spark)
    found = kept(near_duplicates.components(docs).where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n")), "found")
    rest = _without(docs, found.where("id <> component").select("id"))
    key = free_name(docs, "repeated_id")
    repeated = found.where("id = component AND n > 1").select(F.col("id").alias(key))
    if repeated.isEmpty():
        return rest
    return _without(rest, repeated).union(rest.join(repeated, F.col("doc_id").cast("long") == F.col(key), "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item (or a whole shorter item)."""
    prepare(spark)
    found = decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, kept(found.select(F.col("doc").alias("id")).distinct(), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes."""
    prepare(spark)
    return mixing.taken(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("MinHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_contaminated),
          ("mixing sources", mix_sources)]

#: a trained score, fuzzy groups and a schedule are not SQL; tests/llm compares the stages with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each one's rows written as Parquet in the shared folder and read again as the next one's documents."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
