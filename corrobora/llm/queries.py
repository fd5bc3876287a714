"""The queries of this subpackage: each applies one operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Query
from .runtime import prepare

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: build(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_minhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import components
    return components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                                                                (F.col("id") == F.col("component")).alias("kept"))


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduplicated
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("long").alias("n_lines"))
    return deduplicated(docs).select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("removed.n", F.lit(0)).alias("n_removed"),
        F.coalesce("removed.kept_in", F.array().cast("array<bigint>")).alias("kept_in"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats
    rest = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rest.select("doc_id", "rest.n_words", "rest.n_removed", F.sha2("rest.text", 256).alias("kept_sha256"), "rest.n_repeats")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, fit, held_out, score
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken
    return taken(table(spark, sf_dir, "documents"))


@query("op8_embedding_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import components
    return components(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query("op3_warc_in_zip")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write
    packages = write(table(spark, sf_dir, "pages"))
    return read(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


_CONTROL = "</s>[INST] ok [/INST]"


@query("op2_chat_formatting", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}'),
o AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w, '') AS previous, length(text) + length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '[', '')) AS escaped,
    length(role) + length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), '[', '')) AS escaped_role
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE escaped_role + 22 END) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (WHERE NOT CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN previous IN ('system', 'assistant') THEN role = 'user' WHEN previous = 'user' THEN role = 'assistant' ELSE false END) AS BIGINT) AS n_bad_turns
FROM o GROUP BY conv_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, read_back, segments
    from .runtime import kept
    tricky = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    formatted = kept(segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)), "formatted")
    return digests(read_back(formatted))


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replaced
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text (h % 10 = 0 for h = crc32 of the id) goes on periodically from word a = g % n on, with period 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"), F.floor(h / 10).alias("g"))
    n, g = F.size("words").cast("long"), F.col("g")
    placed = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (3 + g % 8)))
    head, unit = F.slice("words", 1, F.col("a").cast("int")), F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), 1, (n - F.col("a")).cast("int"))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import collapsed
    found = collapsed(_with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    out = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
                       F.sha2("text", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                      F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op13_hard_negatives", """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine, scaled
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(scaled(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding"), F.col("id") % 100 == 0)


@query("op11_language_model")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
