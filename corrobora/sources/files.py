"""Uploaded files: reading, validation, decoding, content hashes, duplicates, manifests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx

# Windows-1252 differs from Latin-1 only in 0x80-0x9F; five of those bytes are undefined.
_C1 = [(chr(b), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0)]
_CP1252_FROM, _CP1252_TO = ("".join(p) for p in zip(*[c for c in _C1 if c[1]]))
_CP1252_UNDEFINED = "[" + "".join(c for c, mapped in _C1 if not mapped) + "]"


def read_uploads(spark: SparkSession, path: str, max_bytes: int = fixed.MAX_FILE_MB * 1024 * 1024, glob: str = "*", manifest: DataFrame | None = None) -> DataFrame:
    """path, name, size, arrived, content. The content of an oversized file is not read.

    The file reader does not list files of zero bytes; those that a manifest (name, size) announces are added with empty content, so that they can be
    rejected by name. Announced files of another size that are missing are added with NULL content.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))
    small = files.filter(F.col("length") <= max_bytes)
    large = files.filter(F.col("length") > max_bytes).select("path", "modificationTime", "length").withColumn(
        "content", F.lit(None).cast("binary"))
    found = small.unionByName(large).select(
        "path", tx.base_name(F.col("path")).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("arrived"), "content")
    if manifest is None:
        return found
    unseen = manifest.select("name", F.col("size").cast("bigint").alias("size")).join(found.select("name"), "name", "left_anti")
    return found.unionByName(unseen.withColumn("content", F.when(F.col("size") == 0, F.lit(b""))), allowMissingColumns=True)


def file_type(name: Column) -> Column:
    ext = tx.extension(name)
    return F.when(ext == "jpeg", "jpg").otherwise(ext)


def decode_text(content: Column) -> Column:
    """UTF-8, else Windows-1252; NULL when the bytes hold NUL or cannot be decoded."""
    latin = F.decode(content, "ISO-8859-1")
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).when(
        ~latin.rlike(_CP1252_UNDEFINED), F.translate(latin, _CP1252_FROM, _CP1252_TO))
    return F.when(~latin.contains("\x00"), text)


def reject_reason(name: Column, content: Column, size: Column, max_bytes: int = fixed.MAX_FILE_MB * 1024 * 1024) -> Column:
    """First failing check, or NULL: extension, empty, too large, signature."""
    ext = file_type(name)
    head = F.hex(F.substring(content, 1, 4))
    signature = F.when(ext == "txt", decode_text(content).isNotNull()).otherwise(F.lit(False))
    for kind, magic in fixed.SIGNATURES.items():
        signature = F.when(ext == kind, F.startswith(head, F.lit(magic))).otherwise(signature)
    return (F.when(~tx.extension(name).isin(*fixed.EXTENSIONS), fixed.REJECT_TYPE).when(size == 0, fixed.REJECT_EMPTY)
            .when(size > max_bytes, fixed.REJECT_LARGE).when(~F.coalesce(signature, F.lit(False)), fixed.REJECT_SIGNATURE))


def validate(uploads: DataFrame, max_bytes: int = fixed.MAX_FILE_MB * 1024 * 1024) -> DataFrame:
    """Adds ext, sha256 and reject_reason; rows with a reason are the rejected files."""
    return uploads.withColumns({
        "ext": file_type(F.col("name")), "sha256": F.sha2("content", 256),
        "reject_reason": reject_reason(F.col("name"), F.col("content"), F.col("size"), max_bytes)})


def mark_duplicates(files: DataFrame, scope: str, sha: str, order: str, path: str, stored: DataFrame | None = None) -> DataFrame:
    """status queued / duplicate / failed and the path whose bytes are kept, per scope.

    The first copy is found by a map-side combined minimum, so a group holding most of the rows shrinks before the
    shuffle; the join back carries only keys and is split by adaptive skew handling. `stored` holds originals of
    earlier loads (scope, sha, path) and wins over every new copy.
    """
    usable = F.col("status") != "failed"
    first = files.filter(usable).groupBy(scope, sha).agg(F.min_by(F.struct(order, path), F.col(order)).alias("first"))
    joined = files.join(first, [scope, sha], "left")
    known = F.lit(None).cast("string")
    if stored is not None:
        joined = joined.join(stored.select(scope, sha, F.col(path).alias("known_path")), [scope, sha], "left")
        known = F.col("known_path")
    duplicate = usable & (known.isNotNull() | (F.col(order) > F.col(f"first.{order}")))
    marked = joined.withColumns({
        "status": F.when(duplicate, "duplicate").otherwise(F.col("status")),
        "stored_path": F.when(duplicate, F.coalesce(known, F.col(f"first.{path}"))).otherwise(F.col(path))})
    return marked.drop("first", "known_path")


def match_manifest(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest corpus per title whose hashes equal the wanted ones, copies counted, without failed documents.

    Hash lists are compared as counts per hash, so no list is ever collected.
    documents: title, corpus, created, sha, status; wanted: title, sha (one row per file).
    """
    want = wanted.groupBy("title", "sha").agg(F.count(F.lit(1)).alias("copies"))
    want_total = want.groupBy("title").agg(F.count(F.lit(1)).alias("hashes"))
    have = documents.groupBy("title", "corpus", "sha").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.col("status") == "failed").alias("failed"), F.max("created").alias("created"))
    matched = have.join(want.withColumn("wanted", F.lit(True)), ["title", "sha", "copies"], "left")
    corpora = matched.groupBy("title", "corpus").agg(
        F.max("created").alias("created"), F.max("failed").alias("failed"), F.count(F.lit(1)).alias("own"),
        F.count("wanted").alias("same"))
    equal = corpora.join(want_total, "title").filter("NOT failed AND own = hashes AND same = hashes")
    return equal.groupBy("title").agg(F.max_by("corpus", F.struct("created", "corpus")).alias("corpus"))
