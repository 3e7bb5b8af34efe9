"""Content-addressed files: scan, stage, promote, enumerate, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import keys



def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, byte_size, checksum, modified) of every file under a folder, read once by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("checksum"), F.col("modificationTime").alias("modified"))


def enumerate_keys(spark: SparkSession, root: str) -> DataFrame:
    """(key, modified, byte_size) under a root; file contents are not read (the column is pruned)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cut = F.length(F.lit(root.rstrip("/"))) + 2
    path = F.regexp_replace("path", "^[a-z]+:(//)?", "")
    return files.select(F.substr(path, cut).alias("key"), F.col("modificationTime").alias("modified"), F.col("length").alias("byte_size"))


def promote(staged: DataFrame, existing: DataFrame) -> DataFrame:
    """staged(checksum, content_type, ..) with its ``key`` and ``was_written``: false where the key already exists.

    Equal content staged twice is written once: the first row by path.
    """
    keyed = staged.withColumn("key", keys.original_key(F.col("checksum"), F.col("content_type")))
    first = keyed.groupBy("key").agg(F.min("path").alias("first_path"))
    known = existing.select("key", F.lit(True).alias("there")).distinct()
    return keyed.join(first, "key").join(known, "key", "left").withColumn("was_written", F.col("there").isNull() & (F.col("path") == F.col("first_path"))).drop("there", "first_path")


def safe_key(key: Column) -> Column:
    """S3: whether a key stays below its root: relative, without empty, '.' or '..' parts."""
    return F.coalesce(~key.rlike(r"^/|\\|(^|/)(\.{1,2})?(/|$)"), F.lit(False))


def sweep(stored: DataFrame, known: DataFrame, now: Column, min_age_seconds: int) -> DataFrame:
    """Stored keys that nothing knows and that are older than the floor."""
    old = stored.where(now.cast("timestamp") - F.make_dt_interval(secs=F.lit(float(min_age_seconds))) > F.col("modified"))
    return old.join(known.select("key").distinct(), "key", "left_anti")


# First bytes of the accepted image formats.
MAGIC = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/webp": "52494646", "image/tiff": "49492A00"}


def probe(content: Column) -> Column:
    """struct(content_type, width, height) from the header bytes; sizes for PNG, null where unknown."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.coalesce(*[F.when(F.startswith(head, F.lit(magic)) & ((F.lit(t) != "image/webp") | F.endswith(head, F.lit("57454250"))), F.lit(t)) for t, magic in MAGIC.items()])
    number = lambda at: F.when(kind == "image/png", F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))
    return F.struct(kind.alias("content_type"), number(17).alias("width"), number(21).alias("height"))


def serve(assets: DataFrame, derivatives: DataFrame, purpose: str) -> DataFrame:
    """Per asset the key to serve for a purpose, its ETag and status: 200, 404 never made, 410 purged."""
    last = derivatives.where(F.col("purpose") == purpose).groupBy("asset_id").agg(F.max_by(F.struct("storage_key", "checksum"), "id").alias("d"))
    rows = assets.select("asset_id", "storage_key", "checksum", "bytes_state").join(last, "asset_id", "left")
    key = F.when(F.lit(purpose) == "original", F.col("storage_key")).otherwise(F.col("d.storage_key"))
    tag = F.when(F.lit(purpose) == "original", F.col("checksum")).otherwise(F.col("d.checksum"))
    status = F.when(key.isNull(), 404).when(F.col("bytes_state") == "purged", 410).when(F.col("bytes_state") != "present", 404).otherwise(200)
    return rows.select("asset_id", F.when(status == 200, key).alias("key"), F.when(status == 200, F.concat(F.lit('"'), tag, F.lit('"'))).alias("etag"), status.alias("status"))
