"""Batches, items, assets: roll-ups, deduplication, queues, resume plans, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.functions import geometry, keys
from pressmill.functions import text as tx
from pressmill.io import table
from pressmill.operators import records
from pressmill.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

# Item states of the queue and of a running pipeline, and the seven keys of a batch's counts.
WAITING, RUNNING = ("uploaded",), ("preprocessing", "ocr_processing", "llm_processing")
COUNT_KEYS = {
    "queued": WAITING, "processing": RUNNING, "awaiting_review": ("awaiting_review",), "no_ads": ("no_ads",),
    "needs_attention": ("needs_attention",), "failed": ("failed",), "completed": ("completed",),
}
STAGES = {
    "uploaded": "queue", "preprocessing": "preprocess", "ocr_processing": "ocr", "llm_processing": "llm", "awaiting_review": "review",
    "no_ads": "done", "needs_attention": "done", "failed": "done", "completed": "done",
}


def items_now(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest state of every item (rows are delivered again in later loads)."""
    wanted = dict.fromkeys(("id", "ingested_at", "load_id", *columns))
    return records.latest(table(spark, sf_dir, "ingestion_items").select(*wanted), ["id"], ["ingested_at", "load_id"])


ITEMS = "items AS (SELECT * FROM ingestion_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, load_id DESC NULLS LAST) = 1)"


@R.add("w10_latest_items", f"WITH {ITEMS} SELECT id, status, load_id, attempt_count FROM items")
def latest_items(spark, sf_dir):
    return items_now(spark, sf_dir, "status", "attempt_count").select("id", "status", "load_id", "attempt_count")


@R.add("a1_status_counts", f"WITH {ITEMS} SELECT batch_id, status, count(*) AS n FROM items GROUP BY ALL")
def status_counts(spark, sf_dir):
    return items_now(spark, sf_dir, "batch_id", "status").groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("n"))


def count_columns() -> list:
    return [F.count_if(F.col("status").isin(*states)).alias(f"n_{k}") for k, states in COUNT_KEYS.items()]


COUNTS_SQL = ", ".join(f"count(*) FILTER (status IN ({', '.join(repr(s) for s in states)})) AS n_{k}" for k, states in COUNT_KEYS.items())


@R.add("a2_batch_counts", f"WITH {ITEMS} SELECT batch_id, {COUNTS_SQL} FROM items GROUP BY batch_id")
def batch_counts(spark, sf_dir):
    return items_now(spark, sf_dir, "batch_id", "status").groupBy("batch_id").agg(*count_columns())


_DERIVED = """CASE WHEN n IS NULL OR n = 0 THEN 'queued' WHEN n_queued = n THEN 'queued' WHEN n_queued + n_processing > 0 THEN 'processing'
 WHEN n_failed = n THEN 'failed' WHEN n_failed > 0 THEN 'partial_failed' ELSE 'completed' END"""


@R.add(
    "a3_batch_rollup",
    f"""WITH {ITEMS}, c AS (SELECT batch_id, count(*) AS n, {COUNTS_SQL}, max(epoch_us(updated_at)) AS last FROM items GROUP BY batch_id),
b AS (SELECT DISTINCT id, status AS cached_status, total_items FROM ingestion_batches),
d AS (SELECT b.*, coalesce(c.n, 0) AS n_items, {_DERIVED} AS derived_status, c.last FROM b LEFT JOIN c ON c.batch_id = b.id)
SELECT id, cached_status, derived_status, cached_status IS DISTINCT FROM derived_status AS is_stale, total_items, n_items,
 CASE WHEN derived_status IN ('completed', 'failed', 'partial_failed') THEN last END AS completed_us FROM d""",
)
def batch_rollup(spark, sf_dir):
    """The status of every batch derived from its items, beside the cached one."""
    counts = items_now(spark, sf_dir, "batch_id", "status", "updated_at").groupBy(F.col("batch_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), *count_columns(), F.max(F.unix_micros("updated_at")).alias("last"))
    batches = table(spark, sf_dir, "ingestion_batches").select("id", F.col("status").alias("cached_status"), "total_items").distinct()
    joined = batches.join(counts, "id", "left").withColumn("derived_status", F.expr(_DERIVED))
    done = F.col("derived_status").isin("completed", "failed", "partial_failed")
    return joined.select("id", "cached_status", "derived_status", (~F.col("cached_status").eqNullSafe(F.col("derived_status"))).alias("is_stale"), "total_items", F.coalesce("n", F.lit(0)).alias("n_items"), F.when(done, F.col("last")).alias("completed_us"))


_STAGE_SQL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + " END"


@R.add("view1_item", f"WITH {ITEMS} SELECT id, batch_id, status, {_STAGE_SQL} AS derived_stage, stage IS DISTINCT FROM {_STAGE_SQL} AS stage_differs, len(coalesce(warning_codes, [])) AS n_warnings FROM items")
def item_view(spark, sf_dir):
    """Items with the stage their status implies."""
    stage = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STAGES.items()])
    rows = items_now(spark, sf_dir, "batch_id", "status", "stage", "warning_codes")
    return rows.select("id", "batch_id", "status", stage.alias("derived_stage"), (~F.col("stage").eqNullSafe(stage)).alias("stage_differs"), F.size(F.coalesce("warning_codes", F.array().cast("array<string>"))).alias("n_warnings"))


@R.add("view8_wire_counts", f"WITH {ITEMS} SELECT CASE WHEN status = 'uploaded' THEN 'queued' WHEN status IN ('preprocessing', 'ocr_processing', 'llm_processing') THEN 'running' ELSE status END AS wire_status, count(*) AS n FROM items GROUP BY ALL")
def wire_counts(spark, sf_dir):
    """States renamed for the outside, then summed where names meet; counts first, so the rename sees few rows."""
    counted = items_now(spark, sf_dir, "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("status").isin(*WAITING), "queued").when(F.col("status").isin(*RUNNING), "running").otherwise(F.col("status"))
    return counted.groupBy(name.alias("wire_status")).agg(F.sum("n").alias("n"))


@R.add(
    "view9_batch_snapshot",
    f"""WITH {ITEMS} SELECT batch_id, count(*) AS n_items, sha256(string_agg(concat(item_index, ':', id, ':', coalesce(status, '')), ',' ORDER BY item_index, id)) AS digest
FROM items WHERE batch_id IS NOT NULL GROUP BY batch_id""",
)
def batch_snapshot(spark, sf_dir):
    """The ordered content of every batch as one digest, however long the batch."""
    rows = items_now(spark, sf_dir, "batch_id", "item_index", "status").where("batch_id is not null")
    line = F.concat(F.coalesce(F.col("item_index").cast("string"), F.lit("")), F.lit(":"), "id", F.lit(":"), F.coalesce("status", F.lit("")))
    return records.ordered_digests(rows, "batch_id", [F.col("item_index"), F.col("id")], line, ",").withColumnRenamed("n_rows", "n_items")


@R.add("a6_asset_dedupe", "SELECT checksum_sha256 AS checksum, min_by(id, (created_at, id)) AS winner, count(*) AS n_rows, count(*) > 1 AS reused FROM media_assets GROUP BY checksum_sha256")
def asset_dedupe(spark, sf_dir):
    """Content-addressed assets, first writer wins."""
    rows = table(spark, sf_dir, "media_assets")
    return rows.groupBy(F.col("checksum_sha256").alias("checksum")).agg(F.min_by("id", F.struct("created_at", "id")).alias("winner"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) > 1).alias("reused"))


@R.add(
    "a7_next_attempts",
    f"""WITH {ITEMS} SELECT i.id, i.pipeline_generation AS generation, coalesce(max(i.attempt_count), 0) + 1 AS next_attempt, count(DISTINCT o.id) AS n_ocr
FROM items i LEFT JOIN ocr_pages o ON o.item_id = i.id GROUP BY i.id, i.pipeline_generation""",
)
def next_attempts(spark, sf_dir):
    """The next attempt number of every item and generation, with its captured pages."""
    pages = table(spark, sf_dir, "ocr_pages").groupBy(F.col("item_id").alias("id")).agg(F.countDistinct(F.col("id")).alias("n_ocr"))
    rows = items_now(spark, sf_dir, "pipeline_generation", "attempt_count")
    return rows.join(pages, "id", "left").select("id", F.col("pipeline_generation").alias("generation"), (F.coalesce("attempt_count", F.lit(0)) + 1).alias("next_attempt"), F.coalesce("n_ocr", F.lit(0)).alias("n_ocr"))


@R.add("a9_claimable", f"WITH {ITEMS} SELECT count(*) AS n_claimable, count(*) FILTER (attempt_count = 0) AS n_fresh FROM items WHERE status = 'uploaded'")
def claimable(spark, sf_dir):
    """What the queue holds."""
    waiting = items_now(spark, sf_dir, "status", "attempt_count").where(F.col("status").isin(*WAITING))
    return waiting.agg(F.count(F.lit(1)).alias("n_claimable"), F.count_if(F.col("attempt_count") == 0).alias("n_fresh"))


@R.add(
    "w6_expired_leases",
    f"""WITH {ITEMS}, now AS (SELECT max(epoch_us(updated_at)) AS t FROM ingestion_items)
SELECT id, status, (now.t - epoch_us(updated_at)) // 1000000 AS idle_s, attempt_count >= 3 AS give_up FROM items, now
WHERE status IN ('preprocessing', 'ocr_processing', 'llm_processing') AND now.t - epoch_us(updated_at) > 300 * 1000000""",
)
def expired_leases(spark, sf_dir):
    """Running items idle for longer than the lease (300 s), as of the newest change in the table."""
    rows = items_now(spark, sf_dir, "status", "updated_at", "attempt_count").where(F.col("status").isin(*RUNNING)).withColumn("one", F.lit(1))
    now = table(spark, sf_dir, "ingestion_items").agg(F.max(F.unix_micros("updated_at")).alias("now")).withColumn("one", F.lit(1))
    idle = F.col("now") - F.unix_micros("updated_at")
    late = rows.join(now, "one").where(idle > 300 * 1_000_000)
    return late.select("id", "status", F.expr("(now - unix_micros(updated_at)) div 1000000").alias("idle_s"), (F.col("attempt_count") >= 3).alias("give_up"))


@R.add(
    "n10_oldest_claimable",
    f"""WITH {ITEMS}, q AS (SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) AS slot FROM items WHERE status = 'uploaded')
SELECT batch_id, id, slot FROM q WHERE slot <= 2""",
)
def oldest_claimable(spark, sf_dir):
    """The two oldest waiting items of every batch (a worker's slots); row_number is pre-limited per task by Spark's WindowGroupLimit."""
    rows = items_now(spark, sf_dir, "batch_id", "status", "created_at").where(F.col("status").isin(*WAITING))
    w = Window.partitionBy("batch_id").orderBy("created_at", "id")
    return rows.withColumn("slot", F.row_number().over(w)).where("slot <= 2").select("batch_id", "id", F.col("slot").cast("bigint").alias("slot"))


@R.add("g7_backoff", f"WITH {ITEMS} SELECT id, attempt_count, least(2.0 * pow(2.0, attempt_count - 1), 60.0) AS item_wait, least(1.0 * pow(2.0, attempt_count - 1), 20.0) AS call_wait FROM items WHERE attempt_count >= 1")
def backoff(spark, sf_dir):
    rows = items_now(spark, sf_dir, "attempt_count").where("attempt_count >= 1")
    return rows.select("id", "attempt_count", geometry.backoff(F.col("attempt_count")).alias("item_wait"), geometry.backoff(F.col("attempt_count"), 1.0, 20.0).alias("call_wait"))


@R.add("l2_recent_batches", "SELECT id, kind, total_items FROM (SELECT DISTINCT id, kind, total_items FROM ingestion_batches) ORDER BY id DESC LIMIT 25 OFFSET 25")
def recent_batches(spark, sf_dir):
    """L2: the second page of batches, newest id first."""
    return table(spark, sf_dir, "ingestion_batches").select("id", "kind", "total_items").distinct().orderBy(F.desc("id")).offset(25).limit(25)


@R.add("l3_items_in_order", f"WITH {ITEMS} SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY item_index ASC NULLS LAST, id) AS place, id FROM items WHERE batch_id IS NOT NULL")
def items_in_order(spark, sf_dir):
    """L3: the place of every item in its batch, import batches included, numbered in range pieces."""
    rows = items_now(spark, sf_dir, "batch_id", "item_index").where("batch_id is not null").select("batch_id", "item_index", "id")
    return records.numbered(rows, "batch_id", ["item_index", "id"]).select("batch_id", "place", "id")


@R.add(
    "a15_fingerprints",
    f"""WITH {ITEMS}, k AS (SELECT i.batch_id, a.checksum_sha256 AS c FROM items i JOIN media_assets a ON a.id = i.source_asset_id)
SELECT b.id AS batch_id, sha256(concat_ws('|', b.created_by, count(*)::varchar, string_agg(k.c, '|' ORDER BY k.c))) AS fingerprint
FROM (SELECT DISTINCT id, created_by FROM ingestion_batches) b JOIN k ON k.batch_id = b.id GROUP BY b.id, b.created_by""",
)
def fingerprints(spark, sf_dir):
    """The request fingerprint of every batch, however long."""
    assets = table(spark, sf_dir, "media_assets").select(F.col("id").alias("source_asset_id"), F.col("checksum_sha256").alias("c"))
    sums = items_now(spark, sf_dir, "batch_id", "source_asset_id").join(assets, "source_asset_id").select("batch_id", "c")
    owners = table(spark, sf_dir, "ingestion_batches").select(F.col("id").alias("batch_id"), "created_by").distinct()
    heads = owners.join(sums.groupBy("batch_id").count(), "batch_id").select("batch_id", F.concat_ws("|", "created_by", F.col("count").cast("string")).alias("head"))
    rows = sums.join(heads, "batch_id")
    return records.ordered_digests(rows, "batch_id", [F.col("c")], F.col("c"), "|", F.col("head")).select("batch_id", F.col("digest").alias("fingerprint"))


@R.add("a19_batch_bytes", f"WITH {ITEMS} SELECT i.batch_id, count(*) AS n_files, sum(a.byte_size)::bigint AS total_bytes, sum(a.byte_size) > 104857600 AS too_large, bool_or(a.byte_size > 10485760) AS has_large FROM items i JOIN media_assets a ON a.id = i.source_asset_id GROUP BY i.batch_id")
def batch_bytes(spark, sf_dir):
    """Upload sizes against the caps of 10 MiB a file and 100 MiB a set."""
    assets = table(spark, sf_dir, "media_assets").select(F.col("id").alias("source_asset_id"), "byte_size")
    rows = items_now(spark, sf_dir, "batch_id", "source_asset_id").join(assets, "source_asset_id")
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("byte_size").alias("total_bytes"), (F.sum("byte_size") > 104857600).alias("too_large"), F.bool_or(F.col("byte_size") > 10485760).alias("has_large"))


@R.add(
    "s15_upload_problems",
    """SELECT id, CASE WHEN byte_size IS NULL OR byte_size <= 0 THEN 'EMPTY_FILE' WHEN byte_size > 10485760 THEN 'FILE_TOO_LARGE'
 WHEN content_type NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'UNSUPPORTED_TYPE' WHEN width IS NULL OR height IS NULL THEN 'UNREADABLE_SIZE'
 WHEN width::bigint * height > 40000000 THEN 'TOO_MANY_PIXELS' WHEN image_format IS NOT NULL AND lower(image_format) <> split_part(content_type, '/', 2) THEN 'TYPE_MISMATCH' END AS problem
FROM media_assets""",
)
def upload_problems(spark, sf_dir):
    """The first problem of every file, null when it is acceptable."""
    a = table(spark, sf_dir, "media_assets")
    kind = F.split_part("content_type", F.lit("/"), F.lit(2))
    problem = (
        F.when(F.col("byte_size").isNull() | (F.col("byte_size") <= 0), "EMPTY_FILE").when(F.col("byte_size") > 10485760, "FILE_TOO_LARGE")
        .when(~F.col("content_type").isin("image/jpeg", "image/png", "image/webp"), "UNSUPPORTED_TYPE").when(F.col("width").isNull() | F.col("height").isNull(), "UNREADABLE_SIZE")
        .when(F.col("width").cast("bigint") * F.col("height") > 40_000_000, "TOO_MANY_PIXELS").when(F.col("image_format").isNotNull() & (F.lower("image_format") != kind), "TYPE_MISMATCH")
    )
    return a.select("id", problem.alias("problem"))


@R.add(
    "n5_repeats_in_batch",
    f"""WITH {ITEMS}, k AS (SELECT i.batch_id, i.id, i.item_index, a.checksum_sha256 AS c FROM items i JOIN media_assets a ON a.id = i.source_asset_id)
SELECT batch_id, id, first_value(id) OVER w AS first_id, first_value(id) OVER w <> id AS is_repeat FROM k WINDOW w AS (PARTITION BY batch_id, c ORDER BY item_index, id)""",
)
def repeats_in_batch(spark, sf_dir):
    assets = table(spark, sf_dir, "media_assets").select(F.col("id").alias("source_asset_id"), F.col("checksum_sha256").alias("c"))
    rows = items_now(spark, sf_dir, "batch_id", "item_index", "source_asset_id").join(assets, "source_asset_id").where("batch_id is not null")
    return records.mark_repeats(rows, ["batch_id", "c"], ["item_index", "id"], "id").select("batch_id", "id", "first_id", "is_repeat")


@R.add("u1_known_keys", "SELECT storage_key AS key FROM media_assets WHERE storage_key IS NOT NULL UNION SELECT concat('derivatives/', right(id, 2), '/', id, '/page/0123456789abcdef.png') FROM media_assets")
def known_keys(spark, sf_dir):
    """Storage keys of originals and page derivatives."""
    a = table(spark, sf_dir, "media_assets")
    page = keys.derivative_key(F.col("id"), "page", "0123456789abcdef", F.lit("image/png"))
    return a.select(F.col("storage_key").alias("key")).where("key is not null").union(a.select(page.alias("key"))).distinct()


@R.add(
    "k1_original_keys",
    """SELECT id, concat('originals/', checksum_sha256[1:2], '/', checksum_sha256[3:4], '/', checksum_sha256, '.',
 CASE content_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' WHEN 'image/tiff' THEN 'tiff' ELSE 'bin' END) AS key FROM media_assets""",
)
def original_keys(spark, sf_dir):
    return table(spark, sf_dir, "media_assets").select("id", keys.original_key(F.col("checksum_sha256"), F.col("content_type")).alias("key"))


@R.add(
    "j3_item_assets",
    f"WITH {ITEMS} SELECT i.id, a.storage_key, CASE WHEN i.source_asset_id IS NULL THEN 'NO_ASSET' WHEN a.id IS NULL THEN 'ASSET_NOT_FOUND' WHEN a.bytes_state <> 'present' THEN 'BYTES_GONE' END AS error FROM items i LEFT JOIN media_assets a ON a.id = i.source_asset_id",
)
def item_assets(spark, sf_dir):
    """Items with their original; a missing one is an error code, not a lost row."""
    a = table(spark, sf_dir, "media_assets").select(F.col("id").alias("source_asset_id"), "storage_key", "bytes_state", F.lit(True).alias("found"))
    rows = items_now(spark, sf_dir, "source_asset_id").join(a, "source_asset_id", "left")
    error = F.when(F.col("source_asset_id").isNull(), "NO_ASSET").when(F.col("found").isNull(), "ASSET_NOT_FOUND").when(F.col("bytes_state") != "present", "BYTES_GONE")
    return rows.select("id", "storage_key", error.alias("error"))


@R.add(
    "j5_resume_plan",
    f"""WITH {ITEMS}, o AS (SELECT item_id, count(DISTINCT id) AS n FROM ocr_pages GROUP BY item_id), c AS (SELECT item_id, count(DISTINCT id) AS n FROM candidates GROUP BY item_id)
SELECT i.id, coalesce(o.n, 0) AS n_ocr, coalesce(c.n, 0) AS n_candidates,
 CASE WHEN a.id IS NULL THEN 'preprocess' WHEN o.n IS NULL THEN 'ocr' WHEN c.n IS NULL THEN 'llm' ELSE 'finish' END AS start_at
FROM items i LEFT JOIN media_assets a ON a.id = i.source_asset_id AND a.bytes_state = 'present' LEFT JOIN o ON o.item_id = i.id LEFT JOIN c ON c.item_id = i.id""",
)
def resume_plan(spark, sf_dir):
    """What exists of every item and where a resumed run starts. Artifacts are counted before they are joined."""
    pages = table(spark, sf_dir, "ocr_pages").groupBy(F.col("item_id").alias("id")).agg(F.countDistinct("id").alias("n_ocr"))
    found = table(spark, sf_dir, "candidates").groupBy(F.col("item_id").alias("id")).agg(F.countDistinct("id").alias("n_candidates"))
    assets = table(spark, sf_dir, "media_assets").where("bytes_state = 'present'").select(F.col("id").alias("source_asset_id"), F.lit(True).alias("has_bytes"))
    rows = items_now(spark, sf_dir, "source_asset_id").join(assets, "source_asset_id", "left").join(pages, "id", "left").join(found, "id", "left")
    start = F.when(F.col("has_bytes").isNull(), "preprocess").when(F.col("n_ocr").isNull(), "ocr").when(F.col("n_candidates").isNull(), "llm").otherwise("finish")
    return rows.select("id", F.coalesce("n_ocr", F.lit(0)).alias("n_ocr"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), start.alias("start_at"))


@R.add("j7_latest_output", "SELECT item_id, max_by(id, (created_at, id)) AS output_id, count(DISTINCT id) AS n_outputs FROM ocr_outputs GROUP BY item_id")
def latest_output(spark, sf_dir):
    """The latest legacy output of every item."""
    return table(spark, sf_dir, "ocr_outputs").groupBy("item_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("output_id"), F.countDistinct("id").alias("n_outputs"))


@R.add("u4_missing_languages", "SELECT id, array_to_string(list_filter(string_split(languages, '+'), lambda x: x NOT IN ('sin', 'eng')), '+') AS missing FROM ocr_pages")
def missing_languages(spark, sf_dir):
    """U4, H1: requested engine languages that an engine with sin and eng lacks."""
    return table(spark, sf_dir, "ocr_pages").select("id", F.array_join(F.array_except(F.split("languages", r"\+"), F.array(F.lit("sin"), F.lit("eng"))), "+").alias("missing"))


@R.add(
    "a18_import_report",
    """SELECT (SELECT count(*) FROM ingestion_batches) AS batch_rows, (SELECT count(DISTINCT id) FROM ingestion_batches) AS batches, (SELECT count(*) FROM ingestion_items) AS item_rows,
 (SELECT count(DISTINCT id) FROM ingestion_items) AS items, (SELECT count(*) FROM ingestion_batches WHERE idempotency_key IS NULL) AS keyless""",
)
def import_report(spark, sf_dir):
    """Rows delivered against records, as one row."""
    b = table(spark, sf_dir, "ingestion_batches").agg(F.count(F.lit(1)).alias("batch_rows"), F.countDistinct("id").alias("batches"), F.count_if(F.col("idempotency_key").isNull()).alias("keyless"), F.lit(1).alias("one"))
    i = table(spark, sf_dir, "ingestion_items").agg(F.count(F.lit(1)).alias("item_rows"), F.countDistinct("id").alias("items"), F.lit(1).alias("one"))
    return b.join(i, "one").select("batch_rows", "batches", "item_rows", "items", "keyless")


@R.add(
    "d13_idempotency",
    """WITH b AS (SELECT DISTINCT id, created_by, idempotency_key AS k, request_fingerprint AS f, created_at FROM ingestion_batches)
SELECT id, CASE WHEN k IS NULL THEN 'accepted' WHEN id = first_value(id) OVER w THEN 'accepted' WHEN f IS NOT DISTINCT FROM first_value(f) OVER w THEN 'replay' ELSE 'conflict' END AS outcome
FROM b WINDOW w AS (PARTITION BY created_by, k ORDER BY created_at, id)""",
)
def idempotency(spark, sf_dir):
    """Requests of one operator and key: the first is accepted, equal ones are replays, others conflicts; no key, no rule."""
    b = table(spark, sf_dir, "ingestion_batches").select("id", "created_by", F.col("idempotency_key").alias("k"), F.col("request_fingerprint").alias("f"), "created_at").distinct()
    first = b.where("k is not null").groupBy("created_by", "k").agg(F.min_by(F.struct("id", "f"), F.struct("created_at", "id")).alias("first"))
    rows = b.join(first, ["created_by", "k"], "left")
    outcome = F.when(F.col("k").isNull() | (F.col("first.id") == F.col("id")), "accepted").when(F.col("f").eqNullSafe(F.col("first.f")), "replay").otherwise("conflict")
    return rows.select("id", outcome.alias("outcome"))


EDGES = (
    ("ingestion_items", "batch_id", "ingestion_batches"), ("ingestion_items", "source_asset_id", "media_assets"), ("candidates", "item_id", "ingestion_items"), ("ocr_pages", "item_id", "ingestion_items"),
    ("extracted_prices", "candidate_id", "candidates"), ("documents", "item_id", "ocr_pages"),
)


@R.add("c1_references", "\nUNION ALL\n".join(f"SELECT '{t}.{c}' AS edge, {c} AS key FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {'item_id' if t == 'documents' else 'id'} FROM {p})" for t, c, p in (("ingestion_items", "batch_id", "ingestion_batches"), ("ingestion_items", "source_asset_id", "media_assets"), ("candidates", "item_id", "ingestion_items"), ("ocr_pages", "item_id", "ingestion_items"), ("extracted_prices", "candidate_id", "candidates"), ("documents", "item_id", "ocr_pages"))))
def references(spark, sf_dir):
    """Referential checks: one left anti join per edge; documents of items without a captured page are the last one."""
    out = None
    for child, column, parent in EDGES:
        found = records.dangling(table(spark, sf_dir, child), column, table(spark, sf_dir, parent), "item_id" if child == "documents" else "id", f"{child}.{column}")
        out = found if out is None else out.unionByName(found)
    return out


@R.add("c2_uniqueness", "SELECT 'batch, item_index' AS constraint_name, concat_ws('|', batch_id, item_index) AS key, count(*) AS n FROM ingestion_items WHERE batch_id IS NOT NULL AND item_index IS NOT NULL GROUP BY batch_id, item_index HAVING count(*) > 1 UNION ALL SELECT 'asset checksum', checksum_sha256, count(*) FROM media_assets WHERE checksum_sha256 IS NOT NULL GROUP BY checksum_sha256 HAVING count(*) > 1")
def uniqueness(spark, sf_dir):
    items = records.violations(table(spark, sf_dir, "ingestion_items"), ["batch_id", "item_index"], "batch, item_index")
    return items.unionByName(records.violations(table(spark, sf_dir, "media_assets"), ["checksum_sha256"], "asset checksum"))


_RESERVED = ", ".join(f"'{r}'" for r in tx.RESERVED)


@R.add(
    "f8_filenames",
    rf"""WITH n AS (SELECT DISTINCT id, original_filename AS f FROM ingestion_items),
s AS (SELECT id, f, regexp_replace(regexp_replace(string_split(replace(nfc_normalize(f), chr(92), '/'), '/')[-1], '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Zl}}\p{{Zp}}"\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g'), '^\s+|\s+$', '', 'g') AS shown FROM n),
b AS (SELECT id, f, coalesce(nullif(regexp_replace(shown, '^\.+', ''), ''), 'upload') AS bare FROM s)
SELECT id, CASE WHEN f IS NOT NULL THEN left(CASE WHEN lower(regexp_replace(bare, '\.[^.]*$', '')) IN ({_RESERVED}) THEN concat('file-', bare) ELSE bare END, 255) END AS filename FROM b""",
)
def filenames(spark, sf_dir):
    """F8: upload names made safe."""
    return table(spark, sf_dir, "ingestion_items").select("id", tx.safe_filename(F.col("original_filename")).alias("filename")).distinct()
