"""The pipeline's state as data: queue predicates, claims, failures, attempts, drafts, audit events, engine chains.

Every function maps frames to frames; ``now`` is always a parameter (a column), so results are the same whenever they
are computed. Writes become rows: what a transaction would change is what these frames say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions import geometry as g
from pressmill.functions import text as tx
from pressmill.operators import pages, validation

# Failure codes that are worth another attempt, or for preparation are not.
RETRYABLE_CALLS = ("LLM_TIMEOUT", "LLM_RATE_LIMITED", "LLM_SERVER_ERROR", "LLM_TRANSPORT_ERROR", "LLM_TRUNCATED_OUTPUT")
RETRYABLE_READING = ("OCR_UNAVAILABLE", "OCR_TIMEOUT", "OCR_FAILED")
TERMINAL_PREPARATION = ("IMAGE_UNREADABLE", "IMAGE_TOO_LARGE")
RUNNING = ("preprocessing", "ocr_processing", "llm_processing")
MAX_ATTEMPTS, LEASE_SECONDS, RAW_TEXT_LIMIT = 3, 300, 20_000
SECOND = 1_000_000


def retryable(code: Column) -> Column:
    """Whether a failure is worth another automatic attempt; null for no failure.

    Calls, reading and preparation have their lists; an internal error may pass, anything else (a media or an answer
    error) will fail the same way again.
    """
    prepared = code.startswith("IMAGE_") | code.startswith("PREPROCESS_")
    return F.when(code.isNull(), None).when(prepared, ~code.isin(*TERMINAL_PREPARATION)).otherwise(code.isin(*RETRYABLE_CALLS, *RETRYABLE_READING, "INTERNAL_ERROR"))


def failure_family(code: Column) -> Column:
    """The stage vocabulary a code belongs to."""
    return F.when(code.isNull(), None).when(code.startswith("LLM_"), "extraction").when(code.startswith("OCR_"), "reading").when(code.startswith("IMAGE_") | code.startswith("PREPROCESS_"), "preparation").otherwise("other")


def queue_state(items: DataFrame) -> DataFrame:
    """Adds run_after_us, claim_token and lease_us to items(id, status, attempt_count, error_code, created_at, updated_at).

    A waiting item may run when it was created, or after a failed attempt when its back-off has passed; a running one
    holds a token of its attempt and a lease from its last change.
    """
    waited = F.unix_micros("updated_at") + (g.backoff(F.greatest("attempt_count", F.lit(1))) * SECOND).cast("bigint")
    running = F.col("status").isin(*RUNNING)
    return items.select(
        "*", F.when((F.coalesce("attempt_count", F.lit(0)) > 0) & F.col("error_code").isNotNull(), waited).otherwise(F.unix_micros("created_at")).alias("run_after_us"),
        F.when(running, F.concat_ws("#", "id", F.coalesce("attempt_count", F.lit(0)).cast("string"))).alias("claim_token"),
        F.when(running, F.unix_micros("updated_at") + LEASE_SECONDS * SECOND).alias("lease_us"),
    )


def claimable(queue: DataFrame, now_us: Column) -> DataFrame:
    """Uploaded, due, and held by nobody."""
    return queue.where((F.col("status") == "uploaded") & (F.col("run_after_us") <= now_us) & F.col("claim_token").isNull())


def claims(queue: DataFrame, now_us: Column, slots: int) -> DataFrame:
    """The oldest due items for ``slots`` free workers (a top-k) as they are after the claim."""
    first = claimable(queue, now_us).orderBy("run_after_us", "id").limit(slots)
    attempt = F.coalesce("attempt_count", F.lit(0)) + 1
    return first.select("id", F.lit("preprocessing").alias("status"), attempt.alias("attempt_count"), F.concat_ws("#", "id", attempt.cast("string")).alias("claim_token"), (now_us + LEASE_SECONDS * SECOND).alias("lease_us"))


def reaped(queue: DataFrame, now_us: Column) -> DataFrame:
    """Items whose lease has passed (strictly): requeued, or parked with LEASE_EXPIRED at the last attempt."""
    late = queue.where(F.col("claim_token").isNotNull() & (F.col("lease_us") < now_us))
    parked = F.coalesce("attempt_count", F.lit(0)) >= MAX_ATTEMPTS
    return late.select("id", F.when(parked, "needs_attention").otherwise("uploaded").alias("status"), F.when(parked, "LEASE_EXPIRED").alias("error_code"), F.col("lease_us"))


def failed(items: DataFrame) -> DataFrame:
    """items(id, attempt_count, error_code, updated_at) with a failure: requeued with back-off while it is retryable and
    attempts are left, else parked for a person."""
    rows = items.where("error_code is not null")
    exhausted = ~retryable(F.col("error_code")) | (F.coalesce("attempt_count", F.lit(0)) >= MAX_ATTEMPTS)
    again = F.unix_micros("updated_at") + (g.backoff(F.greatest(F.coalesce("attempt_count", F.lit(0)), F.lit(1))) * SECOND).cast("bigint")
    return rows.select("id", "error_code", F.when(exhausted, "needs_attention").otherwise("uploaded").alias("status"), F.when(~exhausted, again).alias("run_after_us"))


def numbered_attempts(runs: DataFrame, key: list[str], order: list[str], won: Column, identifier: str = "id") -> DataFrame:
    """Runs of a key with attempt (1..n), winner_id (the first that ``won``) and outcome.

    'recorded' is the winner or a run before it, 'yielded' a run after it, which resumes from the winner. The winner comes from
    a map-side aggregate; the runs of one key are an item's attempts and few.
    """
    first = runs.where(won).groupBy(*key).agg(F.min_by(F.struct(identifier, *order), F.struct(*order, identifier)).alias("winner"))
    w = Window.partitionBy(*key).orderBy(*order, identifier)
    rows = runs.withColumn("attempt", F.row_number().over(w)).join(first, key, "left")
    later = F.struct(*order, identifier) > F.struct(*[F.col(f"winner.{c}") for c in (*order, identifier)])
    return rows.select(*key, identifier, "attempt", F.col(f"winner.{identifier}").alias("winner_id"), F.when(F.col("winner").isNotNull() & later, "yielded").otherwise("recorded").alias("outcome"))


def call_attempts(started: DataFrame, finished: DataFrame, key: str, run: str) -> DataFrame:
    """One row per call from its two events: ``started(run, key, at)`` before it, ``finished(run, status, raw_text)`` after.

    Calls without an end are 'running'; unknown ends are provider errors; the raw text is cut to 20,000 characters
    (the field's limit). Attempts count per key.
    """
    ends = finished.select(run, F.when(F.col("status").isin("validated", "schema_invalid", "provider_error"), F.col("status")).otherwise("provider_error").alias("status"), F.left("raw_text", F.lit(RAW_TEXT_LIMIT)).alias("raw_text"))
    w = Window.partitionBy(key).orderBy("at", run)
    return started.withColumn("attempt", F.row_number().over(w)).join(ends, run, "left").select(key, run, "attempt", F.coalesce("status", F.lit("running")).alias("status"), "raw_text")


def drafts(candidates: DataFrame, pages_seen: DataFrame, max_candidates: int = 50, versions: tuple[str, ...] = ("1.0",)) -> DataFrame:
    """Drafts of validated ``candidates`` (validation.semantic_candidates) with the warnings of their page.

    ``pages_seen(page_id, n_ads, schema_version, truncated)`` says what the answer and the prompt were like. Codes of the
    candidate come first, then the page's, each once.
    """
    codes = F.array_compact(F.array(
        F.when(F.col("truncated"), "OCR_TRUNCATED"), F.when(~F.col("schema_version").isin(*versions), "SCHEMA_VERSION_UNSUPPORTED"), F.when(F.col("n_ads") > max_candidates, "CANDIDATE_LIMIT_EXCEEDED"),
    ))
    page = pages_seen.select("page_id", codes.alias("page_codes"))
    rows = candidates.join(page, "page_id", "left")
    return rows.select(
        "page_id", F.col("candidate_index").alias("index"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "location", "price")], "category", "phones", "language", "confidence",
        g.confidence_label(F.col("confidence")).alias("confidence_label"), "source_block_ids",
        F.array_distinct(F.concat("warning_codes", F.coalesce("page_codes", F.array().cast("array<string>")))).alias("warning_codes"),
    )


def created(drafted: DataFrame, key: list[str]) -> DataFrame:
    """The advertisement and the provenance of every draft in one relation: ids are made from ``key`` and index, so
    a repeated run makes the same rows; the status is always pending; a key that exists twice is created once."""
    ids = [F.col(c).cast("string") for c in (*key, "index")]
    rows = drafted.withColumn("ad_id", tx.make_id("adv", *ids)).withColumn("provenance_id", tx.make_id("prv", *ids)).withColumn("status", F.lit("pending"))
    return rows.dropDuplicates(["provenance_id"])


def audit_events(versions: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """An event per later version of a record that changed something, with the values before and after.

    Versions without a change leave no event. Versions of one record are few.
    """
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(version), *[F.asc_nulls_last(c) for c in fields])
    seen = versions.select(key, version, *fields).distinct().select("*", F.lag(key).over(w).alias("_before"), *[F.lag(c).over(w).alias(f"{c}_0") for c in fields])
    changed = [c for c in fields]
    flags = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"{c}_0")), F.lit(c)) for c in changed]))
    rows = seen.where("_before is not null").withColumn("changed", flags).where(F.size("changed") > 0)
    image = lambda suffix: F.to_json(F.struct(*[F.when(F.array_contains("changed", c), F.coalesce(f"{c}{suffix}", F.lit(""))).alias(c) for c in fields]))
    return rows.select(key, version, F.array_join("changed", ",").alias("changed"), image("_0").alias("before_values"), image("").alias("after_values"))


def read_pages(tsv_words: DataFrame, widths: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Engine words to pages: usable words, lines and blocks, reading order, text, confidence, warnings.

    ``tsv_words`` are rows of documents.words_of, ``widths(doc, page_width)`` the page sizes. Pages without usable words have
    no row. A page is the bounded unit that is collected.
    """
    blocks = pages.blocks_of(pages.usable_words(tsv_words)).join(widths, "doc")
    ordered = pages.reading_order(blocks, F.col("page_width"), ["doc", "page"], "block")
    packed = ordered.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("position", "text", "confidence"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")
    seen = packed.select("doc", text.alias("text"), g.python_mean(F.filter(F.transform("b", lambda x: x["confidence"]), lambda c: c.isNotNull())).alias("confidence"), F.size("b").alias("n_blocks"))
    return seen.select("*", g.page_warnings(F.col("text"), F.col("confidence"), threshold).alias("warnings"), F.coalesce(F.col("confidence") < threshold, F.lit(False)).alias("low_confidence"))


def ordered_regions(regions: DataFrame, widths: DataFrame, page: str) -> DataFrame:
    """Merged regions (pages.regions_of) in reading order: column bands, then down each band."""
    boxed = regions.select(page, "region_no", F.array("left", "top", "width", "height").alias("box")).join(widths, page)
    return pages.reading_order(boxed, F.col("page_width"), [page], "region_no").select(page, "region_no", "band", "position", "box")


def hybrid_paths(widths: DataFrame, detected: DataFrame, regions: DataFrame, page: str, most: int = 200) -> DataFrame:
    """How a page is read when a detector finds its regions, with the four ways back to the plain reader.

    ``detected(page, available, failed, n_lines)`` is the detector's report; pages without a report had none available.
    """
    merged = regions.groupBy(page).agg(F.count(F.lit(1)).alias("n_regions"))
    rows = widths.join(detected, page, "left").join(merged, page, "left")
    warning = (
        F.when(~F.coalesce("available", F.lit(False)), "DETECTOR_UNAVAILABLE").when(F.coalesce("failed", F.lit(False)), "DETECTOR_FAILED")
        .when(F.coalesce("n_lines", F.lit(0)) == 0, "NO_REGIONS_DETECTED").when(F.coalesce("n_regions", F.lit(0)) > most, "TOO_MANY_REGIONS")
    )
    return rows.select(page, F.coalesce("n_regions", F.lit(0)).alias("n_regions"), warning.isNotNull().alias("degraded"), warning.alias("warning"))


def rule_based_drafts(page_rows: DataFrame, categories: DataFrame) -> DataFrame:
    """X3 to X9 joined: pages(page_id, text, known_ids) read by rules, validated and drafted."""
    answered = validation.rule_based_answers(page_rows).select("page_id", "known_ids", "answer")
    seen = answered.select("page_id", F.size(F.from_json("answer", validation.AD_SCHEMA)["advertisements"]).alias("n_ads"), F.get_json_object("answer", "$.schema_version").alias("schema_version"), F.lit(False).alias("truncated"))
    return drafts(validation.semantic_candidates(answered, categories), seen)
