"""The pipeline's queries: claims, failures, attempts, drafts, audit, uploads, imports, engine chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.io import table
from pressmill.operators import pages, pipeline, validation
from pressmill.plans import ingestion, review
from pressmill.plans.pages import blocks, words
from pressmill.plans.registry import Registry
from pressmill.session import durable
from pressmill.sources import documents

R = Registry()
QUERIES, SQL = R.queries, R.sql
ITEMS = ingestion.ITEMS

_BACKOFF_US = "(least(2.0 * pow(2.0, greatest(coalesce(attempt_count, 0), 1) - 1), 60.0) * 1000000)::bigint"
_LISTED = "'LLM_TIMEOUT', 'LLM_RATE_LIMITED', 'LLM_SERVER_ERROR', 'LLM_TRANSPORT_ERROR', 'LLM_TRUNCATED_OUTPUT', 'OCR_UNAVAILABLE', 'OCR_TIMEOUT', 'OCR_FAILED', 'INTERNAL_ERROR'"
_RETRYABLE = f"CASE WHEN starts_with(error_code, 'IMAGE_') OR starts_with(error_code, 'PREPROCESS_') THEN error_code NOT IN ('IMAGE_UNREADABLE', 'IMAGE_TOO_LARGE') ELSE error_code IN ({_LISTED}) END"
_QUEUE = f"""{ITEMS}, now AS (SELECT max(epoch_us(updated_at)) AS t FROM ingestion_items),
queue AS (SELECT *, CASE WHEN coalesce(attempt_count, 0) > 0 AND error_code IS NOT NULL THEN epoch_us(updated_at) + {_BACKOFF_US} ELSE epoch_us(created_at) END AS run_after_us,
 CASE WHEN status IN ('preprocessing', 'ocr_processing', 'llm_processing') THEN epoch_us(updated_at) + 300000000 END AS lease_us FROM items)"""


def queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    """The items as the queue sees them, and the newest change in the table as the time of the question."""
    rows = ingestion.items_now(spark, sf_dir, "status", "attempt_count", "error_code", "created_at", "updated_at")
    now = table(spark, sf_dir, "ingestion_items").agg(F.max(F.unix_micros("updated_at"))).first()[0]
    return pipeline.queue_state(rows), F.lit(now).cast("bigint")


@R.add("w5_claimable_now", f"WITH {_QUEUE} SELECT id, run_after_us FROM queue, now WHERE status = 'uploaded' AND run_after_us <= now.t")
def claimable_now(spark, sf_dir):
    """What may be claimed now."""
    return pipeline.claimable(*queue(spark, sf_dir)).select("id", "run_after_us")


@R.add(
    "d2_claims",
    f"""WITH {_QUEUE} SELECT id, 'preprocessing' AS status, coalesce(attempt_count, 0) + 1 AS attempt_count, concat(id, '#', coalesce(attempt_count, 0) + 1) AS claim_token, now.t + 300000000 AS lease_us
FROM queue, now WHERE status = 'uploaded' AND run_after_us <= now.t ORDER BY run_after_us, id LIMIT 8""",
)
def claims(spark, sf_dir):
    """The claims of eight free workers (the slots are the feature)."""
    return pipeline.claims(*queue(spark, sf_dir), 8)


@R.add(
    "d4_reaped",
    f"""WITH {_QUEUE} SELECT id, CASE WHEN coalesce(attempt_count, 0) >= 3 THEN 'needs_attention' ELSE 'uploaded' END AS status, CASE WHEN coalesce(attempt_count, 0) >= 3 THEN 'LEASE_EXPIRED' END AS error_code, lease_us
FROM queue, now WHERE lease_us < now.t""",
)
def reaped(spark, sf_dir):
    return pipeline.reaped(*queue(spark, sf_dir))


@R.add(
    "x15_failure_classes",
    f"""WITH {ITEMS} SELECT error_code, CASE WHEN starts_with(error_code, 'LLM_') THEN 'extraction' WHEN starts_with(error_code, 'OCR_') THEN 'reading' WHEN starts_with(error_code, 'IMAGE_') OR starts_with(error_code, 'PREPROCESS_') THEN 'preparation' ELSE 'other' END AS family,
{_RETRYABLE} AS retryable, count(*) AS n FROM items WHERE error_code IS NOT NULL GROUP BY ALL""",
)
def failure_classes(spark, sf_dir):
    """The failures of all items by code."""
    code = F.col("error_code")
    rows = ingestion.items_now(spark, sf_dir, "error_code").where("error_code is not null")
    return rows.groupBy("error_code").agg(F.count(F.lit(1)).alias("n")).select("error_code", pipeline.failure_family(code).alias("family"), pipeline.retryable(code).alias("retryable"), "n")


@R.add(
    "d5_failures",
    f"""WITH {ITEMS}, f AS (SELECT *, NOT ({_RETRYABLE}) OR coalesce(attempt_count, 0) >= 3 AS exhausted FROM items WHERE error_code IS NOT NULL)
SELECT id, error_code, CASE WHEN exhausted THEN 'needs_attention' ELSE 'uploaded' END AS status, CASE WHEN NOT exhausted THEN epoch_us(updated_at) + {_BACKOFF_US} END AS run_after_us FROM f""",
)
def failures(spark, sf_dir):
    """Every failed item requeued with back-off or parked."""
    return pipeline.failed(ingestion.items_now(spark, sf_dir, "attempt_count", "error_code", "updated_at"))


@R.add(
    "d7_reading_attempts",
    """WITH o AS (SELECT DISTINCT item_id, id, created_at, coalesce(trim(text), '') <> '' AS won FROM (SELECT item_id, id, created_at, text FROM ocr_pages UNION ALL SELECT item_id, id, created_at, text FROM ocr_outputs)),
w AS (SELECT item_id, min((created_at, id)) AS best FROM o WHERE won GROUP BY item_id),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at NULLS FIRST, id)::int AS attempt FROM o)
SELECT n.item_id, n.id, n.attempt, w.best[2] AS winner_id, CASE WHEN w.best IS NOT NULL AND (n.created_at, n.id) > w.best THEN 'yielded' ELSE 'recorded' END AS outcome FROM n LEFT JOIN w USING (item_id)""",
)
def reading_attempts(spark, sf_dir):
    """Readings of an item by both engines as attempts; the first one with text wins, later ones yield to it."""
    parts = [table(spark, sf_dir, t).select("item_id", "id", "created_at", (F.coalesce(F.trim("text"), F.lit("")) != "").alias("won")) for t in ("ocr_pages", "ocr_outputs")]
    return pipeline.numbered_attempts(parts[0].unionByName(parts[1]).distinct(), ["item_id"], ["created_at"], F.col("won"))


@R.add(
    "a7_next_reading",
    """SELECT item_id, count(*) + 1 AS next_attempt FROM (SELECT DISTINCT item_id, id FROM (SELECT item_id, id FROM ocr_pages UNION ALL SELECT item_id, id FROM ocr_outputs)) GROUP BY item_id""",
)
def next_reading(spark, sf_dir):
    """The greatest attempt of every item plus one."""
    return reading_attempts(spark, sf_dir).groupBy("item_id").agg((F.max("attempt") + 1).cast("bigint").alias("next_attempt"))


@R.add(
    "d15_call_attempts",
    """WITH p AS (SELECT DISTINCT price_id, candidate_id, captured_at, raw, amount FROM extracted_prices),
f AS (SELECT price_id, any_value(status) AS status, any_value(raw) AS raw FROM (SELECT price_id, CASE WHEN raw IS NOT NULL AND amount IS NOT NULL THEN 'validated' WHEN raw IS NOT NULL THEN 'schema_invalid' WHEN amount IS NOT NULL THEN 'provider_error' END AS status, raw FROM p) WHERE status IS NOT NULL GROUP BY price_id)
SELECT s.candidate_id, s.price_id, row_number() OVER (PARTITION BY s.candidate_id ORDER BY s.at NULLS FIRST, s.price_id)::int AS attempt, coalesce(f.status, 'running') AS status, left(f.raw, 20000) AS raw_text
FROM (SELECT price_id, any_value(candidate_id) AS candidate_id, min(captured_at) AS at FROM p GROUP BY price_id) s LEFT JOIN f USING (price_id)""",
)
def call_attempts(spark, sf_dir):
    """The calls that read prices, folded from their start and their end."""
    rows = table(spark, sf_dir, "extracted_prices").select("price_id", "candidate_id", "captured_at", "raw", "amount").distinct()
    started = rows.groupBy("price_id").agg(F.any_value("candidate_id").alias("candidate_id"), F.min("captured_at").alias("at"))
    status = F.when(F.col("raw").isNotNull() & F.col("amount").isNotNull(), "validated").when(F.col("raw").isNotNull(), "schema_invalid").when(F.col("amount").isNotNull(), "provider_error")
    finished = rows.select("price_id", status.alias("status"), F.col("raw").alias("raw_text")).where("status is not null").groupBy("price_id").agg(F.any_value("status").alias("status"), F.any_value("raw_text").alias("raw_text"))
    return pipeline.call_attempts(started, finished, "candidate_id", "price_id")


_AUDITED = ("status", "category", "location")
_IMAGE = lambda suffix: "concat('{', array_to_string(list_filter([" + ", ".join(f"""CASE WHEN {c} IS NOT NULL AND {c} IS DISTINCT FROM {c}_0 THEN concat('"{c}":', to_json(coalesce({c}{suffix}, ''))::varchar) END""" for c in _AUDITED) + "], lambda x: x IS NOT NULL), ','), '}')"


@R.add(
    "d12_audit_events",
    f"""WITH v AS (SELECT id, version, status, category, location, lag(id) OVER w AS before_id, {', '.join(f'lag({c}) OVER w AS {c}_0' for c in _AUDITED)}
 FROM (SELECT DISTINCT id, version, status, category, location FROM candidates) WINDOW w AS (PARTITION BY id ORDER BY version, status, category, location)),
e AS (SELECT id, version, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} IS NOT NULL AND {c} IS DISTINCT FROM {c}_0 THEN '{c}' END" for c in _AUDITED)}], lambda x: x IS NOT NULL), ',') AS changed,
 {_IMAGE('_0')} AS before_values, {_IMAGE('')} AS after_values FROM v WHERE before_id IS NOT NULL) SELECT * FROM e WHERE changed <> ''""",
)
def audit_events(spark, sf_dir):
    """What later versions of a candidate changed, with the values before and after."""
    return pipeline.audit_events(table(spark, sf_dir, "candidates"), "id", "version", list(_AUDITED))


_MADE = lambda prefix: f"concat('{prefix}_', upper(sha256(concat_ws('|', item_id, generation::varchar, candidate_index::varchar))[1:26]))"


@R.add(
    "d9_created",
    f"SELECT DISTINCT {_MADE('adv')} AS ad_id, {_MADE('prv')} AS provenance_id, item_id, generation, candidate_index AS index, 'pending' AS status FROM candidates WHERE item_id IS NOT NULL AND candidate_index IS NOT NULL",
)
def created(spark, sf_dir):
    """The advertisement and provenance ids of every (item, generation, index), made once, always pending."""
    rows = table(spark, sf_dir, "candidates").where("item_id is not null and candidate_index is not null").select("item_id", "generation", F.col("candidate_index").alias("index")).distinct()
    return pipeline.created(rows, ["item_id", "generation"]).select("ad_id", "provenance_id", "item_id", "generation", "index", "status")


_MERGED = "list_concat(coalesce(c.warning_codes, []), coalesce(i.item_warnings, []))"
_VIEW = ("provenance_id", "status", "candidate_state", "origin", "title", "description", "category", "location", "price", "language", "confidence_label", "version", "batch_id", "item_id", "source_asset_id", "candidate_index", "generation", "reviewer_id")


@R.add(
    "view3_full",
    f"""WITH {review.CANDIDATES}, {review.ITEMS} SELECT c.id, {', '.join(f'c.{x}' for x in _VIEW)}, array_to_string(c.phones, '|') AS phones, CASE WHEN NOT isnan(c.confidence_overall) THEN c.confidence_overall END AS confidence_overall,
 array_to_string(list_filter({_MERGED}, lambda x, i: x IS NOT NULL AND list_position({_MERGED}, x) = i), ',') AS warning_codes,
 epoch_us(c.created_at) AS created_us, epoch_us(c.updated_at) AS updated_us, epoch_us(c.reviewed_at) AS reviewed_us
FROM cands c LEFT JOIN items i USING (item_id)""",
)
def full_view(spark, sf_dir):
    """All 25 fields of a candidate, the warnings of both sides in the order of their first mention (NaN shown as null)."""
    none = F.array().cast("array<string>")
    items = ingestion.items_now(spark, sf_dir, "warning_codes").select(F.col("id").alias("item_id"), F.col("warning_codes").alias("item_warnings"))
    rows = review.candidates_now(spark, sf_dir, *_VIEW, "phones", "confidence_overall", "warning_codes", "created_at", "updated_at", "reviewed_at").join(items, "item_id", "left")
    merged = F.array_distinct(F.array_compact(F.concat(F.coalesce("warning_codes", none), F.coalesce("item_warnings", none))))
    return rows.select(
        "id", *_VIEW, F.array_join("phones", "|").alias("phones"), F.nanvl("confidence_overall", F.lit(None).cast("double")).alias("confidence_overall"), F.array_join(merged, ",").alias("warning_codes"),
        *[F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("created", "updated", "reviewed")],
    )


_PROBLEMS = (
    ("EMPTY_FILE", "byte_size IS NULL OR byte_size <= 0"), ("FILE_TOO_LARGE", "byte_size > 10485760"), ("UNSUPPORTED_TYPE", "content_type IS NULL OR content_type NOT IN ('image/jpeg', 'image/png', 'image/webp')"),
    ("UNREADABLE_SIZE", "width IS NULL OR height IS NULL"), ("TOO_MANY_PIXELS", "CAST(width AS bigint) * height > 40000000"), ("TYPE_MISMATCH", "image_format IS NOT NULL AND lower(image_format) <> split_part(content_type, '/', 2)"),
)


@R.add(
    "s15_upload_sets",
    f"""WITH {ITEMS}, f AS (SELECT i.batch_id, i.id, a.byte_size, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PROBLEMS)}], lambda x: x IS NOT NULL) AS p FROM items i JOIN media_assets a ON a.id = i.source_asset_id WHERE i.batch_id IS NOT NULL),
b AS (SELECT batch_id, count(*) AS n_files, count(*) FILTER (len(p) > 0) AS n_bad, sum(byte_size)::bigint AS total_bytes FROM f GROUP BY batch_id)
SELECT f.batch_id, f.id, array_to_string(f.p, ',') AS problems, n_bad > 0 OR n_files > 20 OR total_bytes > 104857600 AS set_refused, CASE WHEN n_files > 20 THEN 'MAX_COUNT' WHEN total_bytes > 104857600 THEN 'MAX_BATCH_SIZE' END AS set_problem FROM f JOIN b USING (batch_id)""",
)
def upload_sets(spark, sf_dir):
    """Every problem of every file, and the set that is refused as a whole for one bad file, its number or its size."""
    assets = table(spark, sf_dir, "media_assets").select(F.col("id").alias("source_asset_id"), "byte_size", F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PROBLEMS) + "))").alias("p"))
    rows = ingestion.items_now(spark, sf_dir, "batch_id", "source_asset_id").where("batch_id is not null").join(assets, "source_asset_id")
    sets = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.size("p") > 0).alias("n_bad"), F.sum("byte_size").alias("total_bytes"))
    shape = F.when(F.col("n_files") > 20, "MAX_COUNT").when(F.col("total_bytes") > 104857600, "MAX_BATCH_SIZE")
    refused = (F.col("n_bad") > 0) | (F.col("n_files") > 20) | (F.col("total_bytes") > 104857600)
    return rows.join(sets, "batch_id").select("batch_id", "id", F.array_join("p", ",").alias("problems"), refused.alias("set_refused"), shape.alias("set_problem"))


@R.add(
    "s11_import_dry_run",
    """WITH store AS (SELECT DISTINCT id FROM candidates), known AS (SELECT DISTINCT id FROM candidates WHERE load_id = (SELECT min(load_id) FROM candidates))
SELECT count(*) AS seen, count(*) FILTER (id NOT IN (SELECT id FROM known)) AS imported, count(*) FILTER (id IN (SELECT id FROM known)) AS skipped FROM store""",
)
def import_dry_run(spark, sf_dir):
    """A store imported over what its first load brought: the report of a run that writes nothing."""
    rows = table(spark, sf_dir, "candidates").select(F.col("id").alias("store_id"), "load_id")
    first = rows.agg(F.min("load_id").alias("load_id"))
    return documents.import_report(documents.import_rows(rows.select("store_id").distinct(), rows.join(first, "load_id")))


@R.add(
    "j6_unread_assets",
    "SELECT id, storage_key FROM media_assets WHERE id NOT IN (SELECT source_asset_id FROM candidates WHERE source_asset_id IS NOT NULL)",
)
def unread_assets(spark, sf_dir):
    """Stored originals that no candidate was read from."""
    from pressmill.operators import records

    used = table(spark, sf_dir, "candidates").select(F.col("source_asset_id").alias("id")).where("id is not null").distinct()
    return records.orphans(table(spark, sf_dir, "media_assets"), used, "id").select("id", "storage_key")


@R.add(
    "d8_superseded_versions",
    "WITH v AS (SELECT DISTINCT id, version, status FROM candidates), g AS (SELECT id, max(version) AS newest FROM v GROUP BY id) SELECT v.id, v.version, g.newest, v.status NOT IN ('active', 'rejected', 'sold') AS superseded FROM v JOIN g USING (id) WHERE v.version < g.newest",
)
def superseded_versions(spark, sf_dir):
    """Versions that a newer one follows; decided ones stay."""
    rows = table(spark, sf_dir, "candidates").select("id", "version", "status").distinct()
    newest = rows.groupBy("id").agg(F.max("version").alias("newest"))
    return rows.join(newest, "id").where("version < newest").select("id", "version", "newest", (~F.col("status").isin("active", "rejected", "sold")).alias("superseded"))


_LINES = r"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]'), lambda s: regexp_replace(s, '^[ :\-]+|[ :\-]+$', '', 'g')), lambda s: s <> '')"
_PRICE = r"(?i)(?:rs\.?|රු\.?)[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]*[\p{Nd},]+"
_CITY = "|".join(tx.CITIES)


@R.add(
    "x9_rule_reader",
    rf"""WITH l AS (SELECT id, text, {_LINES} AS ls FROM ocr_pages), j AS (SELECT *, array_to_string(ls, ' ') AS t FROM l),
p AS (SELECT *, coalesce(replace(nullif(regexp_extract(t, '{_PRICE}', 0), ''), 'Rs ', 'Rs. '), 'Price pending') AS raw FROM j)
SELECT id AS page_id, left(coalesce(list_filter(ls, lambda s: NOT regexp_matches(s, '{_PRICE}') AND length(s) > 3)[1], 'Newspaper advertisement'), 120) AS title, raw AS price,
 try_cast(nullif(regexp_replace(translate(raw, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '') AS bigint) AS amount, CASE WHEN regexp_matches(raw, '\p{{Nd}}') THEN 'LKR' END AS currency,
 coalesce(nullif(trim(regexp_extract(t, '(?i)\b(?:{_CITY})\s*\d{{0,2}}\b', 0)), ''), {', '.join(f"CASE WHEN contains(lower(t), '{c.lower()}') THEN '{c}' END" for c in tx.CITIES)}, 'Location pending') AS location,
 lower(CASE {' '.join(f"WHEN regexp_matches(lower(t), '{'|'.join(w)}') THEN '{k}'" for k, w in tx.KEYWORDS.items())} ELSE 'Other' END) AS category
FROM p WHERE trim(text) <> ''""",
)
def rule_reader(spark, sf_dir):
    """X9, F9-F12, G-8: what the rule-based reader finds on every page with text."""
    rows = validation.rule_based_answers(table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("page_id"), "text", F.transform("blocks", lambda b: b["id"]).alias("known_ids")))
    ad = F.get(F.from_json("answer", validation.AD_SCHEMA)["advertisements"], F.lit(0))
    return rows.select("page_id", ad.alias("a")).where("a is not null").select("page_id", "a.title", F.col("a.price.raw").alias("price"), F.col("a.price.amount").alias("amount"), F.col("a.price.currency").alias("currency"), "a.location", "a.category")


@R.add(
    "x5_checked_answers",
    f"""WITH {review.CANDIDATES} SELECT id, (coalesce(language, 'none') NOT IN ('si', 'en', 'ta', 'mixed', 'unknown'))::int + (length(title) > 300)::int + coalesce((length(description) > 4000)::int, 0) + (category IS NULL OR length(category) > 64)::int
 + coalesce((length(location) > 200)::int, 0) + coalesce((length(price) > 200)::int, 0) + (confidence_overall IS NULL OR isnan(confidence_overall) OR confidence_overall NOT BETWEEN 0 AND 1)::int
 + (phones IS NULL OR len(list_filter(phones, lambda p: p IS NULL OR length(p) > 40)) > 0)::int AS n_errors FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM cands)""",
)
def checked_answers(spark, sf_dir):
    """Candidates written as engine answers, faults and all (labels, NaN, confidences out of range, null lists), and checked."""
    rows = review.candidates_now(spark, sf_dir, "language", "title", "description", "category", "location", "price", "confidence_overall", "phones")
    quoted = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(F.array(c).alias("v"))), "$.v[0]"), F.lit("null"))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), F.when(F.col(c).isNull(), "null").otherwise(text(c)))
    number = F.when(F.col("confidence_overall").isNull(), "null").when(F.isnan("confidence_overall"), "NaN").otherwise(F.col("confidence_overall").cast("string"))
    listed = F.when(F.col("phones").isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct("phones"), {"ignoreNullFields": "false"}), r'(?s)^\{"phones":(.*)\}$', 1))
    answer = F.concat(
        F.lit('{"schema_version":"1.0","advertisements":[{'), F.concat_ws(",", *[field(c, c) for c in ("language", "title", "description", "category", "location")]),
        F.lit(',"price":{'), field("raw", "price"), F.lit('},"contacts":{"phones":'), listed, F.lit('},"confidence":{"overall":'), number, F.lit("}}]}"),
    )
    return rows.select("id", F.size(validation.structural_errors_udf(answer)).alias("n_errors"))


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("page_id"), "text", F.transform("blocks", lambda b: b["id"]).alias("known_ids"))


@R.add("x8_drafts", None)
def drafts(spark, sf_dir):
    """Drafts of every page read by rules: index, labels, warnings of the candidate and of its page."""
    forms = table(spark, sf_dir, "ref_categories").select("slug", F.explode(F.concat(F.array("slug", "label"), "aliases")).alias("f"))
    book = forms.groupBy(tx.category_key(F.col("f")).alias("key")).agg(F.min("slug").alias("slug"))
    answered = durable(validation.rule_based_answers(_page_rows(spark, sf_dir)).select("page_id", "known_ids", "answer"))
    seen = answered.select("page_id", F.size(F.from_json("answer", validation.AD_SCHEMA)["advertisements"]).alias("n_ads"), F.get_json_object("answer", "$.schema_version").alias("schema_version"), F.lit(False).alias("truncated"))
    made = pipeline.drafts(validation.semantic_candidates(answered, book), seen)
    return made.select("page_id", "index", "title", "location", "price", "category", "language", "confidence", "confidence_label", F.size("source_block_ids").alias("n_cited"), F.array_join("warning_codes", ",").alias("warning_codes"))


def engine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, value): the pages' words as the tab-separated lines an engine prints, its header included."""
    w = words(spark, sf_dir)
    line = F.concat_ws("\t", *[x.cast("string") for x in (F.lit(5), *[F.col(c) for c in ("page", "block", "paragraph", "line", "word", "left", "top", "width", "height", "confidence")])], "text")
    head = table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("doc"), F.lit("\t".join(documents.TSV)).alias("value")).distinct()
    return w.select("doc", line.alias("value")).unionByName(head)


def page_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("doc"), F.col("width").alias("page_width")).dropDuplicates(["doc"])


@R.add(
    "x3_read_pages",
    """WITH b AS (SELECT p.id AS page_id, p.width AS page_width, u.b.id AS id, u.b.text AS text, u.b.confidence AS confidence, coalesce(u.b.box[1], 0) AS l, coalesce(u.b.box[2], 0) AS t FROM ocr_pages p, unnest(p.blocks) AS u(b) WHERE u.b.confidence IS NOT NULL),
k AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: array_to_string(list_filter(list_transform(string_split(s, ' '), lambda w: trim(w)), lambda w: w <> ''), ' ')), lambda s: s <> ''), chr(10)) AS clean FROM b),
f AS (SELECT * FROM k WHERE clean <> ''),
s AS (SELECT *, l - lag(l) OVER (PARTITION BY page_id ORDER BY l, id) AS step FROM f),
d AS (SELECT *, sum(CASE WHEN step > greatest(1, floor(page_width * 0.15)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY l, id ROWS UNBOUNDED PRECEDING) AS band FROM s)
SELECT page_id AS doc, md5(string_agg(clean, chr(10) || chr(10) ORDER BY band, t, l, id)) AS digest, count(*)::int AS n_blocks, avg(confidence) < 0.6 AS low_confidence FROM d GROUP BY page_id""",
)
def read_pages(spark, sf_dir):
    """Engine output to pages: S7, S8, W13, A13, N1, A14, A11, G-6 in one plan."""
    got = pipeline.read_pages(documents.words_of(documents.read_tsv(engine_lines(spark, sf_dir))), page_widths(spark, sf_dir))
    return got.select("doc", F.md5("text").alias("digest"), "n_blocks", "low_confidence")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = words(spark, sf_dir).groupBy("doc", "block", "line").agg(F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), F.max("height").alias("height"))
    return pages.regions_of(lines.select("doc", "left", "top", "width", "height"), "doc")


@R.add("n2_region_order", None)
def region_order(spark, sf_dir):
    """Regions of line boxes in reading order."""
    done = pipeline.ordered_regions(_regions(spark, sf_dir), page_widths(spark, sf_dir), "doc")
    return done.select("doc", "region_no", "band", "position", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


@R.add("x4_hybrid_paths", None)
def hybrid_paths(spark, sf_dir):
    """How every page would be read by detection and recognition: pages of the plain engine have no detector, pages whose
    boxes are all missing report none, and more than ten regions fall back to the whole page."""
    seen = blocks(spark, sf_dir, "engine").groupBy(F.col("page_id").alias("doc"), "engine").agg(F.count("box").alias("n_lines"))
    detected = seen.select("doc", (F.col("engine") == "paddle_tesseract").alias("available"), F.lit(False).alias("failed"), "n_lines")
    return pipeline.hybrid_paths(page_widths(spark, sf_dir), detected, _regions(spark, sf_dir), "doc", most=10)


@R.add(
    "x16_prototype_ads",
    rf"""WITH l AS (SELECT DISTINCT id, confidence, text, {_LINES} AS ls FROM ocr_outputs WHERE text IS NOT NULL), j AS (SELECT *, array_to_string(ls, ' ') AS t FROM l)
SELECT id, left(coalesce(list_filter(ls, lambda s: NOT regexp_matches(s, '{_PRICE}') AND length(s) > 3)[1], 'Newspaper advertisement'), 120) AS title,
 coalesce(replace(nullif(regexp_extract(t, '{_PRICE}', 0), ''), 'Rs ', 'Rs. '), 'Price pending') AS price, CASE {' '.join(f"WHEN regexp_matches(lower(t), '{'|'.join(w)}') THEN '{k}'" for k, w in tx.KEYWORDS.items())} ELSE 'Home' END AS category,
 'pending_review' AS status, confidence AS extraction_confidence FROM j""",
)
def prototype_ads(spark, sf_dir):
    """Advertisements made of legacy outputs: the same rules with another fallback category, always pending review."""
    lines = tx.joined_lines(F.col("text"))
    rows = table(spark, sf_dir, "ocr_outputs").where("text is not null").select("id", "confidence", "text").distinct().select("id", "confidence", lines.alias("ls")).withColumn("t", F.array_join("ls", " "))
    return rows.select("id", tx.first_title(F.col("ls")).alias("title"), tx.first_price(F.col("t")).alias("price"), tx.keyword_category(F.col("t"), "Home").alias("category"), F.lit("pending_review").alias("status"), F.col("confidence").alias("extraction_confidence"))


@R.add(
    "w1_item_filter",
    f"WITH {review.CANDIDATES}, {review.ITEMS}, one AS (SELECT min(item_id) AS item_id FROM cands WHERE candidate_state = 'linked') SELECT c.id, c.item_id, c.status FROM cands c JOIN items i USING (item_id) JOIN one USING (item_id)",
)
def item_filter(spark, sf_dir):
    """The candidates of one item (the first linked one)."""
    rows = review.queue(spark, sf_dir)
    one = review.candidates_now(spark, sf_dir, "candidate_state", "item_id").where("candidate_state = 'linked'").agg(F.min("item_id")).first()[0]
    return review.filtered(rows, item=one if one is not None else "").select("id", "item_id", "status")


@R.add("view7_wire_status", f"WITH {review.CANDIDATES} SELECT CASE status WHEN 'pending_review' THEN 'pending' ELSE status END AS stored_status, status AS wire_status, count(*) AS n FROM cands GROUP BY ALL")
def wire_status(spark, sf_dir):
    """The outside's status names and the stored ones they stand for."""
    counted = review.candidates_now(spark, sf_dir, "status").groupBy(F.col("status").alias("wire_status")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("wire_status") == "pending_review", "pending").otherwise(F.col("wire_status")).alias("stored_status"), "wire_status", "n")


@R.add(
    "d1_item_histories",
    "WITH v AS (SELECT DISTINCT id, ingested_at, load_id, status FROM ingestion_items) SELECT id, string_agg(coalesce(status, ''), '>' ORDER BY ingested_at, load_id, status) AS path, count(*)::int AS n_events FROM v GROUP BY id",
)
def item_histories(spark, sf_dir):
    """The deliveries of every item folded in order."""
    from pressmill.operators import records

    events = table(spark, sf_dir, "ingestion_items").select("id", "ingested_at", "load_id", "status").distinct()
    step = lambda state, e: F.concat(state, F.when(state == "", "").otherwise(">"), F.coalesce(e["status"], F.lit("")))
    return records.fold_events(events, "id", ["ingested_at", "load_id", "status"], F.lit(""), step).select("id", F.col("state").alias("path"), "n_events")


@R.add("k5_candidate_sets", f"WITH {review.CANDIDATES} SELECT item_id, generation, sha256(concat_ws('|', item_id, generation::varchar, min(provenance_id))) AS set_key, count(*) AS n FROM cands WHERE item_id IS NOT NULL GROUP BY item_id, generation")
def candidate_sets(spark, sf_dir):
    """K5: the idempotency key of the candidates of an item and generation, with the first provenance as their run."""
    from pressmill.functions import keys

    rows = review.candidates_now(spark, sf_dir, "item_id", "generation", "provenance_id").where("item_id is not null")
    grouped = rows.groupBy("item_id", "generation").agg(F.min("provenance_id").alias("run"), F.count(F.lit(1)).alias("n"))
    return grouped.select("item_id", "generation", keys.request_hash(F.col("item_id"), F.col("generation").cast("string"), F.col("run")).alias("set_key"), "n")


@R.add(
    "k4_extraction_requests",
    "WITH c AS (SELECT sha256(string_agg(slug, ',' ORDER BY slug)) AS v FROM ref_categories) SELECT id, sha256(concat_ws('|', 'rule_based', 'rules', 'extract/v1', '1.0', c.v, text)) AS request_hash FROM ocr_pages, c",
)
def extraction_requests(spark, sf_dir):
    """K4: the hash of an extraction request: provider, model, prompt, schema and catalog versions, and the page."""
    from pressmill.functions import keys

    catalog = table(spark, sf_dir, "ref_categories").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("slug")), ","), 256).alias("catalog"), F.lit(1).alias("one"))
    rows = table(spark, sf_dir, "ocr_pages").select("id", "text", F.lit(1).alias("one")).join(catalog, "one")
    return rows.select("id", keys.request_hash(F.lit("rule_based"), F.lit("rules"), F.lit("extract/v1"), F.lit("1.0"), F.col("catalog"), F.col("text")).alias("request_hash"))


@R.add(
    "f17_block_headers",
    """SELECT p.id AS page_id, u.b.id AS id, concat('[', u.b.id, ']', CASE WHEN u.b.box IS NOT NULL THEN printf(' (x=%d,y=%d,w=%d,h=%d)', u.b.box[1], u.b.box[2], u.b.box[3], u.b.box[4]) ELSE '' END, CASE WHEN u.b.confidence IS NOT NULL THEN printf(' conf=%.2f', u.b.confidence) ELSE '' END) AS header FROM ocr_pages p, unnest(p.blocks) AS u(b)""",
)
def block_headers(spark, sf_dir):
    """the header line of every block."""
    rows = blocks(spark, sf_dir).withColumn("shown", tx.two_decimals(F.col("confidence")))
    return rows.select("page_id", "id", tx.block_header(F.struct("id", "box"), F.col("shown")).alias("header"))


@R.add(
    "x11_wire_answers",
    """SELECT DISTINCT o.id, w.wire, trim(o.text) AS text, CASE WHEN o.height IS NULL THEN 'truncated' ELSE 'stop' END AS finish, o.processing_ms AS output_tokens
FROM ocr_outputs o, (VALUES ('chat'), ('generate'), ('messages')) w(wire) WHERE trim(o.text) <> '' AND NOT contains(o.text, '```')""",
)
def wire_answers(spark, sf_dir):
    """Texts sent as fenced answers in three wire formats and read back, with their end and their usage."""
    cut = F.col("height").isNull()
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    rows = table(spark, sf_dir, "ocr_outputs").where("trim(text) <> '' AND NOT contains(text, '```')").select("id", "text", "height", "processing_ms").distinct()
    bodies = {
        "messages": F.to_json(F.struct(F.array(F.struct(fenced.alias("text"))).alias("content"), F.when(cut, "max_tokens").otherwise("end_turn").alias("stop_reason"), F.struct(F.col("processing_ms").alias("output_tokens")).alias("usage"))),
        "generate": F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(fenced.alias("text"))).alias("parts")).alias("content"), F.when(cut, "MAX_TOKENS").otherwise("STOP").alias("finishReason"))).alias("candidates"), F.struct(F.col("processing_ms").alias("candidatesTokenCount")).alias("usageMetadata"))),
        "chat": F.to_json(F.struct(F.array(F.struct(F.struct(fenced.alias("content")).alias("message"), F.when(cut, "length").otherwise("stop").alias("finish_reason"))).alias("choices"), F.struct(F.col("processing_ms").alias("completion_tokens")).alias("usage"))),
    }
    out = None
    for wire, body in bodies.items():
        part = rows.select("id", F.lit(wire).alias("wire"), validation.wire_answer(body, wire).alias("a")).select("id", "wire", F.trim("a.text").alias("text"), "a.finish", "a.output_tokens")
        out = part if out is None else out.unionByName(part)
    return out


@R.add("x6_retry_outcomes", None)
def retry_outcomes(spark, sf_dir):
    """What the retry policy makes of the recorded calls of every candidate."""
    kinds = F.when(F.col("status") == "validated", "ok").when(F.col("status") == "schema_invalid", "invalid").otherwise("retryable")
    calls = call_attempts(spark, sf_dir).where("candidate_id is not null").select("candidate_id", "attempt", kinds.alias("result"))
    return validation.retry_outcomes(calls, "candidate_id")


@R.add(
    "n3_document_order",
    """WITH o AS (SELECT item_id AS doc, id, dense_rank() OVER (PARTITION BY item_id ORDER BY created_at, id) AS page, width, blocks FROM ocr_pages WHERE item_id IS NOT NULL),
b AS (SELECT doc, page, width, u.b.id AS id, u.b.box AS box FROM o, unnest(o.blocks) AS u(b)),
s AS (SELECT *, box[1] - lag(box[1]) OVER (PARTITION BY doc, page ORDER BY box IS NULL, box[1], id) AS step FROM b),
k AS (SELECT *, sum(CASE WHEN box IS NOT NULL AND step > greatest(1, floor(width * 0.15)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY box IS NULL, box[1], id ROWS UNBOUNDED PRECEDING) AS band FROM s)
SELECT doc, page::int AS page, id, row_number() OVER (PARTITION BY doc ORDER BY page, box IS NULL, band, box[2], box[1], id)::int AS position FROM k""",
)
def document_order(spark, sf_dir):
    """Blocks numbered through all pages of an item, the pages in the order they were captured."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy("created_at", "page_id")
    captured = table(spark, sf_dir, "ocr_pages").where("item_id is not null").select(F.col("item_id").alias("doc"), F.col("id").alias("page_id"), "created_at", "width", "blocks")
    rows = captured.withColumn("page", F.dense_rank().over(order).cast("int")).select("doc", "page", "width", F.explode("blocks").alias("b")).select("doc", "page", "width", F.col("b.id").alias("id"), F.col("b.box").alias("box"))
    return pages.reading_order(rows, F.col("width"), ["doc", "page"], "id").select("doc", "page", "id", "position")
