"""The review queue: filters, joins, ordering, counts, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.functions import geometry
from pressmill.io import table
from pressmill.operators import engines, records
from pressmill.plans.registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

CANDIDATES = "cands AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, ingested_at DESC NULLS LAST, load_id DESC NULLS LAST) = 1)"
PAGES = "pages AS (SELECT item_id, max_by(id, (created_at, id)) AS page_id, max_by(mean_confidence, (created_at, id)) AS page_confidence, max_by(block_count, (created_at, id)) AS block_count FROM ocr_pages GROUP BY item_id)"


def candidates_now(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest version of every candidate."""
    wanted = dict.fromkeys(("id", "version", "ingested_at", "load_id", *columns))
    return records.latest(table(spark, sf_dir, "candidates").select(*wanted), ["id"], ["version", "ingested_at", "load_id"])


def filtered(rows: DataFrame, states: list[str] | None = None, batch: str | None = None, item: str | None = None, status: str | None = None, category: str | None = None, warning: str | None = None, low: float | None = None, high: float | None = None, text: str | None = None) -> DataFrame:
    """Every filter is optional and all must hold; a null never matches a range; ``text`` is an ILIKE pattern
    on title, description and location (its % and _ are wildcards)."""
    if states:
        rows = rows.where(F.col("candidate_state").isin(*states))
    for column, value in (("batch_id", batch), ("item_id", item), ("status", status), ("category", category)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if warning is not None:
        rows = rows.where(F.array_contains("warning_codes", warning) | F.array_contains("item_warnings", warning))
    if low is not None:
        rows = rows.where(F.col("confidence_overall") >= low)
    if high is not None:
        rows = rows.where(F.col("confidence_overall") <= high)
    if text is not None:
        rows = rows.where(F.ilike(F.col("title"), F.lit(f"%{text}%")) | F.ilike(F.col("description"), F.lit(f"%{text}%")) | F.ilike(F.col("location"), F.lit(f"%{text}%")))
    return rows


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates joined to their items; both sides are latest states, the join is on the item id."""
    from pressmill.plans.ingestion import items_now

    items = items_now(spark, sf_dir, "warning_codes", "status").select(F.col("id").alias("item_id"), F.col("warning_codes").alias("item_warnings"), F.col("status").alias("item_status"))
    rows = candidates_now(spark, sf_dir, "item_id", "batch_id", "status", "candidate_state", "category", "confidence_overall", "warning_codes", "title", "description", "location")
    return rows.join(items, "item_id")


ITEMS = "items AS (SELECT id AS item_id, warning_codes AS item_warnings, status AS item_status FROM ingestion_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, load_id DESC NULLS LAST) = 1)"


@R.add(
    "l1_review_page",
    f"""WITH {CANDIDATES}, {ITEMS} SELECT c.id, c.status, round(c.confidence_overall, 4) AS confidence, c.category FROM cands c JOIN items i USING (item_id)
WHERE c.candidate_state IN ('linked', 'pending_publish') AND c.status = 'pending_review' ORDER BY c.confidence_overall ASC NULLS LAST, c.id LIMIT 25 OFFSET 25""",
)
def review_page(spark, sf_dir):
    """L1: the second page of the queue, least certain first, unknown last (a top-k, not a full sort)."""
    rows = filtered(queue(spark, sf_dir), ["linked", "pending_publish"], status="pending_review")
    return rows.orderBy(F.asc_nulls_last("confidence_overall"), "id").offset(25).limit(25).select("id", "status", F.round("confidence_overall", 4).alias("confidence"), "category")


@R.add("a5_queue_breakdown", f"WITH {CANDIDATES}, {ITEMS} SELECT c.status, count(*) AS n, count(*) FILTER (c.candidate_state = 'linked') AS n_linked FROM cands c JOIN items i USING (item_id) WHERE c.category = 'vehicles' GROUP BY c.status")
def queue_breakdown(spark, sf_dir):
    """A5: the status breakdown under the page's filters without its status."""
    return filtered(queue(spark, sf_dir), category="vehicles").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("candidate_state") == "linked").alias("n_linked"))


@R.add(
    "w2_warned",
    f"""WITH {CANDIDATES}, {ITEMS} SELECT c.id, c.status FROM cands c JOIN items i USING (item_id)
WHERE coalesce(list_contains(c.warning_codes, 'OCR_LOW_CONFIDENCE'), false) OR coalesce(list_contains(i.item_warnings, 'OCR_LOW_CONFIDENCE'), false)""",
)
def warned(spark, sf_dir):
    """The warning on either side."""
    return filtered(queue(spark, sf_dir), warning="OCR_LOW_CONFIDENCE").select("id", "status")


@R.add("w3_confidence_range", f"WITH {CANDIDATES}, {ITEMS} SELECT c.id FROM cands c JOIN items i USING (item_id) WHERE c.confidence_overall >= 0.5 AND c.confidence_overall <= 0.75")
def confidence_range(spark, sf_dir):
    return filtered(queue(spark, sf_dir), low=0.5, high=0.75).select("id")


@R.add("w4_text_search", f"WITH {CANDIDATES}, {ITEMS} SELECT c.id FROM cands c JOIN items i USING (item_id) WHERE c.title ILIKE '%house%' OR c.description ILIKE '%house%' OR c.location ILIKE '%house%'")
def text_search(spark, sf_dir):
    return filtered(queue(spark, sf_dir), text="house").select("id")


@R.add(
    "view3_candidate",
    f"""WITH {CANDIDATES}, {ITEMS} SELECT c.id, c.item_id, c.batch_id, c.status, i.item_status, c.version, c.category,
 list_aggregate(list_sort(list_distinct(list_filter(list_concat(coalesce(c.warning_codes, []), coalesce(i.item_warnings, [])), lambda x: x IS NOT NULL))), 'string_agg', ',') AS warnings
FROM cands c JOIN items i USING (item_id)""",
)
def candidate_view(spark, sf_dir):
    """Candidates flattened with the warnings of both sides merged (shown sorted, for comparison)."""
    none = F.array().cast("array<string>")
    merged = F.array_compact(F.array_distinct(F.concat(F.coalesce("warning_codes", none), F.coalesce("item_warnings", none))))
    text = F.when(F.size(merged) > 0, F.array_join(F.array_sort(merged), ","))
    return queue(spark, sf_dir).select("id", "item_id", "batch_id", "status", "item_status", "version", "category", text.alias("warnings"))


@R.add(
    "view5_evidence",
    f"""WITH {CANDIDATES}, {PAGES} SELECT c.id, p.page_id, p.block_count, round(p.page_confidence, 4) AS page_confidence, count(DISTINCT e.price_id) AS n_prices
FROM cands c LEFT JOIN pages p ON p.item_id = c.item_id LEFT JOIN extracted_prices e ON e.candidate_id = c.id GROUP BY ALL""",
)
def evidence_view(spark, sf_dir):
    """A candidate with its page and the prices read from it, where they exist; many-sides are aggregated first."""
    order = F.struct("created_at", "id")
    pages = table(spark, sf_dir, "ocr_pages").groupBy("item_id").agg(F.max_by("id", order).alias("page_id"), F.max_by("mean_confidence", order).alias("page_confidence"), F.max_by("block_count", order).alias("block_count"))
    prices = table(spark, sf_dir, "extracted_prices").groupBy(F.col("candidate_id").alias("id")).agg(F.countDistinct("price_id").alias("n_prices"))
    rows = candidates_now(spark, sf_dir, "item_id").join(pages, "item_id", "left").join(prices, "id", "left")
    return rows.select("id", "page_id", "block_count", F.round("page_confidence", 4).alias("page_confidence"), F.coalesce("n_prices", F.lit(0)).alias("n_prices"))


@R.add(
    "n6_siblings",
    f"""WITH {CANDIDATES} SELECT item_id, id, row_number() OVER w::int AS position, count(*) OVER (PARTITION BY item_id) AS n_siblings, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id
FROM cands WHERE item_id IS NOT NULL WINDOW w AS (PARTITION BY item_id ORDER BY candidate_index ASC NULLS LAST, id)""",
)
def siblings(spark, sf_dir):
    """The place of a candidate among those of its page."""
    rows = candidates_now(spark, sf_dir, "item_id", "candidate_index").where("item_id is not null")
    return records.positions(rows, "item_id", [F.asc_nulls_last("candidate_index"), F.asc("id")], "id")


@R.add("a8_candidate_counts", f"WITH {CANDIDATES} SELECT item_id, generation, count(*) AS n, bool_or(status IN ('active', 'rejected', 'sold')) AS has_decided FROM cands GROUP BY ALL")
def candidate_counts(spark, sf_dir):
    rows = candidates_now(spark, sf_dir, "item_id", "generation", "status")
    return rows.groupBy("item_id", "generation").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status").isin("active", "rejected", "sold")).alias("has_decided"))


@R.add("j9_has_provenance", "SELECT DISTINCT i.id FROM ingestion_items i WHERE EXISTS (SELECT 1 FROM candidates c WHERE c.item_id = i.id AND c.provenance_id IS NOT NULL)")
def has_provenance(spark, sf_dir):
    with_it = table(spark, sf_dir, "candidates").where("provenance_id is not null").select(F.col("item_id").alias("id"))
    return table(spark, sf_dir, "ingestion_items").select("id").join(with_it, "id", "left_semi").distinct()


@R.add(
    "j12_image_keys",
    f"WITH {CANDIDATES} SELECT c.id, coalesce(a.storage_key, '') AS image_key FROM cands c LEFT JOIN media_assets a ON a.id = c.source_asset_id",
)
def image_keys(spark, sf_dir):
    """The image of a candidate, empty when there is none."""
    assets = table(spark, sf_dir, "media_assets").select(F.col("id").alias("source_asset_id"), "storage_key")
    return candidates_now(spark, sf_dir, "source_asset_id").join(assets, "source_asset_id", "left").select("id", F.coalesce("storage_key", F.lit("")).alias("image_key"))


@R.add(
    "j10_category_lookup",
    f"""WITH {CANDIDATES}, forms AS (SELECT slug, unnest(list_concat([slug, label], aliases)) AS f FROM ref_categories),
k AS (SELECT min(slug) AS slug, trim(regexp_replace(translate(lower(f), '-_', '  '), '\\s+', ' ', 'g')) AS key FROM forms GROUP BY 2)
SELECT c.id, coalesce(k.slug, 'other') AS category, k.slug IS NULL AS unmapped FROM cands c LEFT JOIN k ON k.key = trim(regexp_replace(translate(lower(c.category), '-_', '  '), '\\s+', ' ', 'g'))""",
)
def category_lookup(spark, sf_dir):
    """The exact lookup by slug, label or alias; what is not found is 'other' and unmapped. The catalog is a fixed table of nine rows."""
    from pressmill.functions.text import category_key

    forms = table(spark, sf_dir, "ref_categories").select("slug", F.explode(F.concat(F.array("slug", "label"), "aliases")).alias("f"))
    book = forms.groupBy(category_key(F.col("f")).alias("key")).agg(F.min("slug").alias("slug"))
    rows = candidates_now(spark, sf_dir, "category").withColumn("key", category_key(F.col("category")))
    return rows.join(book, "key", "left").select("id", F.coalesce("slug", F.lit("other")).alias("category"), F.col("slug").isNull().alias("unmapped"))


@R.add("l5_catalog", "SELECT code, code_type FROM code_catalog UNION ALL SELECT slug, 'category' FROM ref_categories ORDER BY 1")
def catalog(spark, sf_dir):
    """Listed codes in order."""
    return table(spark, sf_dir, "code_catalog").select("code", "code_type").unionByName(table(spark, sf_dir, "ref_categories").select(F.col("slug").alias("code"), F.lit("category").alias("code_type"))).orderBy("code")


@R.add(
    "g5_confidence_labels",
    f"""WITH {CANDIDATES} SELECT id, CASE WHEN isnan(confidence_overall) THEN 'low' WHEN confidence_overall >= 0.85 THEN 'high' WHEN confidence_overall >= 0.60 THEN 'medium' ELSE 'low' END AS label,
 CASE lower(confidence_label) WHEN 'high' THEN 0.9 WHEN 'low' THEN 0.4 ELSE 0.75 END::double AS stated FROM cands""",
)
def confidence_labels(spark, sf_dir):
    """G-5 over every candidate: NaN and null are low."""
    rows = candidates_now(spark, sf_dir, "confidence_overall", "confidence_label")
    return rows.select("id", geometry.confidence_label(F.col("confidence_overall")).alias("label"), geometry.label_confidence(F.col("confidence_label")).alias("stated"))


@R.add(
    "n8_capped_candidates",
    f"""WITH {CANDIDATES}, p AS (SELECT id, item_id, title, row_number() OVER (PARTITION BY item_id ORDER BY candidate_index ASC NULLS LAST, id) - 1 AS pos FROM cands WHERE item_id IS NOT NULL),
k AS (SELECT * FROM p WHERE pos < 3 AND title IS NOT NULL AND title <> '')
SELECT id, item_id, (row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1)::int AS new_index FROM k""",
)
def capped_candidates(spark, sf_dir):
    """The first three candidates of a page (the cap is the feature), then those with a title numbered anew."""
    w = Window.partitionBy("item_id").orderBy(F.asc_nulls_last("candidate_index"), "id")
    rows = candidates_now(spark, sf_dir, "item_id", "candidate_index", "title").where("item_id is not null").withColumn("pos", F.row_number().over(w) - 1)
    kept = rows.where("pos < 3").where("title <> ''")
    return kept.select("id", "item_id", (F.row_number().over(Window.partitionBy("item_id").orderBy("pos")) - 1).alias("new_index"))


@R.add("w11_public_feed", f"WITH {CANDIDATES} SELECT id, epoch_us(created_at) AS created_us FROM cands WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 50")
def public_feed(spark, sf_dir):
    """The newest active advertisements (a feed page)."""
    rows = candidates_now(spark, sf_dir, "status", "created_at").where("status = 'active'")
    return rows.orderBy(F.desc("created_at"), "id").limit(50).select("id", F.unix_micros("created_at").alias("created_us"))


@R.add("w14_operator_ids", "SELECT created_by AS operator, regexp_full_match(created_by, '[A-Za-z0-9._@+-]{1,64}') AS accepted, count(*) AS n FROM ingestion_batches WHERE created_by IS NOT NULL GROUP BY ALL")
def operator_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "ingestion_batches").where("created_by is not null")
    return rows.groupBy(F.col("created_by").alias("operator"), engines.operator_id(F.col("created_by")).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@R.add("x17_origins", "SELECT provider, CASE WHEN provider IS NULL THEN 'legacy_import' WHEN contains(provider, 'rule') THEN 'ocr_heuristic' ELSE 'llm_extraction' END AS origin, count(*) AS n FROM extracted_prices GROUP BY ALL")
def origins(spark, sf_dir):
    return table(spark, sf_dir, "extracted_prices").groupBy("provider", engines.origin(F.col("provider")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "x14_legacy_blocks",
    """SELECT DISTINCT id, CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END AS n_blocks, CASE WHEN trim(text) <> '' THEN CASE lower(confidence) WHEN 'high' THEN 0.9 WHEN 'low' THEN 0.4 ELSE 0.75 END::double END AS confidence,
 CASE WHEN trim(text) <> '' THEN len(string_split(text, chr(10)))::int END AS n_lines FROM ocr_outputs""",
)
def legacy_blocks(spark, sf_dir):
    """Every legacy output as a block, none for an empty one."""
    rows = engines.legacy_blocks(table(spark, sf_dir, "ocr_outputs"))
    return rows.select("id", F.size("blocks").alias("n_blocks"), F.get("blocks", F.lit(0))["confidence"].alias("confidence"), F.get("blocks", F.lit(0))["line_count"].alias("n_lines")).distinct()


@R.add("view6_assets", "SELECT DISTINCT source_asset_id AS asset_id, count(DISTINCT c.id) AS n_candidates FROM candidates c JOIN media_assets a ON a.id = c.source_asset_id GROUP BY source_asset_id")
def asset_view(spark, sf_dir):
    """Assets with the candidates read from them."""
    counts = table(spark, sf_dir, "candidates").groupBy(F.col("source_asset_id").alias("asset_id")).agg(F.countDistinct("id").alias("n_candidates"))
    return counts.join(table(spark, sf_dir, "media_assets").select(F.col("id").alias("asset_id")).distinct(), "asset_id", "left_semi")
