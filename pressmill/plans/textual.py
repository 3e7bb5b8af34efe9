"""Text functions over descriptions, titles, documents and phones."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import keys
from pressmill.functions import text as tx
from pressmill.io import table
from pressmill.plans.registry import Registry
from pressmill.plans.review import CANDIDATES, candidates_now

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("f1_sanitized", r"""SELECT id, regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B-\x1F\x7F-\x9F‪-‮⁦-⁩‎‏]', '', 'g') AS text FROM ocr_pages""".replace(r"‪-‮⁦-⁩‎‏", "‪-‮⁦-⁩‎‏"))
def sanitized(spark, sf_dir):
    return table(spark, sf_dir, "ocr_pages").select("id", tx.sanitize(F.col("text")).alias("text"))


@R.add("f2_escaped", "SELECT doc_id, replace(replace(concat('<ocr_blocks>', text, '</ocr_blocks>'), '</ocr_blocks>', '<\\/ocr_blocks>'), '<ocr_blocks>', '<\\ocr_blocks>') AS escaped FROM documents")
def escaped(spark, sf_dir):
    """F2 on texts that hold the delimiters."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.escape_delimiters(F.concat(F.lit(tx.OPEN_TAG), "text", F.lit(tx.CLOSE_TAG))).alias("escaped"))


@R.add("f3_cleaned", f"WITH {CANDIDATES} SELECT id, nullif(regexp_replace(regexp_replace(nfc_normalize(title), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F{tx.BIDI}]', '', 'g'), '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g'), '') AS title FROM cands")
def cleaned(spark, sf_dir):
    """titles sanitised and stripped; what is then empty is null."""
    return candidates_now(spark, sf_dir, "title").select("id", tx.clean(F.col("title")).alias("title"))


_NATIONAL = """CASE WHEN starts_with(d, '94') AND length(d) = 11 THEN '0' || d[3:] WHEN length(d) = 9 AND NOT starts_with(d, '0') THEN '0' || d ELSE d END"""


_DIGITS = r"array_to_string(regexp_extract_all(p, '\p{Nd}+'), '')"
_FORM = rf"""CASE WHEN regexp_full_match(CASE WHEN starts_with({_DIGITS}, '94') AND length({_DIGITS}) = 11 THEN '0' || ({_DIGITS})[3:] WHEN length({_DIGITS}) = 9 AND NOT starts_with({_DIGITS}, '0') THEN '0' || {_DIGITS} ELSE {_DIGITS} END, '0\p{{Nd}}{{8,9}}')
 THEN CASE WHEN starts_with({_DIGITS}, '94') AND length({_DIGITS}) = 11 THEN '0' || ({_DIGITS})[3:] WHEN length({_DIGITS}) = 9 AND NOT starts_with({_DIGITS}, '0') THEN '0' || {_DIGITS} ELSE {_DIGITS} END END"""


@R.add(
    "f4_phones",
    rf"""WITH {CANDIDATES}, p AS (SELECT id, unnest(phones) AS raw, generate_subscripts(phones, 1) AS n FROM cands),
d AS (SELECT id, n, raw, {_NATIONAL} AS d2 FROM (SELECT id, n, raw, array_to_string(regexp_extract_all(raw, '\p{{Nd}}+'), '') AS d FROM p))
SELECT id, n::int AS n, CASE WHEN regexp_full_match(d2, '0\p{{Nd}}{{8,9}}') THEN d2 END AS phone FROM d""",
)
def phones(spark, sf_dir):
    """every entry in national form, null where it is no single number."""
    rows = candidates_now(spark, sf_dir, "phones").select("id", F.posexplode("phones").alias("n", "raw"))
    return rows.select("id", (F.col("n") + 1).alias("n"), tx.normalize_phone(F.col("raw")).alias("phone"))


_READ = rf"list_transform(phones, lambda p: CASE WHEN p IS NULL THEN NULL ELSE coalesce({_FORM}, nullif(trim(p), '')) END)"


@R.add(
    "f5_phone_lists",
    f"""WITH {CANDIDATES}, r AS (SELECT id, phones, list_filter({_READ}, lambda x: x IS NOT NULL) AS l FROM cands WHERE phones IS NOT NULL)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS phones, len(list_filter(phones, lambda p: p IS NOT NULL AND {_FORM} IS NULL)) > 0 AS unparseable FROM r""",
)
def phone_lists(spark, sf_dir):
    """the readable numbers of a list in national form, others as text, distinct in order."""
    rows = candidates_now(spark, sf_dir, "phones").where("phones is not null").select("id", tx.normalize_phones(F.col("phones")).alias("p"))
    return rows.select("id", F.array_join("p.phones", "|").alias("phones"), "p.unparseable")


@R.add("f13_phone_scan", r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '((?:\+?94|0)\d{8,9})') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS phones FROM l""")
def phone_scan(spark, sf_dir):
    """the distinct numbers of every document in the order of their first mention; null texts give null."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.scan_phones(F.col("text")), ",").alias("phones"))


@R.add("f12_keyword_category", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{k}'" for k, w in tx.KEYWORDS.items()) + " ELSE 'Other' END AS category FROM documents")
def keyword_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.keyword_category(F.col("text")).alias("category"))


@R.add("f9_prices", r"""SELECT price_id, coalesce(replace(nullif(regexp_extract(raw, '(?i)(?:rs\.?|රු\.?)\s*[0-9,]+', 0), ''), 'Rs ', 'Rs. '), 'Price pending') AS price FROM (SELECT DISTINCT price_id, raw FROM extracted_prices)""")
def prices(spark, sf_dir):
    """the first price in a raw text; a missing text has a pending one."""
    return table(spark, sf_dir, "extracted_prices").select("price_id", "raw").distinct().select("price_id", tx.first_price(F.col("raw")).alias("price"))


@R.add(
    "f10_titles",
    rf"""WITH l AS (SELECT id, text, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0B\x0C\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda s: regexp_replace(s, '^[ :\-]+|[ :\-]+$', '', 'g')), lambda s: s <> '') AS ls FROM ocr_pages), j AS (SELECT *, array_to_string(ls, ' ') AS t FROM l)
SELECT id, left(coalesce(list_filter(ls, lambda s: NOT regexp_matches(s, '(?i)(?:rs\.?|රු\.?)\s*[0-9,]+') AND length(s) > 3)[1], 'Newspaper advertisement'), 120) AS title,
 coalesce(nullif(trim(regexp_extract(t, '(?i)\b(?:{'|'.join(tx.CITIES)})\s*\d{{0,2}}\b', 0)), ''), {', '.join(f"CASE WHEN contains(lower(t), '{c.lower()}') THEN '{c}' END" for c in tx.CITIES)}, 'Location pending') AS location FROM j""",
)
def titles(spark, sf_dir):
    """the rule-based title and place of every page."""
    lines = tx.joined_lines(F.col("text"))
    return table(spark, sf_dir, "ocr_pages").select("id", tx.first_title(lines).alias("title"), tx.first_location(F.array_join(lines, " ")).alias("location"))


@R.add(
    "f15_script_language",
    """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[඀-෿]')) AS si, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents)
SELECT doc_id, CASE WHEN si > 0 AND en > 0 AND least(si, en) / greatest(si, en) > 0.25 THEN 'mixed' WHEN si > 0 AND si > en THEN 'si' WHEN en > 0 THEN 'en' WHEN si > 0 THEN 'si' ELSE 'unknown' END AS language FROM c""",
)
def script_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.script_language(F.col("text")).alias("language"))


@R.add("f14_data_urls", "SELECT doc_id, strlen(text)::bigint AS n_bytes, sha256(text) AS digest FROM documents")
def data_urls(spark, sf_dir):
    """Texts encoded as data URLs, decoded again, measured and hashed."""
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    body = tx.decode_data_url(F.regexp_replace(url, r"\s", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body, 256).alias("digest"))


@R.add("f20_ids", "SELECT split_part(id, '_', 1) AS prefix, count(*) AS n, count(*) FILTER (starts_with(id, 'adv_')) AS n_ads FROM candidates GROUP BY 1")
def ids(spark, sf_dir):
    rows = table(spark, sf_dir, "candidates")
    return rows.groupBy(tx.id_prefix(F.col("id")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith(F.col("id"), F.lit("adv_"))).alias("n_ads"))


@R.add("f20_made_ids", "SELECT doc_id, concat('itm_', upper(sha256(concat_ws('|', source, doc_id::varchar))[1:26])) AS made FROM documents")
def made_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.make_id("itm", F.col("source"), F.col("doc_id").cast("string")).alias("made"))


@R.add("f22_line_counts", "SELECT id, len(string_split(text, chr(10)))::int AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))::int AS n_filled FROM ocr_outputs")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "ocr_outputs").select("id", tx.line_count(F.col("text")).alias("n_lines"), F.size(F.filter(F.split("text", "\n"), lambda s: s != "")).alias("n_filled"))


@R.add("k4_request_hashes", "SELECT id, sha256(concat_ws('|', engine, engine_version, preprocess_version, sha256(text))) AS request_hash FROM ocr_pages")
def request_hashes(spark, sf_dir):
    """K4, K5: the request hash of a page under its engine settings."""
    return table(spark, sf_dir, "ocr_pages").select("id", keys.request_hash(F.col("engine"), F.col("engine_version"), F.col("preprocess_version"), F.sha2("text", 256)).alias("request_hash"))


@R.add("r1_distinct_phones", f"WITH {CANDIDATES} SELECT id, array_to_string(list_transform(list_filter(phones, lambda x, i: x IS NOT NULL AND list_position(phones, x) = i OR x IS NULL AND len(list_filter(phones[1:i], lambda y: y IS NULL)) = 1), lambda x: coalesce(x, '-')), '|') AS phones, len(phones)::int AS n FROM cands WHERE phones IS NOT NULL")
def distinct_phones(spark, sf_dir):
    """R1 over every list, in order; null entries are one value (shown as a dash)."""
    rows = candidates_now(spark, sf_dir, "phones").where("phones is not null")
    return rows.select("id", F.array_join(F.array_distinct("phones"), "|", "-").alias("phones"), F.size("phones").alias("n"))


@R.add(
    "r3_changed_fields",
    """WITH v AS (SELECT id, version, status, category, location, lag(id) OVER w AS before_id, lag(status) OVER w AS s0, lag(category) OVER w AS c0, lag(location) OVER w AS l0
 FROM (SELECT DISTINCT id, version, status, category, location FROM candidates) WINDOW w AS (PARTITION BY id ORDER BY version, status, category, location))
SELECT id, version, array_to_string(list_filter([CASE WHEN status IS NOT NULL AND status IS DISTINCT FROM s0 THEN 'status' END, CASE WHEN category IS NOT NULL AND category IS DISTINCT FROM c0 THEN 'category' END,
 CASE WHEN location IS NOT NULL AND location IS DISTINCT FROM l0 THEN 'location' END], lambda x: x IS NOT NULL), ',') AS changed FROM v WHERE before_id IS NOT NULL""",
)
def changed_fields(spark, sf_dir):
    """What a later version of a candidate changed; versions of one id are few."""
    from pyspark.sql import Window

    fields = ["status", "category", "location"]
    rows = table(spark, sf_dir, "candidates").select("id", "version", *fields).distinct()
    w = Window.partitionBy("id").orderBy(F.asc_nulls_last("version"), *[F.asc_nulls_last(c) for c in fields])
    seen = rows.select("*", F.lag("id").over(w).alias("before_id"), *[F.lag(c).over(w).alias(f"{c}_0") for c in fields]).where("before_id is not null")
    changed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"{c}_0")), c) for c in fields]))
    return seen.select("id", "version", F.array_join(changed, ",").alias("changed"))


@R.add("r5_count_maps", "SELECT id, array_to_string(list_sort(map_keys(map_from_entries(list_filter(map_entries(status_counts), lambda e: e.value > 0)))), ',') AS filled FROM (SELECT DISTINCT id, status_counts FROM ingestion_batches)")
def count_maps(spark, sf_dir):
    """The keys of a batch's cached counts that are above zero."""
    rows = table(spark, sf_dir, "ingestion_batches").select("id", F.array_join(F.array_sort(F.map_keys(F.map_filter("status_counts", lambda k, v: v > 0))), ",").alias("filled"))
    return rows.distinct()
