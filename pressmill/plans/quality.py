"""Queries of the core data-quality problems: prices in common units (p4) and column profiles (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.io import table
from pressmill.operators import profile, units


def catalog_codes(spark: SparkSession, sf_dir: str, code_type: str) -> tuple[str, ...]:
    """The known codes of a type; the catalog is a fixed table of some twenty rows."""
    rows = table(spark, sf_dir, "code_catalog").where(F.col("code_type") == code_type).select("code").distinct().collect()
    return tuple(sorted(r.code for r in rows if r.code is not None))


def item_checks(spark: SparkSession, sf_dir: str) -> list[profile.Check]:
    return [
        profile.Check("error_code", "code", catalog_codes(spark, sf_dir, "error")),
        profile.Check("warning_codes", "codes", catalog_codes(spark, sf_dir, "warning")),
    ]


CANDIDATE_CHECKS = [profile.Check("confidence_overall", "range", low=0.0, high=1.0)]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.wrong_amounts(table(spark, sf_dir, "extracted_prices"), table(spark, sf_dir, "unit_rates"))


def p4_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price row with its amount in whole rupees and where that came from."""
    done = units.to_common_units(table(spark, sf_dir, "extracted_prices"), table(spark, sf_dir, "unit_rates"))
    return done.select("price_id", "candidate_id", "provider", "raw", "amount", F.col("amount_common").alias("amount_lkr"), "basis")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "ingestion_items").select("id", "error_code", "warning_codes", "load_id")
    candidates = table(spark, sf_dir, "candidates").select("id", "confidence_overall", "load_id")
    found = profile.quality_issues(items, item_checks(spark, sf_dir), "ingestion_items", "id", "load_id")
    return found.unionByName(profile.quality_issues(candidates, CANDIDATE_CHECKS, "candidates", "id", "load_id"))


#: Identifiers of the store: a prefix and 26 letters and digits.
IDENTIFIER = {"ingestion_items": "[a-z]{2,4}_[0-9A-Z]{26}", "candidates": "[a-z]{2,4}_[0-9A-Z]{26}"}


def every_column(df: DataFrame, checks: list[profile.Check], patterns: dict[str, str]) -> list[profile.Check]:
    """The declared checks, and a pattern or no constraint for each of the other columns but the load itself."""
    known = {k.column: k for k in checks}
    other = lambda c: profile.Check(c, "pattern", (patterns[c],)) if c in patterns else profile.Check(c, "any")
    return [known.get(c) or other(c) for c in df.columns if c != "load_id"]


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of the two tables per load, built from the mergeable load states."""
    parts = []
    for name, checks in (("ingestion_items", item_checks(spark, sf_dir)), ("candidates", CANDIDATE_CHECKS)):
        rows = table(spark, sf_dir, name)
        checks = every_column(rows, checks, {"id": IDENTIFIER[name]})
        states = profile.compile_state(rows, checks, "load_id")
        parts.append(profile.report(states, checks, [F.lit(name).alias("tbl"), F.col("partition").cast("string").alias("load_id")]))
    return parts[0].unionByName(parts[1])


def p6_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of loads outside the control limits of the loads before them, one scan a table."""
    parts = []
    for name, checks in (("ingestion_items", item_checks(spark, sf_dir)), ("candidates", CANDIDATE_CHECKS)):
        states = profile.compile_state(table(spark, sf_dir, name), checks, "load_id")
        found = profile.anomalies(states, checks).withColumn("tbl", F.lit(name)).withColumn("load_id", F.col("partition").cast("string"))
        parts.append(found.select("tbl", "column_name", "load_id", "metric", "value", "center", "spread"))
    return parts[0].unionByName(parts[1])


QUERIES = {"p4_found": p4_found, "p4_amounts": p4_amounts, "p6_found": p6_found, "p6_profile": p6_profile, "p6_anomalies": p6_anomalies}

_P6_METRICS = """
loads AS (SELECT load_id, count(*) AS n FROM ingestion_items WHERE load_id IS NOT NULL GROUP BY load_id),
codes AS (
  SELECT DISTINCT load_id, id, rid, column_name, code FROM (
    SELECT load_id, id, rid, 'error_code' AS column_name, error_code AS code FROM items
    UNION ALL SELECT load_id, id, rid, 'warning_codes', unnest(warning_codes) FROM items)
  WHERE code IS NOT NULL AND load_id IS NOT NULL),
counts AS (SELECT column_name, code, load_id, count(*) AS n FROM codes GROUP BY ALL),
shares AS (
  SELECT k.column_name, k.code AS metric, l.load_id, coalesce(c.n, 0) / l.n AS v
  FROM (SELECT DISTINCT column_name, code FROM counts) k CROSS JOIN loads l
  LEFT JOIN counts c ON c.column_name = k.column_name AND c.code = k.code AND c.load_id = l.load_id),
metrics AS (
  SELECT 'ingestion_items' AS tbl, column_name, 'share ' || metric AS metric, load_id, v FROM shares
  UNION ALL SELECT 'ingestion_items', 'error_code', 'null', load_id, count(*) FILTER (error_code IS NULL) / count(*) FROM items GROUP BY load_id
  UNION ALL SELECT 'ingestion_items', 'warning_codes', 'null', load_id, count(*) FILTER (warning_codes IS NULL) / count(*) FROM items GROUP BY load_id
  UNION ALL SELECT 'candidates', 'confidence_overall', 'null', load_id, count(*) FILTER (confidence_overall IS NULL) / count(*) FROM candidates GROUP BY load_id
  UNION ALL SELECT 'candidates', 'confidence_overall', 'mean', load_id, avg(confidence_overall) FILTER (confidence_overall BETWEEN 0 AND 1) FROM candidates GROUP BY load_id),
usual AS (SELECT tbl, column_name, metric, median(v) AS m FROM metrics WHERE load_id IS NOT NULL GROUP BY ALL)"""

_ZEROS = "lower(raw)"
for _ in range(9):
    _ZEROS = f"regexp_replace({_ZEROS}, '([0-9][,.]?)o', '\\1' || '0', 'g')"
_WORDS = " ".join(f"WHEN '{w}' THEN {n}" for n, w in [*enumerate(units.UNIT_WORDS), *((10 * (i + 2), w) for i, w in enumerate(units.TEN_WORDS))])

SQL = {
    "p4_found": f"""
WITH r AS (SELECT DISTINCT price_id, provider, raw, amount, {_ZEROS} AS t FROM extracted_prices),
n AS (
  SELECT *, try_cast(replace(nullif(regexp_extract(t, '[0-9][0-9,]*(\\.[0-9]+)?', 0), ''), ',', '') AS decimal(20, 6)) AS digits,
    list_filter(list_transform(regexp_extract_all(t, '[a-z]+'), lambda w: CASE w {_WORDS} END), lambda x: x IS NOT NULL) AS words FROM r),
v AS (
  SELECT *, coalesce(digits, CASE WHEN len(words) > 0 THEN list_sum(words)::decimal(20, 6) END) AS x,
    CASE WHEN regexp_matches(t, 'crore') THEN 10000000 WHEN regexp_matches(t, 'million|[0-9]\\s*m$|\\bmn|\\bmil\\.|මිලියන|மில்லியன்') THEN 1000000
     WHEN regexp_matches(t, 'lakh|lks|[0-9]l$|ලක්ෂ|லட்சம்') THEN 100000 WHEN regexp_matches(t, 'thousand|[0-9]k\\b|දහස්|ஆயிரம்') THEN 1000 ELSE 1 END AS scale,
    CASE WHEN regexp_matches(t, 'usd|us\\$') THEN (SELECT factor FROM unit_rates WHERE unit_code = 'usd') WHEN regexp_matches(t, 'gbp|£') THEN (SELECT factor FROM unit_rates WHERE unit_code = 'gbp') ELSE 1 END AS rate,
    CASE WHEN regexp_matches(t, 'p\\.a|year') THEN 12 ELSE 1 END AS months,
    CASE WHEN regexp_matches(t, 'acre') THEN (SELECT factor FROM unit_rates WHERE unit_code = 'acre') WHEN regexp_matches(t, 'rood') THEN (SELECT factor FROM unit_rates WHERE unit_code = 'rood') ELSE 1 END AS perches
  FROM n),
w AS (SELECT *, round(x * scale * rate / (months * perches), 0)::bigint AS stated FROM v),
k AS (SELECT provider, ratio, count(*) AS n FROM (SELECT provider, format('{{:.3e}}', (amount / stated)::double) AS ratio FROM w WHERE stated > 0 AND amount > 0) GROUP BY ALL),
u AS (SELECT provider, max_by(ratio, n)::double AS ratio FROM k GROUP BY provider HAVING max(n) >= 0.5 * sum(n)),
d AS (SELECT w.price_id, w.amount, coalesce(w.stated, CASE WHEN coalesce(u.ratio, 1) = 1 THEN w.amount ELSE round(w.amount / u.ratio, 0)::bigint END) AS amount_lkr FROM w LEFT JOIN u USING (provider))
SELECT DISTINCT price_id, amount_lkr FROM d WHERE amount_lkr IS NOT NULL AND amount IS DISTINCT FROM amount_lkr
""",
    "p6_found": f"""
WITH items AS (SELECT *, row_number() OVER () AS rid FROM ingestion_items), {_P6_METRICS}
SELECT DISTINCT 'ingestion_items' AS tbl, 'error_code' AS column_name, id AS rec_key, 'bad_value' AS issue FROM ingestion_items
WHERE error_code IS NOT NULL AND error_code NOT IN (SELECT code FROM code_catalog WHERE code_type = 'error')
UNION
SELECT DISTINCT 'ingestion_items', 'warning_codes', id, 'bad_value' FROM ingestion_items
WHERE warning_codes IS NOT NULL AND len(warning_codes) > 0 AND (
  len(list_distinct(warning_codes)) < len(warning_codes)
  OR len(list_filter(warning_codes, lambda x: x IS NULL)) > 0
  OR NOT list_has_all((SELECT list(code) FROM code_catalog WHERE code_type = 'warning'), warning_codes))
UNION
SELECT DISTINCT 'candidates', 'confidence_overall', id, 'bad_value' FROM candidates
WHERE confidence_overall IS NOT NULL AND NOT (confidence_overall BETWEEN 0 AND 1)
UNION
SELECT DISTINCT m.tbl, m.column_name, cast(m.load_id AS varchar), 'drift' FROM metrics m JOIN usual u
ON m.tbl = u.tbl AND m.column_name = u.column_name AND m.metric = u.metric
WHERE m.load_id IS NOT NULL AND abs(m.v - u.m) >= 0.25 - 1e-12
"""
}
