"""Pages: blocks, boxes, reading order, regions, budgets, validation, the rule-based pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.functions import geometry as g
from pressmill.functions import text as tx
from pressmill.io import arrow_rows, table
from pressmill.operators import pages, records, validation
from pressmill.plans.registry import Registry
from pressmill.session import durable

R = Registry()
QUERIES, SQL = R.queries, R.sql

BLOCKS = "b AS (SELECT p.id AS page_id, p.width AS page_width, p.height AS page_height, u.b.id AS id, u.b.text AS text, u.b.box AS box, u.b.confidence AS confidence, u.b.line_count AS line_count, u.b.source_ref AS source_ref FROM ocr_pages p, unnest(p.blocks) AS u(b))"


def blocks(spark: SparkSession, sf_dir: str, *page_columns: str) -> DataFrame:
    """One row per block of every captured page."""
    rows = table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("page_id"), F.col("width").alias("page_width"), F.col("height").alias("page_height"), *page_columns, F.explode("blocks").alias("b"))
    return rows.select("page_id", "page_width", "page_height", *page_columns, "b.*")


@R.add("a16_block_stats", "SELECT id, len(blocks)::int AS n_blocks, list_max(list_transform(blocks, lambda b: b.id)) AS max_id, block_count = len(blocks) AS count_holds FROM ocr_pages")
def block_stats(spark, sf_dir):
    return table(spark, sf_dir, "ocr_pages").select("id", F.size("blocks").alias("n_blocks"), F.array_max(F.transform("blocks", lambda b: b["id"])).alias("max_id"), (F.col("block_count") == F.size("blocks")).alias("count_holds"))


@R.add("a14_page_text", "SELECT id, array_to_string(list_transform(list_sort(list_transform(blocks, lambda b: {'id': b.id, 'text': b.text})), lambda x: x.text), chr(10) || chr(10)) AS text FROM ocr_pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "ocr_pages").select("id", pages.page_text(F.col("blocks")).alias("text"))


@R.add("a11_page_confidence", None)
def page_confidence(spark, sf_dir):
    """A11, G-6: the page confidence computed anew, beside the stored one, with the page's warnings."""
    p = table(spark, sf_dir, "ocr_pages").select("id", "text", "mean_confidence", pages.page_confidence(F.col("blocks")).alias("confidence"))
    return p.select("id", "confidence", "mean_confidence", g.page_warnings(F.col("text"), F.col("confidence")).alias("warnings"))


@R.add("g1_boxes", f"WITH {BLOCKS} SELECT page_id, id, box[1] + box[3] AS right_edge, box[2] + box[4] AS bottom_edge, box[3] * box[4] AS area FROM b WHERE box IS NOT NULL")
def boxes(spark, sf_dir):
    box = F.col("box")
    return blocks(spark, sf_dir).where("box is not null").select("page_id", "id", g.right(box).alias("right_edge"), g.bottom(box).alias("bottom_edge"), g.area(box).alias("area"))


@R.add(
    "g2_next_overlap",
    f"""WITH {BLOCKS}, n AS (SELECT page_id, id, box AS a, lead(box) OVER (PARTITION BY page_id ORDER BY id) AS c FROM b),
o AS (SELECT page_id, id, a, c, greatest(least(a[1] + a[3], c[1] + c[3]) - greatest(a[1], c[1]), 0) AS w, greatest(least(a[2] + a[4], c[2] + c[4]) - greatest(a[2], c[2]), 0) AS h FROM n WHERE a IS NOT NULL AND c IS NOT NULL)
SELECT page_id, id, w * h AS shared, round(w * h / (a[3] * a[4] + c[3] * c[4] - w * h), 6) AS iou, round(w / least(a[3], c[3]), 6) AS overlap, greatest(least(a[1], c[1]), 0) AS union_left, greatest(a[1] + a[3], c[1] + c[3]) - least(a[1], c[1]) AS union_width FROM o""",
)
def next_overlap(spark, sf_dir):
    """G-2, G-3, A12: every block against the next of its page."""
    rows = blocks(spark, sf_dir).select("page_id", "id", F.col("box").alias("a"), F.lead("box").over(Window.partitionBy("page_id").orderBy("id")).alias("c")).where("a is not null and c is not null")
    a, c = F.col("a"), F.col("c")
    return rows.select("page_id", "id", g.shared_area(a, c).alias("shared"), F.round(g.iou(a, c), 6).alias("iou"), F.round(g.overlap_ratio(a, c), 6).alias("overlap"), g.side(g.union(a, c), 0).alias("union_left"), g.side(g.union(a, c), 2).alias("union_width"))


@R.add("g4_padded", f"WITH {BLOCKS} SELECT page_id, id, array_to_string([greatest(box[1] - 8, 0), greatest(box[2] - 8, 0), greatest(least(box[1] + box[3] + 8, page_width), greatest(box[1] - 8, 0)) - greatest(box[1] - 8, 0), greatest(least(box[2] + box[4] + 8, page_height), greatest(box[2] - 8, 0)) - greatest(box[2] - 8, 0)], ',') AS box FROM b WHERE box IS NOT NULL")
def padded(spark, sf_dir):
    return blocks(spark, sf_dir).where("box is not null").select("page_id", "id", F.array_join(g.padded(F.col("box"), F.col("page_width"), F.col("page_height"), 8).cast("array<string>"), ",").alias("box"))


@R.add("g9_polygons", f"WITH {BLOCKS} SELECT page_id, id, CASE WHEN confidence IS NOT NULL AND line_count > 1 THEN array_to_string([box[1] - 3, box[2], box[3] + 8, box[4] + 2], ',') END AS box FROM b WHERE box IS NOT NULL")
def polygons(spark, sf_dir):
    """G-9: the bounding box of tilted corner polygons; a polygon without an area (here: of blocks of one line or without a
    confidence, whose corners are put on one line) has none."""
    box = F.col("box")
    flat = F.col("confidence").isNull() | (F.col("line_count") <= 1)
    below = F.when(flat, g.side(box, 1)).otherwise(g.bottom(box))
    tilt = F.when(flat, 0).otherwise(2)
    corners = F.array(F.array(g.side(box, 0), g.side(box, 1)), F.array(g.right(box) + 5, g.side(box, 1) + tilt), F.array(g.right(box), below + tilt), F.array(g.side(box, 0) - 3, below))
    return blocks(spark, sf_dir).where("box is not null").select("page_id", "id", F.array_join(g.polygon_box(corners).cast("array<string>"), ",").alias("box"))


@R.add("a12_page_extent", f"WITH {BLOCKS} SELECT page_id, min(box[1]) AS left_edge, min(box[2]) AS top_edge, max(box[1] + box[3]) AS right_edge, max(box[2] + box[4]) AS bottom_edge, count(box) AS n_placed FROM b GROUP BY page_id")
def page_extent(spark, sf_dir):
    box = F.col("box")
    return blocks(spark, sf_dir).groupBy("page_id").agg(F.min(g.side(box, 0)).alias("left_edge"), F.min(g.side(box, 1)).alias("top_edge"), F.max(g.right(box)).alias("right_edge"), F.max(g.bottom(box)).alias("bottom_edge"), F.count("box").alias("n_placed"))


@R.add("a17_line_heights", f"WITH {BLOCKS} SELECT page_id, median(box[4] / line_count) AS height FROM b WHERE box IS NOT NULL AND line_count > 0 GROUP BY page_id")
def line_heights(spark, sf_dir):
    return blocks(spark, sf_dir).where("box is not null and line_count > 0").groupBy("page_id").agg(F.median(g.side(F.col("box"), 3) / F.col("line_count")).alias("height"))


@R.add(
    "n1_reading_order",
    f"""WITH {BLOCKS}, s AS (SELECT *, box[1] - lag(box[1]) OVER (PARTITION BY page_id ORDER BY box IS NULL, box[1], id) AS step FROM b),
k AS (SELECT *, sum(CASE WHEN box IS NOT NULL AND step > greatest(1, floor(page_width * 0.15)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY box IS NULL, box[1], id ROWS UNBOUNDED PRECEDING) AS band FROM s)
SELECT page_id, id, band::bigint AS band, row_number() OVER (PARTITION BY page_id ORDER BY box IS NULL, band, box[2], box[1], id)::int AS position FROM k""",
)
def reading_order(spark, sf_dir):
    """N1-N4 over captured blocks: gaps and islands, no loop."""
    ordered = pages.reading_order(blocks(spark, sf_dir), F.col("page_width"), ["page_id"], "id")
    return ordered.select("page_id", "id", F.col("band").cast("bigint").alias("band"), "position")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rows as an engine emits them, made from block texts: eight pixels a letter, 24 a line."""
    lines = blocks(spark, sf_dir).select("page_id", "id", "box", "confidence", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    each = lines.select("*", F.posexplode(F.split("s", " ")).alias("word", "token"))
    left, top = F.coalesce(g.side(F.col("box"), 0), F.lit(0)), F.coalesce(g.side(F.col("box"), 1), F.lit(0))
    return each.select(
        F.col("page_id").alias("doc"), F.lit(1).alias("page"), F.col("id").alias("block"), F.lit(1).alias("paragraph"), "line", "word", F.col("token").alias("text"),
        (left + F.col("word") * 8).alias("left"), (top + F.col("line") * 24).alias("top"), (F.length("token") * 8).alias("width"), F.lit(24).alias("height"), F.coalesce(F.col("confidence") * 100, F.lit(-1.0)).alias("confidence"),
    )


@R.add(
    "a13_blocks_from_words",
    f"""WITH {BLOCKS}, l AS (SELECT page_id, id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM b WHERE confidence IS NOT NULL),
k AS (SELECT page_id, id, ln, array_to_string(list_filter(list_transform(string_split(s, ' '), lambda t: trim(t)), lambda t: t <> ''), ' ') AS t FROM l)
SELECT page_id AS doc, id AS block, string_agg(t, chr(10) ORDER BY ln) FILTER (t <> '') AS text, (count(*) FILTER (t <> ''))::int AS line_count FROM k GROUP BY ALL HAVING count(*) FILTER (t <> '') > 0""",
)
def blocks_from_words(spark, sf_dir):
    """Words filtered and grouped into lines and blocks again."""
    return pages.blocks_of(pages.usable_words(words(spark, sf_dir))).select("doc", "block", "text", "line_count")


@R.add("x1_regions", None)
def regions(spark, sf_dir):
    """Line boxes merged into regions, page by page."""
    lines = words(spark, sf_dir).groupBy("doc", "block", "line").agg(F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), F.max("height").alias("height"))
    return pages.regions_of(lines.select("doc", "left", "top", "width", "height"), "doc")


@R.add("f19_source_refs", f"WITH {BLOCKS} SELECT page_id, id, regexp_extract(source_ref, 'page=([0-9]+)', 1) AS page, regexp_extract(source_ref, 'block=([0-9]+)', 1) AS block, regexp_extract(source_ref, 'par=([0-9]+)', 1) AS par FROM b")
def source_refs(spark, sf_dir):
    ref = tx.source_ref(F.col("source_ref"))
    return blocks(spark, sf_dir).select("page_id", "id", ref["page"].alias("page"), ref["block"].alias("block"), ref["par"].alias("par"))


@R.add(
    "n7_render_budget",
    f"""WITH {BLOCKS}, c AS (SELECT page_id, id, length(text) + CASE WHEN row_number() OVER w > 1 THEN 2 ELSE 0 END AS cost FROM b WINDOW w AS (PARTITION BY page_id ORDER BY id)),
u AS (SELECT page_id, id, sum(cost) OVER (PARTITION BY page_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM c)
SELECT page_id, id, used::bigint AS used FROM u WHERE used <= 600""",
)
def render_budget(spark, sf_dir):
    """The blocks of a page that fit a prompt of 600 characters (the budget is the feature)."""
    rows = blocks(spark, sf_dir).select("page_id", "id", "text")
    return records.within_budget(rows, "page_id", "id", F.length("text"), 600).select("page_id", "id", F.col("used").cast("bigint").alias("used"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rendered with block headers, in id order."""
    rows = blocks(spark, sf_dir).withColumn("shown", tx.two_decimals(F.col("confidence")))
    entry = F.concat(tx.block_header(F.struct("id", "box"), F.col("shown")), F.lit("\n"), tx.escape_delimiters(tx.drop_controls(F.col("text"))))
    packed = rows.withColumn("entry", entry).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "entry"))).alias("e"))
    return packed.select("page_id", F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n").alias("page"))


@R.add(
    "f16_rendered_ids",
    f"""WITH {BLOCKS}, l AS (SELECT page_id, id, list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '\\[[0-9]+\\]\\s*')) AS h FROM b)
SELECT page_id, array_to_string(flatten(list(list_prepend(id, list_transform(h, lambda x: regexp_extract(x, '[0-9]+')::int)) ORDER BY id)), ',') AS ids FROM l GROUP BY page_id""",
)
def rendered_ids(spark, sf_dir):
    """Ids read back from rendered pages; a line of the text that looks like a header reads as one."""
    return rendered(spark, sf_dir).select("page_id", F.array_join(tx.rendered_block_ids(F.col("page")).cast("array<string>"), ",").alias("ids"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based answer of every page, with the ids that may be cited."""
    p = table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("page_id"), "text", F.transform("blocks", lambda b: b["id"]).alias("known_ids"))
    return validation.rule_based_answers(arrow_rows(p)).select("page_id", "known_ids", "answer")


@R.add("x7_candidates", None)
def candidates(spark, sf_dir):
    """Pages to answers to validated candidates. The answers are a recorded stage of their own, as an
    engine's are; without that cut the optimizer would repeat the reading in every filter derived from them."""
    forms = table(spark, sf_dir, "ref_categories").select("slug", F.explode(F.concat(F.array("slug", "label"), "aliases")).alias("f"))
    book = forms.groupBy(tx.category_key(F.col("f")).alias("key")).agg(F.min("slug").alias("slug"))
    return validation.semantic_candidates(durable(answers(spark, sf_dir)), book).drop("language", "price")


@R.add("j8_evidence", f"WITH {BLOCKS}, k AS (SELECT page_id, list(id ORDER BY id) AS ids, list(line_count ORDER BY id) AS cited FROM b GROUP BY page_id) SELECT page_id, array_to_string(list_filter(cited, lambda x, i: list_contains(ids, x) AND list_position(cited, x) = i), ',') AS kept, len(list_filter(cited, lambda x: NOT coalesce(list_contains(ids, x), false))) > 0 AS unknown FROM k")
def evidence(spark, sf_dir):
    """Cited blocks that exist, in citation order (every page cites the line counts of its blocks), and whether one does not."""
    ordered = F.array_sort(F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["line_count"].alias("n"))))
    rows = table(spark, sf_dir, "ocr_pages").where(F.size("blocks") > 0).select(F.col("id").alias("page_id"), F.transform("blocks", lambda b: b["id"]).alias("known"), F.transform(ordered, lambda x: x["n"]).alias("cited"))
    kept = validation.evidence(F.col("cited"), F.col("known"))
    return rows.select("page_id", F.array_join(kept.cast("array<string>"), ",").alias("kept"), (F.size(kept) < F.size(F.array_distinct("cited"))).alias("unknown"))


@R.add("r6_block_documents", "SELECT id, len(blocks)::int AS n, list_aggregate(list_transform(blocks, lambda b: length(b.text)), 'sum')::bigint AS n_chars FROM ocr_pages")
def block_documents(spark, sf_dir):
    """Block documents written as JSON and read back."""
    p = table(spark, sf_dir, "ocr_pages")
    kind = p.schema["blocks"].dataType.simpleString()
    back = F.from_json(F.to_json("blocks"), kind)
    return p.select("id", back.alias("b")).select("id", F.size("b").alias("n"), F.aggregate(F.transform("b", lambda x: F.length(x["text"])), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_chars"))
