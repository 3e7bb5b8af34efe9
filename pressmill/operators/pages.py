"""Pages from words: lines, blocks, reading order, ids, text, regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.functions import geometry as g

#: A new column band begins where a block's left edge is farther than this share of the page width from the one before.
BAND_GAP = 0.15


def usable_words(words: DataFrame) -> DataFrame:
    """Words with text and a confidence of 0 or more (NaN is no number and is kept, as an engine may emit it)."""
    from pressmill.functions.text import strip

    rows = words.withColumn("text", strip(F.col("text"))).withColumn("confidence", F.expr("try_cast(confidence AS double)"))
    return rows.where((F.col("text") != "") & F.col("confidence").isNotNull() & (F.isnan("confidence") | (F.col("confidence") >= 0)))


def _edges() -> list[Column]:
    return [F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom")]


def blocks_of(words: DataFrame) -> DataFrame:
    """words(doc, page, block, paragraph, line, word, text, left, top, width, height, confidence 0-100) to blocks.

    One row per (doc, page, block, paragraph): text (lines joined by line feeds, words by spaces), box, confidence
    0-1, line_count, source_ref. A paragraph is the bounded unit that is collected.
    """
    key = ["doc", "page", "block", "paragraph"]
    lines = words.groupBy(*key, "line").agg(F.array_sort(F.collect_list(F.struct("word", "text", "confidence"))).alias("w"), *_edges())
    blocks = lines.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("line", "w"))).alias("l"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
    )
    text = F.array_join(F.transform("l", lambda x: F.array_join(F.transform(x["w"], lambda w: w["text"]), " ")), "\n")
    scores = F.flatten(F.transform("l", lambda x: F.transform(x["w"], lambda w: w["confidence"] / 100)))
    return blocks.select(
        *key, text.alias("text"), F.array("left", "top", F.col("right") - F.col("left"), F.col("bottom") - F.col("top")).alias("box"),
        g.python_mean(scores).alias("confidence"), F.size("l").alias("line_count"),
        F.format_string("page=%d;block=%d;par=%d", "page", "block", "paragraph").alias("source_ref"),
    )


def reading_order(blocks: DataFrame, page_width: Column, page: list[str], tie: str) -> DataFrame:
    """Adds ``band`` and ``position`` (1..n over ``page[0]``, pages in order) to blocks with ``box``.

    Column bands chain: a block opens a band when its left edge is more than BAND_GAP of the width right of the
    block before it. Within a band blocks go down, then right; blocks without a box follow in ``tie`` order.
    """
    by_page = Window.partitionBy(*page)
    left, top = g.side(F.col("box"), 0), g.side(F.col("box"), 1)
    gap = F.greatest(F.lit(1), F.floor(page_width * BAND_GAP))
    placed = F.col("box").isNotNull()
    order = by_page.orderBy((~placed).cast("int"), left, tie)
    opens = F.when(placed & (left - F.lag(left).over(order) > gap), 1).otherwise(0)
    banded = blocks.withColumn("band", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(page[0]).orderBy(*page[1:], (~placed).cast("int"), "band", F.when(placed, top), F.when(placed, left), tie)
    return banded.withColumn("position", F.row_number().over(down))


def page_text(blocks: Column) -> Column:
    """Block texts joined by a blank line in id order."""
    return F.array_join(F.transform(F.array_sort(F.transform(blocks, lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text")))), lambda x: x["text"]), "\n\n")


def page_confidence(blocks: Column) -> Column:
    """The mean of the block confidences in id order, four places, null when no block has one."""
    ordered = F.array_sort(F.transform(blocks, lambda b: F.struct(b["id"].alias("id"), b["confidence"].alias("c"))))
    return g.python_mean(F.transform(F.filter(ordered, lambda x: x["c"].isNotNull()), lambda x: x["c"]))


def merge_regions(boxes: list[tuple[int, int, int, int]], gap: float = 1.2, overlap: float = 0.35, min_iou: float = 0.0) -> list[tuple[int, int, int, int]]:
    """Line boxes merged into regions.

    Boxes come top to bottom; each joins the first region that shares enough width and is near enough below it
    (or overlaps it by ``min_iou``, if given). Regions grow, so the merge repeats until none joins another.
    """
    if not boxes:
        return []
    heights = sorted(b[3] for b in boxes)
    mid = len(heights) // 2
    reach = gap * ((heights[mid] if len(heights) % 2 else (heights[mid - 1] + heights[mid]) / 2) or 1)

    def joins(r: tuple, b: tuple) -> bool:
        width = min(r[0] + r[2], b[0] + b[2]) - max(r[0], b[0])
        if min_iou > 0:
            both = max(width, 0) * max(min(r[1] + r[3], b[1] + b[3]) - max(r[1], b[1]), 0)
            all_ = r[2] * r[3] + b[2] * b[3] - both
            if all_ > 0 and both / all_ >= min_iou:
                return True
        narrow = min(r[2], b[2])
        return width > 0 and narrow > 0 and width / narrow >= overlap and b[1] - (r[1] + r[3]) <= reach

    def around(r: tuple, b: tuple) -> tuple[int, int, int, int]:
        x, y = min(r[0], b[0]), min(r[1], b[1])
        return x, y, max(r[0] + r[2], b[0] + b[2]) - x, max(r[1] + r[3], b[1] + b[3]) - y

    current = sorted(boxes, key=lambda b: (b[1], b[0]))
    while True:
        regions: list[tuple[int, int, int, int]] = []
        for b in current:
            for k, r in enumerate(regions):
                if joins(r, b):
                    regions[k] = around(r, b)
                    break
            else:
                regions.append(b)
        if len(regions) == len(current):
            return regions
        current = regions


def regions_of(lines: DataFrame, page: str) -> DataFrame:
    """X1 per page: lines(page, left, top, width, height) to (page, region_no, left, top, width, height).

    Greedy and order-sensitive, so a page is one unit; its line boxes are few. Pages without lines have no rows.
    """
    kind = dict(lines.dtypes)[page]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = merge_regions([tuple(map(int, r)) for r in pdf[["left", "top", "width", "height"]].itertuples(index=False)])
        return pd.DataFrame([(pdf[page].iloc[0], n, *r) for n, r in enumerate(found, 1)], columns=[page, "region_no", "left", "top", "width", "height"])

    return lines.groupBy(page).applyInPandas(run, f"`{page}` {kind}, region_no int, left int, top int, width int, height int")
