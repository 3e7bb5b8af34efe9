"""Boxes (left, top, width, height), confidences and their labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def side(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def right(box: Column) -> Column:
    return side(box, 0) + side(box, 2)


def bottom(box: Column) -> Column:
    return side(box, 1) + side(box, 3)


def area(box: Column) -> Column:
    """G-1: width times height, never negative."""
    return F.greatest(side(box, 2), F.lit(0)) * F.greatest(side(box, 3), F.lit(0))


def from_edges(left: Column, top: Column, right_: Column, bottom_: Column) -> Column:
    return F.array(left, top, right_ - left, bottom_ - top)


def union(a: Column, b: Column) -> Column:
    """The smallest box around two boxes."""
    return from_edges(F.least(side(a, 0), side(b, 0)), F.least(side(a, 1), side(b, 1)), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b)))


def shared_area(a: Column, b: Column) -> Column:
    """G-2: the area of the intersection."""
    w = F.least(right(a), right(b)) - F.greatest(side(a, 0), side(b, 0))
    h = F.least(bottom(a), bottom(b)) - F.greatest(side(a, 1), side(b, 1))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """G-2: intersection over union, 0 when both are empty."""
    both = shared_area(a, b)
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0)), F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """G-3: shared width over the narrower width."""
    shared = F.greatest(F.least(right(a), right(b)) - F.greatest(side(a, 0), side(b, 0)), F.lit(0))
    return F.coalesce(shared / F.nullif(F.greatest(F.least(side(a, 2), side(b, 2)), F.lit(0)), F.lit(0)), F.lit(0.0))


def padded(box: Column, width: Column, height: Column, padding: int) -> Column:
    """G-4: the box grown by ``padding`` and kept on the page."""
    left, top = F.greatest(side(box, 0) - padding, F.lit(0)), F.greatest(side(box, 1) - padding, F.lit(0))
    r, b = F.least(right(box) + padding, width), F.least(bottom(box) + padding, height)
    return from_edges(left, top, F.greatest(r, left), F.greatest(b, top))


def polygon_box(points: Column) -> Column:
    """G-9: the bounding box of array<array<int>> corner points; null when it has no area."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    return F.when((w > 0) & (h > 0), F.array(F.array_min(xs), F.array_min(ys), w, h))


def confidence_label(value: Column) -> Column:
    """G-5: high from 0.85, medium from 0.60, else or unknown low; NaN, which Spark orders above all numbers, is unknown."""
    return F.when(F.isnan(value), "low").when(value >= 0.85, "high").when(value >= 0.60, "medium").otherwise("low")


def label_confidence(label: Column) -> Column:
    """G-5 the other way: 0.9, 0.75, 0.4; 0.75 for other words."""
    low = F.lower(label)
    return F.when(low == "high", 0.9).when(low == "low", 0.4).otherwise(0.75)


def page_warnings(text: Column, confidence: Column, threshold: float = 0.60, least_chars: int = 8) -> Column:
    """G-6: codes of a page: empty text, no confidence, low confidence (an unknown one is not low)."""
    from pressmill.functions.text import strip

    return F.array_compact(
        F.array(
            F.when(F.length(strip(F.coalesce(text, F.lit("")))) < least_chars, "OCR_EMPTY_TEXT"),
            F.when(confidence.isNull(), "OCR_NO_CONFIDENCE").when(confidence < threshold, "OCR_LOW_CONFIDENCE"),
        )
    )


@F.pandas_udf(T.DoubleType())
def python_mean(values: pd.Series) -> pd.Series:
    """The mean of an ordered array, nulls skipped, rounded to four places as Python rounds; null when empty.

    Python's sum compensates and its round works on the binary value; avg and round of the JVM differ in the
    last place for some pages.
    """

    def mean(a):
        kept = [] if a is None else [float(x) for x in a if x is not None and x == x]
        return round(sum(kept) / len(kept), 4) if kept else None

    return pd.Series([mean(a) for a in values], dtype="float64")


def backoff(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """G-7: base * 2^(attempt-1), at most ``cap``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def call_wait(attempt: Column, retry_after_s: Column, left_s: Column, base: float = 1.0, cap: float = 20.0) -> Column:
    """G-7 for calls: the provider's own wait wins over the back-off; either is clipped to the time left."""
    return F.greatest(F.least(F.coalesce(retry_after_s, backoff(attempt, base, cap)), left_s), F.lit(0.0))
