"""Boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V

BOX = ("left", "top", "right", "bottom")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(
        left.cast("double").alias("left"),
        top.cast("double").alias("top"),
        right.cast("double").alias("right"),
        bottom.cast("double").alias("bottom"),
        F.lit("top-left").alias("coord_origin"),
    )


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Inclusive rectangle overlap of (x0, top, x1, bottom) tuples."""
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def vertical_share(line_top: Column, line_bottom: Column, top: Column, bottom: Column) -> Column:
    """Part of a line's height inside a band."""
    return (F.least(line_bottom, bottom) - F.greatest(line_top, top)) / F.greatest(
        F.lit(1.0), line_bottom - line_top
    )


def line_zone(top: Column, bottom: Column, height: Column) -> Column:
    return F.when((height != 0) & (top <= height * V.HEADER_ZONE), F.lit("PAGE_HEADER")).when(
        (height != 0) & (bottom >= height * V.FOOTER_ZONE), F.lit("PAGE_FOOTER")
    )


def is_furniture_candidate(top: Column, bottom: Column, block_type: Column) -> Column:
    """Edge-zone or typed furniture; a missing box counts as the page top."""
    return (
        (F.coalesce(top, F.lit(0.0)) <= V.FURNITURE_TOP)
        | (F.coalesce(bottom, F.lit(0.0)) >= V.FURNITURE_BOTTOM)
        | F.coalesce(block_type.isin("header", "footer", "page_number"), F.lit(False))
    )


def normalize_bbox(**names: Column) -> Column:
    """Struct box from any of the accepted spellings; null when a side is NaN."""
    absent = F.lit(None).cast("double")

    def pick(*keys: str) -> list[Column]:
        return [names.get(k, absent) for k in keys]

    left = F.coalesce(*pick("left", "x0", "x"), F.lit(0.0))
    top = F.coalesce(*pick("top", "y0", "y"), F.lit(0.0))
    right = F.coalesce(*pick("right", "x1"), left)
    bottom = F.coalesce(*pick("bottom", "y1"), top)
    broken = F.isnan(left) | F.isnan(top) | F.isnan(right) | F.isnan(bottom)
    return F.when(~broken, F.struct(*[c.alias(n) for c, n in zip((left, top, right, bottom), BOX)]))


def relative_highlight(bbox: Column, width: Column, height: Column) -> Column:
    """Box as percentages of the page (a zero or missing page side counts as 1)."""
    w = F.when(F.coalesce(width, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(width)
    h = F.when(F.coalesce(height, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(height)
    return F.struct(
        (bbox["left"] / w * 100).alias("left_pct"),
        (bbox["top"] / h * 100).alias("top_pct"),
        ((bbox["right"] - bbox["left"]) / w * 100).alias("width_pct"),
        ((bbox["bottom"] - bbox["top"]) / h * 100).alias("height_pct"),
    )


def merge_bboxes(left: str = "x0", top: str = "top", right: str = "x1", bottom: str = "bottom") -> list[Column]:
    """Aggregates for the envelope of a group of boxes; null boxes are skipped."""
    return [
        F.min(left).alias("left"),
        F.min(top).alias("top"),
        F.max(right).alias("right"),
        F.max(bottom).alias("bottom"),
    ]


def starts_new_paragraph(
    gap: Column, x0: Column, previous_x0: Column, previous_text: Column, paragraph_gap: Column
) -> Column:
    """Break before a line by gap, by indent shift, or after closing punctuation."""
    wide = gap >= paragraph_gap
    shifted = (F.abs(x0 - previous_x0) >= 24) & (gap >= 3)
    closed = previous_text.rlike(r"[.:;]\z") & (gap >= paragraph_gap * 0.7)
    return F.coalesce(wide | shifted | closed, F.lit(False))
