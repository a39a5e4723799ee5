"""Boxes on a photographed page: fitting, shifting, resolving and widening them, and what their reading came to.

Boxes are structs x1, y1, x2, y2.  All functions are column expressions or
plain joins, so they run for any number of pages at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright import constants as C
from sheetwright.operators import layout

_BOX = ("x1", "y1", "x2", "y2")


def match_scale(width: Column, height: Column) -> Column:
    """The factor that brings a page's longer side down to MATCH_SIDE; 1 for smaller pages."""
    return F.least(F.lit(1.0), C.MATCH_SIDE / F.greatest(width, height).cast("double"))


def letterbox(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Size and offsets of a page that is fitted into a canvas without changing its shape; null for an empty page."""
    scale = F.least(to_width / width, to_height / height)
    w, h = (F.greatest(F.lit(1), F.bround(side * scale, 0).cast("int")) for side in (width, height))
    fitted = F.struct(w.alias("width"), h.alias("height"), F.floor((to_width - w) / 2).cast("int").alias("x"), F.floor((to_height - h) / 2).cast("int").alias("y"))
    return F.when((width > 0) & (height > 0), fitted)


def body_points(points: DataFrame, height: Column, y: str = "y") -> DataFrame:
    """Key points below the page's head, whose upper part differs from page to page."""
    return points.where(F.col(y) >= F.floor(height * C.HEAD_SHARE))


def match_geometry(matches: DataFrame, by: list[str], width: Column, height: Column) -> DataFrame:
    """coverage and error of each page's match: the share of the canvas that the inliers' envelope covers, and their mean
    distance (x, y) from where the map puts them (px, py).  0 and null with fewer than two inliers."""
    inlier = lambda c: F.when(F.col("inlier"), c)
    area = (F.max(inlier(F.col("x"))) - F.min(inlier(F.col("x")))) * (F.max(inlier(F.col("y"))) - F.min(inlier(F.col("y"))))
    n = F.count_if(F.col("inlier"))
    away = F.avg(inlier(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))))
    canvas = F.greatest(F.lit(1.0), F.max(width * height).cast("double"))
    return matches.groupBy(*by).agg(F.when(n >= 2, area / canvas).otherwise(F.lit(0.0)).alias("coverage"), F.when(n >= 2, away).alias("error"), n.alias("inliers"))


def page_box(box: Column, width: Column, height: Column) -> Column:
    """A box in page fractions as pixels of the page."""
    return layout.clip_box(box["x1"] * width, box["y1"] * height, box["x2"] * width, box["y2"] * height, width, height)


def shift_box(box: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """The box moved and cut to the page."""
    return layout.clip_box(box["x1"] + dx, box["y1"] + dy, box["x2"] + dx, box["y2"] + dy, width, height)


def resolve_box(template: Column, matched: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A field's box on the page: moved with its anchor where that was found, else the template's."""
    found = F.coalesce(matched, F.lit(False))
    return F.struct(F.when(found, shift_box(template, dx, dy, width, height)).otherwise(template).alias("box"), F.when(found, "anchor").otherwise("fallback").alias("source"))


def resolve_section_box(template: Column, transform: Column, method: Column, matched: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """The box under its section's map where there is one, else as its own anchor says."""
    moved = layout.transform_box(template, transform)
    cut = layout.clip_box(moved["x1"], moved["y1"], moved["x2"], moved["y2"], width, height)
    by_section = F.struct(cut.alias("box"), F.concat(F.lit("section_"), method).alias("source"))
    return F.when(transform.isNotNull(), by_section).otherwise(resolve_box(template, matched, dx, dy, width, height))


def field_boxes(rows: DataFrame, width: Column, height: Column) -> DataFrame:
    """``rows`` (field, region, value and anchor boxes in page fractions, transform, method, matched, dx, dy, next_top,
    prev_bottom) with box, source and anchor_box in pixels.  Only fields of CLAMPED_REGION are held between their
    neighbours; the anchor's box moves as its field's does."""
    template = page_box(F.col("value"), width, height)
    found = resolve_section_box(template, F.col("transform"), F.col("method"), F.col("matched"), F.col("dx"), F.col("dy"), width, height)
    out = rows.withColumn("_found", found)
    held = layout.clamp_to_neighbours(F.col("_found.box"), F.col("next_top"), F.col("prev_bottom"), height)
    out = out.withColumn("box", F.when(F.col("region") == C.CLAMPED_REGION, held).otherwise(F.col("_found.box"))).withColumn("source", F.col("_found.source")).drop("_found")
    anchor = page_box(F.col("anchor"), width, height)
    return out.withColumn("anchor_box", shift_box(anchor, F.col("box.x1") - template["x1"], F.col("box.y1") - template["y1"], width, height))


def search_window(box: Column, region: Column) -> Column:
    """The box widened by a share of its region's size and cut to the region."""
    dx, dy = (region["x2"] - region["x1"]) * C.SEARCH_X, (region["y2"] - region["y1"]) * C.SEARCH_Y
    return F.struct(F.greatest(region["x1"], box["x1"] - dx).alias("x1"), F.greatest(region["y1"], box["y1"] - dy).alias("y1"), F.least(region["x2"], box["x2"] + dx).alias("x2"), F.least(region["y2"], box["y2"] + dy).alias("y2"))


def signature_roi(status: Column) -> Column:
    """How a signature's box did."""
    return F.when(status == "out_of_frame", "CUT_OFF").otherwise("PASS")
