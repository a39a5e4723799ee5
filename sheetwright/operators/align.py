"""Choosing how a page is laid over the template: candidates, their tests, and one transform per section."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwright import constants as C
from sheetwright.vision import features, kernels

# Thresholds of the alignment.
COVERAGE, REPROJECTION, INLIERS_OK, MATCHES_OK, HOMOGRAPHY_GAIN = 0.12, 4.0, 0.30, 18, 0.15
GOOD_RATIO, GOOD_MATCHES = 0.55, 30
AREA_RANGE, ASPECT_RANGE, CORNER_MARGIN = (0.25, 4.0), (0.5, 1.8), 0.06
SECTION_SIMILARITY, SECTION_OUTLIER, SECTION_ROTATION, SECTION_SCALE = 0.32, 0.02, 6.0, (0.85, 1.18)


def status(base_ok: Column, coverage: Column, error: Column) -> Column:
    """ok if the fit, its spread over the page and its error are all good enough, else warning."""
    return F.when(base_ok & (coverage >= COVERAGE) & (error <= REPROJECTION), "ok").otherwise("warning")


def is_good(state: Column, ratio: Column, matches: Column) -> Column:
    return (state == "ok") & (ratio >= GOOD_RATIO) & (matches >= GOOD_MATCHES)


def rank(state: Column) -> Column:
    return F.when(state == "ok", 2).when(state == "warning", 1).otherwise(0)


def sane_corners(corners: list[tuple[Column, Column]], width: Column, height: Column) -> Column:
    """Whether the template's mapped corners (from the top left, clockwise) are a page: a convex
    quadrilateral of a like area and shape, its corners still in their places."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners
    points = list(corners)
    twice = sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)), F.lit(0.0))
    share = F.abs(twice) / 2 / (width * height)
    turns = [(q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0]) for p, q, r in zip(points, points[1:] + points[:1], points[2:] + points[:2], strict=True)]
    convex = F.lit(True)
    for t in turns:
        convex = convex & (t > 0)
    mx, my = width * CORNER_MARGIN, height * CORNER_MARGIN
    placed = (ax < bx + mx) & (dx < cx + mx) & (ay < dy + my) & (by < cy + my)
    wide = (F.hypot(bx - ax, by - ay) + F.hypot(cx - dx, cy - dy)) / 2
    tall = (F.hypot(dx - ax, dy - ay) + F.hypot(cx - bx, cy - by)) / 2
    aspect = (wide / F.greatest(tall, F.lit(1e-9))) / (width / height)
    return share.between(*AREA_RANGE) & convex & placed & aspect.between(*ASPECT_RANGE)


def pick_method(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One candidate (method, status, ratio, matches) a document: the homography only if it is ok and its
    ratio is better by a margin, the similarity otherwise; whichever there is if there is one."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.struct("method", "status", "ratio", "matches")))
    both = candidates.groupBy(*by).agg(of("affine").alias("a"), of("homography").alias("h"))
    better = F.col("a").isNull() | ((F.col("h.status") == "ok") & (F.col("h.ratio") - F.col("a.ratio") >= HOMOGRAPHY_GAIN))
    return both.select(*by, F.when(F.coalesce(better & F.col("h").isNotNull(), F.lit(False)), F.col("h")).otherwise(F.col("a")).alias("c")).select(*by, "c.*")


def pick_image(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The raw or the straightened page (image, status, ratio, matches), by status, ratio and matches; raw on a tie."""
    order = F.struct(rank(F.col("status")), "ratio", "matches", (F.col("image") == "raw").cast("int"))
    return candidates.groupBy(*by).agg(F.max_by(F.struct("image", "status", "ratio", "matches"), order).alias("c")).select(*by, "c.*")


def _page(content: bytes, image: str, shape: tuple[int, int]) -> np.ndarray:
    """The page as photographed, or evened and straightened to the template's size."""
    page = kernels.grey(kernels.decode_png(bytes(content)))
    return page if image == "raw" else kernels.straightened(kernels.enhanced(page), shape)


def page_candidates(pages: DataFrame, template: np.ndarray, image: str = "raw") -> DataFrame:
    """Maps of each page (doc_id, content) onto the template by key points: a similarity and a homography at most.

    A page that can't be read or matched has one row with method none and the
    reason.  The template is one page and goes along with the function.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    names = ["method", "matches", "inliers", "ratio", "coverage", "error", "m"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = features.Template(template)
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
                try:
                    found, reason = known.candidates(_page(content, image, template.shape))
                except (ValueError, TypeError) as e:
                    found, reason = [], f"unreadable: {e}"
                rows += [(doc_id, image, *(c[n] for n in names), None) for c in found] or [(doc_id, image, "none", 0, 0, 0.0, 0.0, None, None, reason)]
            yield pd.DataFrame(rows, columns=["doc_id", "image", *names, "reason"])

    return pages.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, image string, method string, matches int, inliers int, ratio double, coverage double, error double, m array<double>, reason string")


def judged(candidates: DataFrame, width: int, height: int) -> DataFrame:
    """The candidates with rotation, scale, status, and whether their map is sane for a template of that size."""
    m = [F.element_at("m", i + 1) for i in range(9)]

    def mapped(x: float, y: float) -> tuple[Column, Column]:
        under = m[6] * x + m[7] * y + m[8]
        return F.try_divide(m[0] * x + m[1] * y + m[2], under), F.try_divide(m[3] * x + m[4] * y + m[5], under)

    turn, scale = F.degrees(F.atan2(m[3], m[0])), F.hypot(m[0], m[3])
    corners = [mapped(x, y) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    page = sane_corners(corners, F.lit(float(width)), F.lit(float(height)))
    sane = F.when(F.col("method") == "affine", (F.abs(turn) <= C.ROTATION_MAX) & scale.between(*C.SCALE_RANGE)).when(F.col("method") == "homography", page)
    base = (F.col("matches") >= MATCHES_OK) & (F.col("ratio") >= INLIERS_OK)
    return candidates.select("*", turn.alias("rotation"), scale.alias("scale"), status(base, F.col("coverage"), F.col("error")).alias("status"), F.coalesce(sane, F.lit(False)).alias("sane"))


def align_pages(pages: DataFrame, template: np.ndarray) -> DataFrame:
    """How each page (doc_id, content, is_pdf) is laid over the template: one row with status, reason, image, method, matches,
    inliers, ratio, coverage, error, rotation, scale and the map m (row by row, page to template).

    The raw page is tried first; only photos whose alignment is not good are
    straightened and tried again, and the straightened page must be better.
    A page without a sane map is failed, with the reason.  Ids are unique and
    not null.  The candidates are kept on disk while the result is used, so no
    page is matched twice.
    """
    height, width = template.shape
    raw = judged(page_candidates(pages, template), width, height).persist(StorageLevel.DISK_ONLY)
    good = pick_method(raw.where("sane"), ["doc_id"]).where(is_good(F.col("status"), F.col("ratio"), F.col("matches"))).select("doc_id")
    photos = pages.where(~F.coalesce(F.col("is_pdf"), F.lit(False))).join(good, "doc_id", "left_anti")
    again = judged(page_candidates(photos, template, "straight"), width, height).persist(StorageLevel.DISK_ONLY)
    tried = raw.unionByName(again)
    methods = pick_method(tried.where("sane"), ["doc_id", "image"])
    images = pick_image(methods, ["doc_id"]).select("doc_id", "image")
    chosen = tried.join(methods.join(images, ["doc_id", "image"]).select("doc_id", "image", "method"), ["doc_id", "image", "method"]).drop("sane", "reason")
    reasons = raw.groupBy("doc_id").agg(F.max("reason").alias("_reason"))
    out = pages.select("doc_id").join(chosen, "doc_id", "left").join(reasons, "doc_id", "left")
    failed = F.col("method").isNull()
    return out.select(
        "doc_id", F.coalesce("status", F.lit("failed")).alias("status"), F.when(failed, F.coalesce("_reason", F.lit("no_valid_transform"))).alias("reason"), "image",
        F.coalesce("method", F.lit("none")).alias("method"), "matches", "inliers", "ratio", "coverage", "error", "rotation", "scale", "m",
    )


def aligned_images(pages: DataFrame, alignment: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """doc_id, page and covered, both as PNG files of the template's shape: the page under its map, or fitted into the canvas
    where the alignment failed, and the mask of what it covers.  Nulls for pages that can't be read."""
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content, image, m in zip(batch.doc_id, batch.content, batch.image, batch.m, strict=True):
                try:
                    page = _page(content, image if m is not None else "raw", shape)
                except (ValueError, TypeError):
                    rows.append((doc_id, None, None))
                    continue
                if m is None:
                    laid, covered = features.letterboxed(page, shape)
                    covered = covered * np.uint8(255)
                else:
                    by = np.array(m, np.float64).reshape(3, 3)
                    laid, covered = kernels.warp(page, by, shape), kernels.warp(np.full(page.shape, 255, np.uint8), by, shape, 0)
                rows.append((doc_id, kernels.encode_png(laid), kernels.encode_png(covered)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "covered"])

    return pages.select("doc_id", "content").join(alignment.select("doc_id", "image", "m"), "doc_id").mapInPandas(run, f"doc_id {kind}, page binary, covered binary")


def section_transforms(anchors: DataFrame, diagonal: float) -> DataFrame:
    """doc_id, section, method and the map a, b, tx, c, d, ty of each section.

    anchors: doc_id, section, x, y, dx, dy, score.  Unlike anchors and those
    far from the median shift are left out; three or more give a similarity by
    least median, unless it turns or scales too much; fewer give their mean
    shift; none gives none.  A section has a handful of anchors, so a group
    fits in a task.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        head = [rows.doc_id.iloc[0], rows.section.iloc[0]]
        good = rows[rows.score >= SECTION_SIMILARITY]
        if len(good):
            away = ((good.dx - good.dx.median()) ** 2 + (good.dy - good.dy.median()) ** 2) ** 0.5
            good = good[away <= SECTION_OUTLIER * diagonal]
        if not len(good):
            return _transform([*head, "none", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0])
        if len(good) >= 3:
            source = good[["x", "y"]].to_numpy(float)
            m, _ = kernels.robust_similarity(source, source + good[["dx", "dy"]].to_numpy(float), None)
            turn, scale = math.degrees(math.atan2(m[1, 0], m[0, 0])), math.hypot(m[0, 0], m[1, 0])
            if abs(turn) <= SECTION_ROTATION and SECTION_SCALE[0] <= scale <= SECTION_SCALE[1]:
                return _transform([*head, "section_affine", *m[0], *m[1], len(good)])
        return _transform([*head, "consensus_translation", 1.0, 0.0, good.dx.mean(), 0.0, 1.0, good.dy.mean(), len(good)])

    kind = anchors.schema["doc_id"].dataType.simpleString()
    return anchors.groupBy("doc_id", "section").applyInPandas(fit, f"doc_id {kind}, section string, method string, a double, b double, tx double, c double, d double, ty double, n int")


def _transform(values: list) -> pd.DataFrame:
    return pd.DataFrame([values], columns=["doc_id", "section", "method", "a", "b", "tx", "c", "d", "ty", "n"])
