"""Kernels on synthetic images, with tolerance where sampling is involved."""

import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from sheetwright.vision import backends, kernels


def png(image: np.ndarray, filter_type: int = 0) -> bytes:
    rows = b""
    before = np.zeros(image.shape[1], np.int32)
    for row in image.astype(np.int32):
        line = {0: row, 1: row - np.concatenate([[0], row[:-1]]), 2: row - before}[filter_type]
        rows += bytes([filter_type]) + (line & 255).astype(np.uint8).tobytes()
        before = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def page():
    rng = np.random.default_rng(3)
    return kernels.blur(rng.integers(0, 255, (80, 120)).astype(np.uint8), 5).astype(np.uint8)


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_png(page, kind):
    assert (kernels.grey(kernels.decode_png(png(page, kind))) == page).all()


def test_broken_png():
    for data in (b"", b"\x89PNG\r\n\x1a\n", b"x" * 20):
        with pytest.raises(ValueError):
            kernels.decode_png(data)


def test_ink(page):
    blank = np.full((40, 80), 255, np.uint8)
    filled = blank.copy()
    filled[10:20, 10:30] = 0
    filled[30, :] = 0
    mask = kernels.difference_mask(blank, filled)
    stats = kernels.ink_stats(kernels.without_lines(mask))
    assert stats["components"] == 1 and 0.2 < stats["spread_x"] < 0.35
    assert kernels.ink_ratio(blank, blank) == 0.0
    assert kernels.ink_stats(np.zeros((5, 5), bool))["components"] == 0


def test_components_join_at_corners():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    labels = kernels.components(mask)
    assert labels[0, 0] == labels[1, 1] != 0 and len(np.unique(labels[mask])) == 3


def test_correlation_finds_the_shift(page):
    moved = np.roll(page, (3, -4), (0, 1))
    got = kernels.anchor_offset(page, moved, (40, 30, 70, 50), 10, 10)
    assert (got["dx"], got["dy"], got["matched"]) == (-4, 3, True)
    assert not kernels.anchor_offset(page, moved, (0, 0, 0, 0), 1, 1)["matched"]


def test_otsu_separates():
    image = np.concatenate([np.full(50, 30), np.full(50, 200)]).astype(np.uint8)
    assert 30 <= kernels.otsu(image) < 200


def test_warp_and_corners(page):
    corners = np.array([[100, 70], [5, 4], [110, 6], [8, 75]], float)
    ordered = kernels.order_corners(corners)
    assert ordered.tolist() == [[5, 4], [110, 6], [100, 70], [8, 75]]
    m = kernels.homography(ordered, np.array([[0, 0], [119, 0], [119, 79], [0, 79]], float))
    back = kernels.warp(kernels.warp(page, np.eye(3), page.shape), np.eye(3), page.shape)
    assert np.abs(back[1:-2, 1:-2].astype(int) - page[1:-2, 1:-2]).max() <= 1
    assert np.allclose(m @ [5, 4, 1] / (m @ [5, 4, 1])[2], [0, 0, 1], atol=1e-6)


def test_robust_fit():
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 100, (40, 2))
    r = np.array([[0.98, -0.05], [0.05, 0.98]])
    b = a @ r.T + [3, -2]
    b[:8] += rng.uniform(30, 60, (8, 2))
    for limit in (4.0, None):
        m, inliers = kernels.robust_similarity(a, b, limit)
        assert np.allclose(m, np.hstack([r, [[3], [-2]]]), atol=1e-6) and inliers.sum() == 32


def test_backend_contract(spark, page):
    tokens = backends.payload_tokens(["a", ""], [0.9, 0.8], [[[1.2, 2.7], [4.1, 2.2], [4.0, 6.9]], [[0, 0]]])
    assert tokens == [{"text": "a", "confidence": 0.9, "x1": 1, "y1": 2, "x2": 5, "y2": 7}]
    known = {page.tobytes(): tokens}
    df = spark.createDataFrame([(1, bytearray(png(page))), (2, bytearray(b"broken")), (3, None)], "doc int, content binary")
    got = {r["doc"]: r["r"] for r in df.select("doc", backends.recognise(lambda: backends.Recorded(known))("content").alias("r")).collect()}
    assert got[1]["tokens"][0]["text"] == "a" and got[1]["error"] is None
    assert got[2]["tokens"] is None and got[2]["error"].startswith("ValueError")
    assert got[3]["error"]
    crops = spark.createDataFrame([(1, bytearray(png(page)), bytearray(png(255 - page)), 1.0), (2, None, None, 0.2)], "doc int, template binary, filled binary, covered double")
    marks = {r["doc"]: r for r in backends.option_marks(crops, F.col("covered")).collect()}
    assert marks[1]["score"] > 0.1 and marks[2]["out_of_frame"] and marks[2]["score"] is None


def test_paper_and_straightening():
    photo = np.full((100, 140), 40, np.uint8)
    photo[10:90, 20:120] = 230
    corners, share = kernels.paper_quad(photo)
    assert 0.5 < share < 0.6 and np.abs(corners - [[20, 10], [119, 10], [119, 89], [20, 89]]).max() <= 3
    assert kernels.straightened(photo, (50, 60)).mean() > 200
    assert kernels.paper_quad(np.full((20, 20), 9, np.uint8))[0] is None
    assert (kernels.enhanced(photo) == photo).all() and (kernels.enhanced(photo // 4 + 60) != photo // 4 + 60).any()


def test_handwriting_crop():
    template = np.full((100, 200), 255, np.uint8)
    template[70, :] = 0
    page = template.copy()
    page[32:40, 60:90] = 0
    x1, y1, x2, y2 = kernels.handwriting_crop(template, page, (40, 25, 160, 45))
    assert x1 <= 60 < 90 <= x2 and y1 <= 32 < 40 <= y2 and x2 - x1 < 60
    assert kernels.handwriting_crop(template, template, (40, 25, 160, 45)) is None
    assert kernels.free_rows_below(template, (0, 10, 50, 40), 60) == 28
    assert kernels.row_bands(np.isin(np.arange(11), [0, 3, 10])[:, None]) == [(0, 4), (10, 11)]


def test_alignment_choices(spark):
    from sheetwright.operators import align

    rows = [(1, "affine", "ok", 0.5, 40), (1, "homography", "ok", 0.6, 40), (2, "affine", "ok", 0.5, 40), (2, "homography", "ok", 0.7, 9), (3, "homography", "warning", 0.2, 5), (4, "affine", "warning", 0.4, 20), (4, "homography", "warning", 0.9, 20)]
    got = {r["doc"]: r["method"] for r in align.pick_method(spark.createDataFrame(rows, "doc int, method string, status string, ratio double, matches int"), ["doc"]).collect()}
    assert got == {1: "affine", 2: "homography", 3: "homography", 4: "affine"}
    images = [(1, "raw", "ok", 0.5, 9), (1, "straight", "ok", 0.5, 9), (2, "raw", "warning", 0.9, 9), (2, "straight", "ok", 0.1, 1)]
    got = {r["doc"]: r["image"] for r in align.pick_image(spark.createDataFrame(images, "doc int, image string, status string, ratio double, matches int"), ["doc"]).collect()}
    assert got == {1: "raw", 2: "straight"}
    quad = lambda *p: spark.range(1).select(align.sane_corners([(F.lit(float(x)), F.lit(float(y))) for x, y in p], F.lit(100.0), F.lit(140.0))).first()[0]
    assert quad((0, 0), (100, 5), (98, 140), (2, 135)) and not quad((100, 0), (0, 0), (0, 140), (100, 140)) and not quad((0, 0), (10, 0), (10, 140), (0, 140)) and not quad((0, 0), (100, 0), (20, 20), (0, 140))
    anchors = [(1, "s", float(x), float(y), 3.0, -2.0, 0.9) for x, y in ((0, 0), (50, 0), (0, 40), (60, 60))] + [(1, "s", 9.0, 9.0, 90.0, 90.0, 0.9), (2, "s", 0.0, 0.0, 4.0, 1.0, 0.9), (3, "s", 0.0, 0.0, 4.0, 1.0, 0.1)]
    out = {r["doc_id"]: r for r in align.section_transforms(spark.createDataFrame(anchors, "doc_id long, section string, x double, y double, dx double, dy double, score double"), 500.0).collect()}
    assert out[1]["method"] == "section_affine" and abs(out[1]["tx"] - 3) < 1e-6 and out[1]["n"] == 4
    assert (out[2]["method"], out[2]["tx"], out[3]["method"]) == ("consensus_translation", 4.0, "none")


@pytest.fixture
def form():
    """A synthetic form: lines, boxes and marks like printed words."""
    rng = np.random.default_rng(12)
    image = np.full((700, 500), 245, np.uint8)
    for y in range(40, 680, 26):
        x = 30
        while x < 450:
            wide = int(rng.integers(4, 16))
            image[y : y + int(rng.integers(4, 13)), x : x + wide] = int(rng.integers(10, 90))
            x += wide + int(rng.integers(4, 12))
    return image


def test_area_means_and_letterbox():
    from sheetwright.vision import features

    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (features.resized(image, (6, 8)) == image).all()
    blocks = image.reshape(3, 2, 4, 2).mean((1, 3))
    assert np.abs(features.resized(image, (3, 4)) - blocks).max() <= 0.5
    canvas, mask = features.letterboxed(np.zeros((10, 20), np.uint8), (40, 40))
    assert mask.sum() == 20 * 40 and (canvas[mask] == 0).all() and (canvas[~mask] == 255).all()
    assert not features.letterboxed(np.zeros((0, 5), np.uint8), (4, 4))[1].any()
    assert features.for_matching(np.zeros((3600, 900), np.uint8))[0].shape == (1800, 450)


def test_homography_by_consensus():
    from sheetwright.vision import features

    rng = np.random.default_rng(6)
    a = rng.uniform(0, 1000, (60, 2))
    true = np.array([[1.02, 0.03, 5], [-0.02, 0.97, 9], [2e-5, 1e-5, 1]])
    b = features.projected(true, a)
    b[:20] += rng.uniform(40, 90, (20, 2))
    m, inliers = features.robust_homography(a, b)
    assert inliers.sum() == 40 and np.allclose(features.projected(m, a), features.projected(true, a), atol=1e-4)


def test_pages_are_aligned(spark, form):
    from sheetwright.operators import align

    assert (kernels.grey(kernels.decode_png(kernels.encode_png(form))) == form).all()
    turn = np.deg2rad(3)
    moved = np.array([[0.95 * np.cos(turn), -0.95 * np.sin(turn), 40], [0.95 * np.sin(turn), 0.95 * np.cos(turn), 15], [0, 0, 1]])
    tilted = np.array([[0.9, 0.08, 20], [0.02, 0.92, 12], [2e-4, 1e-4, 1]])
    pages = {1: form, 2: kernels.warp(form, moved, (760, 560)), 3: kernels.warp(form, tilted, (700, 500)), 4: np.full((300, 300), 200, np.uint8), 5: np.zeros((9, 9), np.uint8)}
    rows = [(i, bytearray(png(p)), i == 1) for i, p in pages.items()] + [(6, bytearray(b"broken"), False), (7, None, False)]
    df = spark.createDataFrame(rows, "doc_id long, content binary, is_pdf boolean")
    alignment = align.align_pages(df, form)
    got = {r["doc_id"]: r for r in alignment.collect()}
    assert len(got) == 7
    corners = np.array([[50, 80], [450, 80], [450, 640], [50, 640]], float)
    for i, true in ((1, np.eye(3)), (2, moved), (3, tilted)):
        assert got[i]["status"] == "ok" and got[i]["reason"] is None
        if got[i]["image"] == "raw":
            m = np.array(got[i]["m"]).reshape(3, 3) @ true
            at = np.hstack([corners, np.ones((4, 1))]) @ m.T
            assert np.abs(at[:, :2] / at[:, 2:] - corners).max() < 6
    assert got[2]["method"] == "affine" and abs(got[2]["rotation"] + 3) < 0.5
    assert [got[i]["status"] for i in (4, 5, 6, 7)] == ["failed"] * 4
    assert got[4]["reason"] == "features_not_found" and got[5]["reason"] == "invalid_dimensions" and got[6]["reason"].startswith("unreadable")
    images = {r["doc_id"]: r for r in align.aligned_images(df, alignment, form.shape).collect()}
    laid = kernels.grey(kernels.decode_png(images[2]["page"])).astype(int)
    inside = np.s_[100:600, 100:400]
    assert laid.shape == form.shape and np.abs(laid[inside] - form[inside]).mean() < 25
    covered = kernels.grey(kernels.decode_png(images[4]["covered"]))
    assert covered.any() and not covered.all() and images[6]["page"] is None
    assert align.align_pages(df.limit(0), form).count() == 0


def test_local_contrast(form):
    flat = (form // 8 + 90).astype(np.uint8)
    out = kernels.local_contrast(flat)
    assert out.shape == flat.shape and out.std() > flat.std()
    plain = kernels.local_contrast(np.full((50, 30), 77, np.uint8))
    assert len(np.unique(plain)) == 1
    one_tile = kernels.local_contrast(flat, 1e9, 1)  # plain equalisation: the cumulated share of each value
    share = np.bincount(flat.reshape(-1), minlength=256).cumsum() / flat.size
    assert (one_tile == np.rint(share[flat] * 255)).all()
    assert kernels.enhanced(flat).std() > flat.std()


def test_edges_stand_in_for_brightness():
    ramp = np.tile(np.linspace(60, 200, 160), (120, 1))
    frame = ramp.astype(np.uint8)
    frame[15:18, 20:140] = frame[102:105, 20:140] = frame[15:105, 20:23] = frame[15:105, 137:140] = 0
    corners, share = kernels.edge_quad(frame)
    assert 0.5 < share < 0.65 and np.abs(corners - [[20, 15], [139, 15], [139, 104], [20, 104]]).max() <= 5
    assert kernels.edge_quad(np.full((20, 20), 9, np.uint8)) == (None, 0.0)
