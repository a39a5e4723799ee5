"""Image kernels on numpy arrays: grey images are (h, w) uint8, masks are bool.

They follow the definitions of the operations, not any library's rounding, so
results agree with other implementations up to tolerance.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from sheetwright import constants as C

DIFFERENCE, MATCH_MIN, BLANK_MIN = 38, 0.30, 0.008


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey, RGB or RGBA PNG without interlacing; others raise ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only plain 8-bit PNG files are read")
    width, height, depth = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise ValueError(f"the image data are broken: {e}") from e
    if len(raw) != height * (1 + width * depth):
        raise ValueError("the image data end early")
    rows = raw.reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), np.int32)
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:].astype(np.int32), out[y - 1] if y else np.zeros(width * depth, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            for c in range(depth):
                out[y, c::depth] = np.cumsum(line[c::depth]) & 255
        else:
            for x in range(width * depth):
                a, b, c = (out[y, x - depth] if x >= depth else 0), up[x], (up[x - depth] if x >= depth else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, x] = (line[x] + guess) & 255
    return out.astype(np.uint8).reshape(height, width, depth)


def encode_png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.pad(image, ((0, 0), (1, 0))).tobytes()  # each row behind its filter's number, 0
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[:, :, 0]
    return np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def needs_enhancement(image: np.ndarray) -> bool:
    return bool(image.std() < 40 or image.mean() < 120)


def _sum_table(values: np.ndarray) -> np.ndarray:
    return np.pad(values.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def window_sum(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums of every height x width window."""
    t = _sum_table(values)
    return t[height:, width:] - t[:-height, width:] - t[height:, :-width] + t[:-height, :-width]


def blur(image: np.ndarray, size: int = 3) -> np.ndarray:
    """Binomial smoothing with edges repeated."""
    kernel = np.array([1.0])
    for _ in range(size - 1):
        kernel = np.convolve(kernel, [0.5, 0.5])
    pad = size // 2
    out = np.pad(image.astype(np.float64), pad, mode="edge")
    out = sum(k * out[i : i + image.shape[0]] for i, k in enumerate(kernel))
    return sum(k * out[:, i : i + image.shape[1]] for i, k in enumerate(kernel))


def erode(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """True where the whole window from a pixel is true; pixels outside count as true."""
    out = np.pad(mask, ((0, height - 1), (0, width - 1)), constant_values=True)
    return window_sum(out, height, width) == height * width


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.pad(mask, ((height - 1, 0), (width - 1, 0)))
    return window_sum(out, height, width) > 0


def opened(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return dilate(erode(mask, height, width), height, width)


def difference_mask(template: np.ndarray, filled: np.ndarray, threshold: int = DIFFERENCE) -> np.ndarray:
    """Where the smoothed images differ by more than the threshold, specks removed."""
    return opened(np.abs(blur(template) - blur(filled)) > threshold, 2, 2)


def ink_ratio(template: np.ndarray, filled: np.ndarray) -> float:
    return float(difference_mask(template, filled).mean()) if template.size else 0.0


def without_lines(mask: np.ndarray) -> np.ndarray:
    """The mask without horizontal runs of half its width and 15 pixels at least."""
    length = max(15, mask.shape[1] // 2)
    return mask if length > mask.shape[1] else mask & ~opened(mask, 1, length)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected parts, by union of row runs."""
    labels, parent, n = np.zeros(mask.shape, np.int32), [0], 0

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    before: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            n += 1
            parent.append(n)
            for c, d, other in before:
                if c <= b and d >= a:  # ends are exclusive, so touching corners join
                    p, q = top(other), top(n)
                    parent[max(p, q)] = min(p, q)
            labels[y, a:b] = n
            runs.append((a, b, n))
        before = runs
    roots = np.array([top(i) for i in range(n + 1)])
    return np.unique(roots, return_inverse=True)[1].reshape(-1)[labels].astype(np.int32)


def ink_stats(mask: np.ndarray, least: int = C.INK_PIXELS) -> dict:
    """Parts of ``least`` pixels and more: their number, their share of the area and their extent."""
    sizes = np.bincount(components(mask).reshape(-1))
    kept = np.isin(components(mask), [i for i, s in enumerate(sizes) if i and s >= least])
    if not kept.any():
        return {"components": 0, "area_ratio": 0.0, "spread_x": 0.0, "spread_y": 0.0}
    ys, xs = np.nonzero(kept)
    return {
        "components": int(sum(1 for s in sizes[1:] if s >= least)),
        "area_ratio": float(kept.mean()),
        "spread_x": float((xs.max() - xs.min() + 1) / mask.shape[1]),
        "spread_y": float((ys.max() - ys.min() + 1) / mask.shape[0]),
    }


def correlate(template: np.ndarray, search: np.ndarray) -> tuple[int, int, float]:
    """(x, y, score) of the best normalised cross-correlation of a template in a larger image."""
    t = template.astype(np.float64) - template.mean()
    h, w = t.shape
    shape = (search.shape[0] + h - 1, search.shape[1] + w - 1)
    s = search.astype(np.float64)
    product = np.fft.irfft2(np.fft.rfft2(s, shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)[h - 1 : search.shape[0], w - 1 : search.shape[1]]
    total, squares = window_sum(s, h, w), window_sum(s * s, h, w)
    norm = np.sqrt(np.maximum(squares - total * total / (h * w), 0) * (t * t).sum())
    score = np.where(norm > 1e-6, product / np.maximum(norm, 1e-6), 0.0)
    y, x = np.unravel_index(int(score.argmax()), score.shape)
    return int(x), int(y), float(score[y, x])


def anchor_offset(template: np.ndarray, target: np.ndarray, box: tuple[int, int, int, int], reach_x: int, reach_y: int) -> dict:
    """Shift of a template's patch in the target within a reach, and whether it matched."""
    x1, y1, x2, y2 = box
    left, top = max(0, x1 - reach_x), max(0, y1 - reach_y)
    search = target[top : min(target.shape[0], y2 + reach_y), left : min(target.shape[1], x2 + reach_x)]
    patch = template[y1:y2, x1:x2]
    if not patch.size or search.shape[0] < patch.shape[0] or search.shape[1] < patch.shape[1]:
        return {"dx": 0, "dy": 0, "score": 0.0, "matched": False}
    x, y, score = correlate(patch, search)
    return {"dx": left + x - x1, "dy": top + y - y1, "score": score, "matched": score >= MATCH_MIN}


def otsu(image: np.ndarray) -> int:
    """The threshold with the greatest variance between the classes."""
    counts = np.bincount(image.reshape(-1), minlength=256).astype(np.float64)
    below, sums = counts.cumsum(), (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(spread).argmax())


def order_corners(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left."""
    total, slope = points.sum(1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), slope.argmin(), total.argmax(), slope.argmax()]]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3x3 map of four points or more, by least squares."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    m = np.linalg.svd(np.array(rows, np.float64))[2][-1].reshape(3, 3)
    return m / m[2, 2]


def warp(image: np.ndarray, m: np.ndarray, shape: tuple[int, int], fill: int = 255) -> np.ndarray:
    """The image under the map ``m`` (source to target), sampled bilinearly; outside is ``fill``."""
    ys, xs = np.mgrid[: shape[0], : shape[1]]
    points = np.linalg.inv(m) @ np.stack([xs.reshape(-1), ys.reshape(-1), np.ones(xs.size)])
    x, y = points[0] / points[2], points[1] / points[2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < image.shape[1] - 1) & (y0 < image.shape[0] - 1)
    x0, y0 = np.clip(x0, 0, image.shape[1] - 2), np.clip(y0, 0, image.shape[0] - 2)
    fx, fy, s = x - x0, y - y0, image.astype(np.float64)
    value = (s[y0, x0] * (1 - fx) + s[y0, x0 + 1] * fx) * (1 - fy) + (s[y0 + 1, x0] * (1 - fx) + s[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside, np.rint(value), fill).clip(0, 255).astype(np.uint8).reshape(shape)


def similarity_fit(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2x3 rotation, scale and shift of least squares."""
    a, b = source.mean(0), target.mean(0)
    p, q = source - a, target - b
    norm = (p * p).sum()
    c, s = ((p * q).sum() / norm, (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum() / norm) if norm else (1.0, 0.0)
    r = np.array([[c, -s], [s, c]])
    return np.hstack([r, (b - r @ a)[:, None]])


def robust_similarity(source: np.ndarray, target: np.ndarray, limit: float | None = 4.0, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(map, inliers) from the best of random pairs: most points within ``limit``, or without one the least median error."""
    rng, best, score = np.random.default_rng(seed), None, None
    for _ in range(rounds):
        pick = rng.choice(len(source), 2, replace=False)
        m = similarity_fit(source[pick], target[pick])
        error = np.hypot(*(source @ m[:, :2].T + m[:, 2] - target).T)
        s = -np.median(error) if limit is None else (error <= limit).sum()
        if score is None or s > score:
            best, score = error, s
    bound = limit if limit is not None else max(1.0, 2.5 * float(np.median(best)))
    inliers = best <= bound
    return similarity_fit(source[inliers], target[inliers]), inliers


def coverage(mask: np.ndarray | None, box: tuple[int, int, int, int]) -> float:
    """Share of a box that the source image covers; all of it without a mask, none of an empty box."""
    if mask is None:
        return 1.0
    part = mask[box[1] : box[3], box[0] : box[2]]
    return float((part > 0).mean()) if part.size else 0.0


def edge_quad(image: np.ndarray) -> tuple[np.ndarray | None, float]:
    """(corners, share of the area) of what the longest connected edges of the image enclose."""
    if min(image.shape) < 3:
        return None, 0.0
    gy, gx = np.gradient(blur(image, 5))
    steep = np.hypot(gx, gy)
    if steep.max() < 1:
        return None, 0.0
    scaled = (steep * (255 / steep.max())).astype(np.uint8)
    labels = components(window_sum(np.pad(scaled > otsu(scaled), 2), 5, 5) > 0)
    sizes = np.bincount(labels.reshape(-1))
    sizes[0] = 0
    ys, xs = np.nonzero(labels == sizes.argmax())
    corners = order_corners(np.stack([xs, ys], 1).astype(float))
    x, y = corners.T
    return corners, float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 / image.size)


def paper_quad(image: np.ndarray, least: float = 0.30, most: float = 0.985) -> tuple[np.ndarray | None, float]:
    """(corners, share of the area) of the largest bright or dark part, or where its share is out of range of what edges
    enclose; no corners if neither is in range."""
    best, share = None, 0.0
    bright = image > otsu(image)
    for mask in (bright, ~bright):
        labels = components(dilate(erode(mask, 3, 3), 3, 3))
        sizes = np.bincount(labels.reshape(-1))
        sizes[0] = 0
        if sizes.max(initial=0) / image.size > share:
            share = float(sizes.max() / image.size)
            ys, xs = np.nonzero(labels == sizes.argmax())
            best = order_corners(np.stack([xs, ys], 1).astype(float))
    if not least <= share <= most:
        best, by_edges = edge_quad(image)
        share = by_edges or share
        return (best if least <= by_edges <= most else None), share
    return best, share


def straightened(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The page in a photo, brought to the template's size; the photo itself if no page is found."""
    corners, _ = paper_quad(image)
    if corners is None:
        return image
    h, w = shape
    return warp(image, homography(corners, np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)), shape)


def local_contrast(image: np.ndarray, clip: float = C.CONTRAST_CLIP, tiles: int = C.CONTRAST_TILES) -> np.ndarray:
    """Histogram equalisation by tiles: counts above ``clip`` times the mean are dealt to all values, and a pixel blends the
    curves of the four tiles around it."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    tile = np.arange(th * tiles)[:, None] // th * tiles + np.arange(tw * tiles) // tw
    counts = np.bincount((tile * 256 + padded).reshape(-1), minlength=tiles * tiles * 256).reshape(-1, 256).astype(np.float64)
    limit = max(1.0, clip * th * tw / 256)
    over = np.maximum(counts - limit, 0).sum(1, keepdims=True)
    curves = ((np.minimum(counts, limit) + over / 256).cumsum(1) * (255 / (th * tw))).reshape(tiles, tiles, 256)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) / size - 0.5, 0, tiles - 1)
        low = at.astype(int)
        return low, np.minimum(low + 1, tiles - 1), at - low

    (top, bottom, fy), (left, right, fx) = between(h, th), between(w, tw)
    fy = fy[:, None]
    upper = curves[top[:, None], left, image] * (1 - fx) + curves[top[:, None], right, image] * fx
    lower = curves[bottom[:, None], left, image] * (1 - fx) + curves[bottom[:, None], right, image] * fx
    return np.rint(upper * (1 - fy) + lower * fy).clip(0, 255).astype(np.uint8)


def enhanced(image: np.ndarray, radius: int = 31) -> np.ndarray:
    """An unevenly lit or flat scan with its background divided out, blended with the original and its local contrast raised;
    others as they are."""
    if not needs_enhancement(image):
        return image
    pad = np.pad(image.astype(np.float64), radius, mode="edge")
    background = window_sum(pad, 2 * radius + 1, 2 * radius + 1) / (2 * radius + 1) ** 2
    flat = np.clip(image / np.maximum(background, 1) * 255, 0, 255)
    return local_contrast(np.rint(0.65 * flat + 0.35 * image).astype(np.uint8))


def free_rows_below(template: np.ndarray, box: tuple[int, int, int, int], most: int) -> int:
    """Rows below a box that are blank on the template (5 % dark pixels at most), less two."""
    below = template[box[3] : box[3] + most, box[0] : box[2]]
    if not below.size:
        return 0
    printed = np.flatnonzero((below < 200).mean(1) > 0.05)
    return max(0, int(printed[0] if len(printed) else len(below)) - 2)


def row_bands(mask: np.ndarray, gap: int = C.BAND_GAP) -> list[tuple[int, int]]:
    """[start, end) of runs of inked rows no more than ``gap`` apart."""
    rows = np.flatnonzero(mask.any(1))
    cuts = np.flatnonzero(np.diff(rows) > gap)
    return [] if not len(rows) else [(int(rows[a]), int(rows[b - 1]) + 1) for a, b in zip([0, *(cuts + 1)], [*(cuts + 1), len(rows)], strict=True)]


def handwriting_crop(template: np.ndarray, page: np.ndarray, box: tuple[int, int, int, int], left_limit: int = 0, pad: float = 0.20) -> tuple[int, int, int, int] | None:
    """A tight box around what was written in ``box``: at most two bands of ink near each other, padded; None if there is hardly any."""
    x1, y1, x2, y2 = box
    wide = int(0.35 * (y2 - y1))
    x1, x2 = max(left_limit, 0, x1 - wide), min(page.shape[1], x2 + wide)
    y2 = min(page.shape[0], y2 + free_rows_below(template, (x1, y1, x2, y2), y2 - y1))
    mask = without_lines(difference_mask(template[y1:y2, x1:x2], page[y1:y2, x1:x2]))
    if not mask.size or mask.mean() < BLANK_MIN:
        return None
    bands = row_bands(mask)
    keep = bands[:1]
    if len(bands) > 1 and bands[1][0] - bands[0][1] <= 0.9 * (bands[0][1] - bands[0][0]):
        keep = bands[:2]
    top, bottom = keep[0][0], keep[-1][1]
    columns = np.flatnonzero(mask[top:bottom].any(0))
    more = int(pad * (bottom - top)) + 1
    return (max(0, x1 + int(columns[0]) - more), max(0, y1 + top - more), min(page.shape[1], x1 + int(columns[-1]) + 1 + more), min(page.shape[0], y1 + bottom + more))
