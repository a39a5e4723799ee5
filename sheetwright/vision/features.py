"""Key points of a page, their binary descriptors, and the maps that lay one page over another.

Corners are the peaks of the structure tensor's response on a few scales.  A
descriptor is 256 comparisons of smoothed pixels around a corner, turned by the
direction of its intensity centroid; two are compared by Hamming distance.
The maps are found by seeded random consensus, so reruns agree.
"""

from __future__ import annotations

import numpy as np

from sheetwright import constants as C
from sheetwright.vision import kernels

# The ratio of a match's distance to the next best one's, the consensus limit in pixels of the reduced
# pages, the least number of matches and the least side of a page.
RATIO, LIMIT, LEAST_MATCHES, LEAST_SIDE = 0.78, 4.0, 4, 20
#: Key points of a page at most, over all scales.
POINTS = 2000
SCALES = (1.0, 0.83, 0.69, 0.58)
#: Descriptors reach so far from a corner, turned ones by the diagonal.
REACH, MARGIN = 13, 20
_PATTERN = np.clip(np.random.default_rng(20).normal(0, REACH / 2.2, (2, 256, 2)), -REACH, REACH)
_DISC = np.array([(x, y) for y in range(-15, 16) for x in range(-15, 16) if x * x + y * y <= 225])


def resized(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The image at another size; each pixel is the mean of the area it covers."""
    out = image.astype(np.float64)
    for axis in (0, 1):
        edges = np.linspace(0, out.shape[axis], shape[axis] + 1)
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        low = np.minimum(edges.astype(int), out.shape[axis] - 1)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
        out = np.diff(at, axis=axis) * (shape[axis] / out.shape[axis])
    return np.rint(out).clip(0, 255).astype(np.uint8)


def for_matching(image: np.ndarray) -> tuple[np.ndarray, float]:
    """The page with its longer side brought down to MATCH_SIDE, and the factor."""
    scale = min(1.0, C.MATCH_SIDE / max(image.shape))
    return (image if scale == 1.0 else resized(image, tuple(max(1, round(s * scale)) for s in image.shape))), scale


def letterboxed(image: np.ndarray, shape: tuple[int, int], fill: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """The image fitted into a canvas in its own shape, centred, and the mask of what it covers."""
    canvas, mask = np.full(shape, fill, np.uint8), np.zeros(shape, bool)
    if min(image.shape) > 0:
        scale = min(shape[0] / image.shape[0], shape[1] / image.shape[1])
        h, w = (max(1, round(s * scale)) for s in image.shape)
        y, x = (shape[0] - h) // 2, (shape[1] - w) // 2
        canvas[y : y + h, x : x + w] = resized(image, (h, w))
        mask[y : y + h, x : x + w] = True
    return canvas, mask


def _corners(image: np.ndarray, most: int, top: float) -> np.ndarray:
    """(x, y) of the strongest peaks below ``top`` and away from the edges."""
    if min(image.shape) <= 2 * MARGIN:
        return np.zeros((0, 2), int)
    gy, gx = np.gradient(kernels.blur(image, 3))
    xx, yy, xy = (kernels.blur(g, 5) for g in (gx * gx, gy * gy, gx * gy))
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    padded = np.pad(response, 2, constant_values=-np.inf)
    h, w = response.shape
    around = np.max([padded[i : i + h, j : j + w] for i in range(5) for j in range(5)], axis=0)
    peak = (response == around) & (response > 1.0)
    peak[: max(MARGIN, int(np.ceil(top)))] = peak[h - MARGIN :] = False
    peak[:, :MARGIN] = peak[:, w - MARGIN :] = False
    ys, xs = np.nonzero(peak)
    order = np.argsort(-response[ys, xs], kind="stable")[:most]
    return np.stack([xs[order], ys[order]], 1)


def key_points(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, signs): places (x, y) on the page below its head, and 256 signs (1 or -1) for each."""
    places, signs = [np.zeros((0, 2))], [np.zeros((0, 256), np.float32)]
    area = sum(s * s for s in SCALES)
    for scale in SCALES:
        shape = tuple(max(1, round(s * scale)) for s in image.shape)
        small = image if scale == 1.0 else resized(image, shape)
        at = _corners(small, round(POINTS * scale * scale / area), C.HEAD_SHARE * shape[0])
        if not len(at):
            continue
        smooth = kernels.blur(small, 5)
        around = smooth[at[:, 1, None] + _DISC[:, 1], at[:, 0, None] + _DISC[:, 0]]
        turn = np.arctan2(around @ _DISC[:, 1], around @ _DISC[:, 0])
        c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
        a, b = (smooth[at[:, 1, None] + np.rint(s * p[:, 0] + c * p[:, 1]).astype(int), at[:, 0, None] + np.rint(c * p[:, 0] - s * p[:, 1]).astype(int)] for p in _PATTERN)
        places.append((at + 0.5) * [image.shape[1] / shape[1], image.shape[0] / shape[0]] - 0.5)
        signs.append(np.where(a < b, 1, -1).astype(np.float32))
    return np.concatenate(places), np.concatenate(signs)


def clear_matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and their nearest rows of ``b``, where that is nearer than the next by RATIO."""
    if not len(a) or len(b) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    distance = (a.shape[1] - a @ b.T) / 2
    nearest = distance.argmin(1)
    first, second = np.partition(distance, 1, axis=1)[:, :2].T
    clear = np.flatnonzero(first < RATIO * second)
    return clear, nearest[clear]


def homography_fit(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3x3 map of least squares, from centred and scaled points."""

    def centred(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = points.mean(0)
        size = np.sqrt(2) / max(np.hypot(*(points - middle).T).mean(), 1e-9)
        return (points - middle) * size, np.array([[size, 0, -size * middle[0]], [0, size, -size * middle[1]], [0, 0, 1]])

    (p, to_p), (q, to_q) = centred(source), centred(target)
    one, none = np.ones((len(p), 1)), np.zeros((len(p), 3))
    rows = np.vstack([np.hstack([p, one, none, -q[:, :1] * p, -q[:, :1]]), np.hstack([none, p, one, -q[:, 1:] * p, -q[:, 1:]])])
    m = np.linalg.inv(to_q) @ np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 3) @ to_p
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else m


def projected(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Where the map puts the points; infinity for those that it sends behind the page."""
    got = points @ m[:, :2].T + m[:, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(got[:, 2:] > 1e-9, got[:, :2] / got[:, 2:], np.inf)


def robust_homography(source: np.ndarray, target: np.ndarray, limit: float = LIMIT, rounds: int = 400, seed: int = 7) -> tuple[np.ndarray, np.ndarray] | None:
    """(map, inliers) of the best of random fours, fitted again to its inliers; None if no four agree."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(rounds):
        pick = rng.choice(len(source), 4, replace=False)
        inliers = np.hypot(*(projected(homography_fit(source[pick], target[pick]), source) - target).T) <= limit
        if best is None or inliers.sum() > best.sum():
            best = inliers
    if best is None or best.sum() < 4:
        return None
    m = homography_fit(source[best], target[best])
    inliers = np.hypot(*(projected(m, source) - target).T) <= limit
    return (m, inliers) if inliers.sum() >= 4 else None


def spread_and_error(m: np.ndarray, source: np.ndarray, target: np.ndarray, inliers: np.ndarray, shape: tuple[int, int]) -> tuple[float, float | None]:
    """The share of the canvas that the inliers' envelope covers, and their mean distance from where the map puts them."""
    if inliers.sum() < 2:
        return 0.0, None
    wide, tall = np.ptp(target[inliers], axis=0)
    away = np.hypot(*(projected(m, source[inliers]) - target[inliers]).T).mean()
    return float(wide * tall / max(1, shape[0] * shape[1])), float(away)


class Template:
    """A template and its key points, found once for many pages."""

    def __init__(self, image: np.ndarray):
        self.image = image
        self.small, self.scale = for_matching(image)
        self.points, self.signs = key_points(self.small)

    def candidates(self, page: np.ndarray) -> tuple[list[dict], str | None]:
        """Maps from the page to the template in their own pixels, and why there is none."""
        if min(*page.shape, *self.image.shape) < LEAST_SIDE:
            return [], "invalid_dimensions"
        small, scale = for_matching(page)
        points, signs = key_points(small)
        if not len(points) or not len(self.points):
            return [], "features_not_found"
        mine, theirs = clear_matches(signs, self.signs)
        if len(mine) < LEAST_MATCHES:
            return [], "insufficient_matches"
        source, target = points[mine], self.points[theirs]
        similarity, held = kernels.robust_similarity(source, target, LIMIT)
        found = [("affine", np.vstack([similarity, [0, 0, 1]]), held)]
        if (by_four := robust_homography(source, target)) is not None:
            found.append(("homography", *by_four))
        up, down = np.diag([1 / self.scale, 1 / self.scale, 1]), np.diag([scale, scale, 1])
        out = []
        for method, m, inliers in found:
            coverage, error = spread_and_error(m, source, target, inliers, self.small.shape)
            out.append({"method": method, "matches": len(mine), "inliers": int(inliers.sum()), "ratio": float(inliers.mean()), "coverage": coverage, "error": error, "m": (up @ m @ down).reshape(-1).tolist()})
        return out, None
