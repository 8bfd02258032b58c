"""Metrics of decoded pictures (numpy arrays), and hashes of them."""

from __future__ import annotations

import numpy as np


def grey(rgb: np.ndarray) -> np.ndarray:
    """8-bit grey by the BT.601 weights, rounded."""
    return np.floor(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114 + 0.5).astype(np.uint8)


def luminance(rgb: np.ndarray) -> float:
    """Mean by the BT.709 weights."""
    return float((rgb.astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])).mean())


def _around(g: np.ndarray) -> np.ndarray:
    """The picture with a border that mirrors without repeating the edge."""
    return np.pad(g.astype(np.float64), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, mode="edge")


def sharpness(g: np.ndarray) -> float:
    """Mean length of the 3 x 3 Sobel gradient."""
    p = _around(g)
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    return float(np.hypot(gx, gy).mean())


def blur(g: np.ndarray) -> float:
    """Variance of the Laplacian; small means blurred."""
    p = _around(g)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def uniformity(g: np.ndarray, guard: float = 1e-6) -> float:
    """Share of the pixels in the fullest 5 % of 256 grey values."""
    n = np.sort(np.bincount(g.ravel(), minlength=256))[::-1]
    return float(n[: int(0.05 * 256)].sum() / (n.sum() + guard))


def resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means on a grid, each source pixel in one cell of it."""
    rows, cols = (np.arange(k + 1) * n // k for k, n in ((height, g.shape[0]), (width, g.shape[1])))
    sums = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    sums[1:, 1:] = np.cumsum(np.cumsum(g.astype(np.float64), axis=0), axis=1)
    area = np.diff(rows)[:, None] * np.diff(cols)[None]
    block = sums[np.ix_(rows[1:], cols[1:])] - sums[np.ix_(rows[:-1], cols[1:])] - sums[np.ix_(rows[1:], cols[:-1])] + sums[np.ix_(rows[:-1], cols[:-1])]
    return block / np.maximum(area, 1)


def _words(bits: np.ndarray) -> list[int]:
    return np.packbits(bits.ravel()).view(">u8").astype(np.uint64).view(np.int64).tolist()


def difference_hash(g: np.ndarray) -> list[int]:
    """64 bits: a cell is brighter than the one to its left, on 8 x 9 cells. As signed words."""
    small = resized(g, 8, 9)
    return _words(small[:, 1:] > small[:, :-1])


def average_hash(g: np.ndarray, size: int = 16) -> list[int]:
    """size x size bits: a cell is brighter than the mean."""
    small = resized(g, size, size)
    return _words(small > small.mean())


def colour_histogram(rgb: np.ndarray, bins: int = 16) -> np.ndarray:
    """Shares of bins^3 colours."""
    k = (rgb.astype(np.int64) * bins) >> 8
    n = np.bincount(((k[..., 0] * bins + k[..., 1]) * bins + k[..., 2]).ravel(), minlength=bins**3)
    return (n / (n.sum() + 1e-6)).astype(np.float32)


def edges(g: np.ndarray, low: float = 60, high: float = 180) -> np.ndarray:
    """Edge map: Sobel gradients (|gx| + |gy|), thinned to ridges across the gradient, where ridges above `high` and
    what is connected to them above `low` count."""
    p = np.pad(g.astype(np.int32), 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    strength = np.abs(gx) + np.abs(gy)
    m = np.pad(strength, 1)
    slope = np.abs(gy) / np.maximum(np.abs(gx), 1e-9)
    near = lambda dy, dx: m[1 + dy : 1 + dy + g.shape[0], 1 + dx : 1 + dx + g.shape[1]]
    flat, steep, falling = slope < np.tan(np.pi / 8), slope > np.tan(3 * np.pi / 8), (gx > 0) == (gy > 0)
    before = np.select([flat, steep, falling], [near(0, -1), near(-1, 0), near(-1, -1)], near(-1, 1))
    after = np.select([flat, steep, falling], [near(0, 1), near(1, 0), near(1, 1)], near(1, -1))
    ridge = (strength > before) & (strength >= after) & (strength > low)
    strong = ridge & (strength > high)
    while True:
        grown = np.pad(strong, 1)
        around = np.zeros_like(strong)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                around |= grown[dy : dy + g.shape[0], dx : dx + g.shape[1]]
        more = ridge & around
        if (more == strong).all():
            return strong
        strong = more


def texture(g: np.ndarray, width: int = 160) -> float:
    """Percentage of edge pixels, on at most `width` columns."""
    h, w = g.shape
    if w > width:
        g = np.floor(resized(g, max(1, int(h * width / w)), width) + 0.5).astype(np.uint8)
    return float(edges(g).mean() * 100)


def frame_metrics(rgb: np.ndarray) -> dict[str, float]:
    """The four metrics of the quality cascade from one decoded picture."""
    g = grey(rgb)
    return {"luminance": luminance(rgb), "sharpness": sharpness(g), "uniformity": uniformity(g), "texture": texture(g)}
