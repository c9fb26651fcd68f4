"""Starlets on the arrays of tiles: (..., y, x), zero outside, with the arithmetic of the window functions; images of one shape lie behind each other."""

from __future__ import annotations

import numpy as np


def along(c: np.ndarray, axis: int, scale: int) -> np.ndarray:
    """``c`` smoothed along an axis (-2: y, -1: x) by (1, 4, 6, 4, 1) / 16 with gaps of 2 ** scale."""
    step, n = 2**scale, c.shape[axis]
    wide = np.pad(c, [(2 * step, 2 * step) if a == c.ndim + axis else (0, 0) for a in range(c.ndim)])
    at = lambda d: wide[(..., slice(d, d + n), slice(None)) if axis == -2 else (..., slice(d, d + n))]
    near, far = at(step) + at(3 * step), at(0) + at(4 * step)
    return (far + 4 * near + 6 * c) / 16


def smooth(c: np.ndarray, scales: list[int], present: np.ndarray) -> np.ndarray:
    """All passes along y, then all along x; what isn't ``present`` stays zero."""
    for axis in (-2, -1):
        for scale in scales:
            c = np.where(present, along(c, axis, scale), 0.0)
    return c


def reach(scales: list[int]) -> int:
    """How far the passes of ``smooth`` look."""
    return sum(2 * 2**s for s in scales)


def transform(c: np.ndarray, scales: int, generation: int, present: np.ndarray) -> np.ndarray:
    """Planes 0..scales in front of the axes of ``c``."""
    low = [smooth(c, list(range(j + 1)), present) for j in range(scales)]
    if generation == 2:
        taken = [smooth(c, [*range(j + 1), j], present) for j in range(scales)]
    else:
        taken = low
    return np.stack([a - b for a, b in zip([c, *low[:-1]], taken, strict=True)] + low[-1:]) if scales else c[None]


def reconstruct(w: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The image of second-generation planes."""
    total = w[0]
    for j in range(1, len(w)):
        total = total + smooth(w[j], list(reversed(range(j))), present)
    return total


def noise_levels(w: np.ndarray, present: np.ndarray, sigma: np.ndarray, k: float, epsilon: float, max_iter: int) -> np.ndarray:
    """(scale, image): each plane's deviation of what isn't significant, until none of its image's changes by ``epsilon`` or more."""
    levels = np.tile(np.asarray(sigma, float), (len(w), 1))
    n = present.sum(axis=(-2, -1))
    open_ = np.arange(w.shape[1])
    for _ in range(max_iter - 1):
        now, there = levels[:, open_, None, None], present[open_]
        quiet = np.where((np.abs(w[:, open_]) <= k * now) & there, w[:, open_], 0.0)
        mean = quiet.sum(axis=(-2, -1)) / n[open_]
        new = np.sqrt((np.where(there, quiet - mean[..., None, None], 0.0) ** 2).sum(axis=(-2, -1)) / n[open_])
        moved = (np.abs(new - levels[:, open_]) >= epsilon * new) & (new > 0)
        open_, new = open_[moved.any(axis=0)], new[:, moved.any(axis=0)]
        levels[:, open_] = new
        if not len(open_):
            break
    return levels


def support(w: np.ndarray, present: np.ndarray, sigma: np.ndarray, k: float = 3, epsilon: float = 0.1, max_iter: int = 20) -> np.ndarray:
    return (np.abs(w) > k * noise_levels(w, present, sigma, k, epsilon, max_iter)[..., None, None]) & present


def spread(c: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Each image's median absolute deviation from its median."""
    out = []
    for image, there in zip(c, present, strict=True):
        v = image[there]
        out.append(np.median(np.abs(v - np.median(v))))
    return np.array(out)


def denoise(c: np.ndarray, present: np.ndarray, scales: int, sigma: np.ndarray, k: float, epsilon: float, max_iter: int, positive: bool) -> np.ndarray:
    w = transform(c, scales, 2, present)
    kept = support(w, present, sigma, k, epsilon, max_iter)
    x = reconstruct(w, present)
    for _ in range(max_iter):
        x = x + reconstruct(np.where(kept, w - transform(x, scales, 2, present), 0.0), present)
        if positive:
            x = np.maximum(x, 0.0)
    return x


def spread_by(c: np.ndarray, there: np.ndarray, known: np.ndarray, k: np.ndarray, inside: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Rows, columns and (image, y, x) sums of pixels moved by a symmetric kernel along y and x; which places any pixel reaches, and which a known one.

    ``inside`` has the first and last row and column that count, from the corner of ``c``; they may lie beyond it.
    """
    r, (h, w) = len(k) // 2, c.shape[-2:]
    y, x = (np.arange(max(low, -r), min(high, n - 1 + r) + 1) for low, high, n in ((*inside[:2], h), (*inside[2:], w)))
    rows, columns = slice(y[0] + r, y[-1] + r + 1) if len(y) else slice(0, 0), slice(x[0] + r, x[-1] + r + 1) if len(x) else slice(0, 0)

    def summed(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
        for axis, keep in ((-2, rows), (-1, columns)):
            out = np.zeros([n + 2 * r if i == a.ndim + axis else n for i, n in enumerate(a.shape)])
            for i, weight in enumerate(weights):
                out[(..., slice(i, i + a.shape[-2]), slice(None)) if axis == -2 else (..., slice(i, i + a.shape[-1]))] += weight * a
            a = out[(..., keep, slice(None)) if axis == -2 else (..., keep)]
        return a

    def reached(a: np.ndarray) -> np.ndarray:
        return np.ones((len(a), len(y), len(x)), bool) if a.all() else summed(a.astype(float), np.ones(len(k))) > 0

    grown = reached(there)
    return y, x, summed(c, k), grown, grown if known is there or (known == there).all() else reached(known)


def targets(m: tuple[float, ...], ys: tuple[int, int], xs: tuple[int, int], ny: int, nx: int) -> tuple[int, int, int, int]:
    """First and last (exclusive) row and column of the target pixels that an affine mapping may take into ``ys`` x ``xs``; all of them if it can't be inverted."""
    yy, yx, xy, xx, y0, x0 = m
    det = yy * xx - yx * xy
    if not np.isfinite(det) or abs(det) < 1e-9 * (abs(yy * xx) + abs(yx * xy)):
        return 0, ny, 0, nx
    corners = [(a - y0, b - x0) for a in ys for b in xs]
    ty, tx = ([(xx * a - yx * b) / det for a, b in corners], [(yy * b - xy * a) / det for a, b in corners])
    clipped = lambda v, n: int(min(max(np.floor(v), 0), n))
    return clipped(min(ty) - 1, ny), clipped(max(ty) + 2, ny), clipped(min(tx) - 1, nx), clipped(max(tx) + 2, nx)


def resampled_at(c: np.ndarray, there: np.ndarray, known: np.ndarray, ay: np.ndarray, ax: np.ndarray, y0: int, x0: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, place) sums by windowed sincs of the pixels within ``window`` of each place (ay, ax), which places any pixel is near, and which a known one.

    The corner of ``c`` is at (y0, x0); places lie so far within that all pixels that count are in ``c``.
    """
    fy, fx = np.floor(ay).astype(np.int64), np.floor(ax).astype(np.int64)
    total, met, full = np.zeros((len(c), len(ay))), np.zeros((len(c), len(ay)), bool), np.zeros((len(c), len(ay)), bool)

    def sinc(t: np.ndarray) -> np.ndarray:
        small = np.abs(t) < 1e-12
        return np.where(small, 1.0, np.sin(np.pi * t) / np.where(small, 1.0, np.pi * t))

    weights = [[(f + d, (a - (f + d)), sinc(a - (f + d)) * sinc((a - (f + d)) / window)) for d in range(1 - window, window + 1)] for a, f in ((ay, fy), (ax, fx))]
    for y, ty, wy in weights[0]:
        for x, tx, wx in weights[1]:
            near = (np.abs(ty) < window) & (np.abs(tx) < window)
            at = (slice(None), np.where(near, y - y0, 0), np.where(near, x - x0, 0))
            total += np.where(near, c[at] * (wy * wx), 0.0)
            met |= near & there[at]
            if known is not there:
                full |= near & known[at]
    return total, met, met if known is there else full
