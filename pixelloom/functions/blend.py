"""The arithmetic of one step of a fit on dense arrays: rendering, gradients, proximal steps, box sizes.

Spark brings the components and the pixels of a tile together (``pixelloom.operators.blocks``); these helpers only see what lies there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

FLOOR = 1e-20  # of seds and of a morphology's centre
AT_ONCE = 1 << 20  # pixels of boxes that become monotonic at once
NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def shifted(a: np.ndarray, entries: list[tuple[int, int, float]], sign: int = 1) -> np.ndarray:
    """The sum of ``a`` (one plane or several) moved by every kernel entry; what leaves the array is lost."""
    out = np.zeros_like(a)
    h, w = a.shape[-2:]
    for dy, dx, k in entries:
        dy, dx = sign * dy, sign * dx
        if abs(dy) < h and abs(dx) < w:
            out[..., max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] += k * a[..., max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def smooth(a: np.ndarray, scale: int) -> np.ndarray:
    """The separable (1, 4, 6, 4, 1) / 16 stencil with gaps of 2 ** scale; zero outside. Its own adjoint."""
    step = 2**scale
    for axes in ("y", "x"):
        a = shifted(a, [(i * step, 0, k) if axes == "y" else (0, i * step, k) for i, k in zip(range(-2, 3), (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16), strict=True)])
    return a


def weighted_planes(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """The sum of first-generation starlet planes by weight."""
    out, c = np.zeros_like(a), a
    for j, w in enumerate(weights[:-1]):
        after = smooth(c, j)
        out += w * (c - after)
        c = after
    return out + weights[-1] * c


def reconstructed(coeffs: np.ndarray) -> np.ndarray:
    """The image of second-generation starlet planes (scales + 1, ny, nx)."""
    c = coeffs[-1]
    for j in reversed(range(len(coeffs) - 1)):
        c = smooth(c, j) + coeffs[j]
    return c


def reconstructed_adjoint(g: np.ndarray, scales: int) -> np.ndarray:
    """The adjoint of ``reconstructed``: <R w, g> = <w, R' g>."""
    planes = [g]
    for j in range(scales):
        planes.append(smooth(planes[-1], j))
    return np.array(planes)


def decomposed(a: np.ndarray, scales: int) -> np.ndarray:
    """Second-generation starlet planes."""
    planes, c = [], a
    for j in range(scales):
        after = smooth(c, j)
        planes.append(c - smooth(after, j))
        c = after
    return np.array([*planes, c])


def thresholded(coeffs: np.ndarray, thresh: float) -> np.ndarray:
    """Planes where only positive coefficients above thresh x the plane's norm are left; the last plane stays."""
    norms = np.sqrt((coeffs**2).sum(axis=(1, 2), keepdims=True))
    kept = np.where((coeffs > 0) & (coeffs > thresh * norms), coeffs, 0.0)
    kept[-1] = coeffs[-1]
    return kept


@functools.lru_cache(maxsize=512)
def rings(ny: int, nx: int, cy: int, cx: int, weight: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the inside out: places, their inner neighbours (flat) and their weights, for one shape and centre.

    Rings of different radii come together as one step where none of their pixels waits for another: a few steps a row instead of one for each radius.
    """
    y, x = (a.ravel() for a in np.mgrid[:ny, :nx])
    ry, rx = y - cy, x - cx
    d2 = ry**2 + rx**2
    step = np.zeros(ny * nx, np.int64)
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    order = np.argsort(d2, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(d2[order])) + 1):
        r = d2[at[0]]
        if r == 0:
            continue
        near, share = np.zeros((len(at), 8), np.int64), np.zeros((len(at), 8))
        for i, (dy, dx) in enumerate(NEIGHBOURS):
            cos = -(dy * ry[at] + dx * rx[at]) / math.sqrt(float(r * (dy * dy + dx * dx)))
            ny_, nx_ = y[at] + dy, x[at] + dx
            fits = (ny_ >= 0) & (ny_ < ny) & (nx_ >= 0) & (nx_ < nx) & ((ry[at] + dy) ** 2 + (rx[at] + dx) ** 2 < r) & (np.abs(cos) > 1e-12)
            near[fits, i] = (ny_ * nx + nx_)[fits]
            share[fits, i] = 1.0 if weight == "flat" else cos[fits]
        step[at] = 1 + np.where(share != 0, step[near], 0).max(axis=1)
        total = share.sum(axis=1)
        has = total > 0
        at, near, share = at[has], near[has], share[has] / total[has, None]
        for n in np.unique(step[at]).tolist():
            own = step[at] == n
            held.setdefault(n, []).append((at[own], near[own], share[own]))
    return [tuple(np.concatenate(part) for part in zip(*held[n], strict=True)) for n in sorted(held)]


def monotonic(m: np.ndarray, cy: int, cx: int, weight: str = "angle", min_gradient: float = 0) -> np.ndarray:
    """Each pixel at most (1 - g) times the weighted mean of its strictly closer neighbours, ring by ring."""
    flat = m.ravel().copy()
    for at, near, share in rings(*m.shape, cy, cx, weight):
        flat[at] = np.minimum(flat[at], (flat[near] * share).sum(axis=1) * (1 - min_gradient))
    return flat.reshape(m.shape)


def monotonic_all(m: np.ndarray, cy: int, cx: int, weight: str = "angle", min_gradient: float = 0) -> np.ndarray:
    """``monotonic`` of several planes of one shape and centre at once, (n, ny, nx), with sums in the same order."""
    flat = m.reshape(len(m), -1).T.copy()
    for at, near, share in rings(*m.shape[1:], cy, cx, weight):
        w = flat[near] * share[:, :, None]
        total = ((w[:, 0] + w[:, 1]) + (w[:, 2] + w[:, 3])) + ((w[:, 4] + w[:, 5]) + (w[:, 6] + w[:, 7]))
        flat[at] = np.minimum(flat[at], total * (1 - min_gradient))
    return np.ascontiguousarray(flat.T).reshape(m.shape)


def reached(m: np.ndarray, cy: int, cx: int) -> np.ndarray:
    """Pixels that 4-paths from the centre reach with each value below the one before, and above 0; the centre too."""
    ok = np.zeros(m.shape, bool)
    ok[cy, cx] = True
    while True:
        grown = ok.copy()
        grown[1:] |= ok[:-1] & (m[1:] < m[:-1])
        grown[:-1] |= ok[1:] & (m[:-1] < m[1:])
        grown[:, 1:] |= ok[:, :-1] & (m[:, 1:] < m[:, :-1])
        grown[:, :-1] |= ok[:, 1:] & (m[:, :-1] < m[:, 1:])
        grown &= (m > 0) | ok
        if (grown == ok).all():
            return ok
        ok = grown


def moved_center(m: np.ndarray, cy: int, cx: int, radius: int) -> tuple[int, int]:
    """The brightest pixel within ``radius`` rows and columns of a centre (the first of equal ones)."""
    y0, x0 = max(cy - radius, 0), max(cx - radius, 0)
    part = m[y0 : cy + radius + 1, x0 : cx + radius + 1]
    y, x = np.unravel_index(int(part.argmax()), part.shape)
    return y0 + int(y), x0 + int(x)


@dataclass
class How:
    """What a fit does in each iteration."""

    scheme: str = "amsgrad"
    sed_step: float = 0.01
    morph_step: float = 0.01
    bg_thresh: float | None = None
    constrained: bool = True
    plane_weights: list[float] | None = None
    resize: int | None = 10
    e_rel: float = 1e-4
    min_iter: int = 1
    prox_iter: int = 1
    prox_e_rel: float = 1e-6
    center_radius: int = 0
    use_mask: bool = False
    edge_pull: float | None = None
    scales: int | None = None
    thresh: float = 5e-3
    cut: bool = False


@dataclass
class Observed:
    """One observation within a tile: the numbers of its bands, arrays over the region, kernel entries by band."""

    bands: list[int]
    value: np.ndarray
    weight: np.ndarray
    present: np.ndarray
    kernels: list[list[tuple[int, int, float]]]


@dataclass
class Component:
    """A component: where its box lies, seds by band, the morphology (or its starlet planes) and the moments of both."""

    key: tuple[int, int]
    y0: int
    x0: int
    cy: int
    cx: int
    sed: np.ndarray
    sed_moments: list[np.ndarray]
    param: np.ndarray
    moments: list[np.ndarray]
    rms: np.ndarray | None
    it: int = 0
    t: float = 1.0
    last: float | None = None
    settled: bool = False
    losses: list[float] = field(default_factory=list)

    @property
    def m(self) -> np.ndarray:
        return self.param if self.param.ndim == 2 else reconstructed(self.param)

    def overlap(self, region: tuple[int, int, int, int]) -> tuple[tuple[slice, slice], tuple[slice, slice]] | None:
        """Slices of the box and of the region (y0, x0, y1, x1) where both are."""
        ny, nx = self.param.shape[-2:]
        a, b, c, d = max(self.y0, region[0]), max(self.x0, region[1]), min(self.y0 + ny, region[2]), min(self.x0 + nx, region[3])
        if a >= c or b >= d:
            return None
        return (slice(a - self.y0, c - self.y0), slice(b - self.x0, d - self.x0)), (slice(a - region[0], c - region[0]), slice(b - region[1], d - region[1]))


def gradient(components: list[Component], seen: list[Observed], region: tuple[int, int, int, int], core: tuple[int, int, int, int], n_bands: int, plane_weights: list[float] | None) -> tuple[np.ndarray, float]:
    """The gradient of the loss by the model over a region, and the loss of its core."""
    shape = (n_bands, region[2] - region[0], region[3] - region[1])
    model, g, loss = np.zeros(shape), np.zeros(shape), 0.0
    for c in components:
        at = c.overlap(region)
        if at:
            model[:, at[1][0], at[1][1]] += c.sed[:, None, None] * c.m[at[0]]
    inner = (slice(core[0] - region[0], core[2] - region[0]), slice(core[1] - region[1], core[3] - region[1]))
    for o in seen:
        for alike in by_kernel(o.kernels):
            bands = [o.bands[i] for i in alike]
            present, value, weight = (np.array([a[i] for i in alike]) for a in (o.present, o.value, o.weight))
            r = np.where(present, shifted(model[bands] * present, o.kernels[alike[0]]) - value, 0.0)
            rest = weight * r
            loss += sum(float(a[inner].sum()) / 2 for a in rest * r)
            if plane_weights is not None:
                rest = weighted_planes(rest, plane_weights)
            g[bands] += shifted(rest, o.kernels[alike[0]], -1)
    return g, loss


def by_kernel(kernels: list[list[tuple[int, int, float]]]) -> list[list[int]]:
    """Numbers of equal kernels (entries in the same order) together, so that their bands are taken at once."""
    alike: list[list[int]] = []
    for i, k in enumerate(kernels):
        same = next((a for a in alike if kernels[a[0]] == k), None)
        alike.append([i]) if same is None else same.append(i)
    return alike


def shares(c: Component, g: np.ndarray, region: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A component's gradients by its seds and by its morphology."""
    by_sed, by_morph = np.zeros(len(c.sed)), np.zeros(c.param.shape[-2:])
    at = c.overlap(region)
    if at:
        part = g[:, at[1][0], at[1][1]]
        by_sed = (part * c.m[at[0]]).sum(axis=(1, 2))
        by_morph[at[0]] = np.tensordot(c.sed, part, 1)
    return by_sed, by_morph


def directions(g: np.ndarray, moments: list[np.ndarray], it: int, scheme: str, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, p: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """phi and psi of an adaptive scheme; the moments move on."""
    t = it + 1
    moments[0], moments[1] = b1 * moments[0] + (1 - b1) * g, b2 * moments[1] + (1 - b2) * g * g
    if scheme in ("amsgrad", "padam", "adamx"):
        moments[2] = np.maximum(moments[2], moments[1])
        return moments[0], (moments[2] ** p if scheme == "padam" else np.sqrt(moments[2])) + eps
    second = np.sqrt(moments[1] / (1 - b2**t))
    if scheme == "nadam":
        return (b1 * moments[0] + (1 - b1) * g) / (1 - b1**t), second + eps
    first = moments[0] / (1 - b1**t)
    if scheme == "adam":
        return first, second + eps
    top = 2 / (1 - b2) - 1
    rho = top - 2 * t * b2**t / (1 - b2**t)
    if rho > 4:
        return first * math.sqrt((rho - 4) * (rho - 2) * top / ((top - 4) * (top - 2) * rho)), second + eps
    return first, np.ones_like(g)


def proximal(x: np.ndarray, psi: np.ndarray, step: float, prox, most: int, e_rel: float) -> np.ndarray:
    """z settles at prox(z - gamma / step psi (z - x)) with gamma = step / max psi, so that the projection honours each pixel's own step."""
    z, pull = x, psi / psi.max()
    for _ in range(most):
        after = prox(z - pull * (z - x))
        settled = ((after - z) ** 2).sum() <= e_rel**2 * (z**2).sum()
        z = after
        if settled:
            break
    return z


def constrained_shape(c: Component, m: np.ndarray, how: How) -> np.ndarray:
    """Monotonic, above the background (or positive), with a floor at the box's middle and a maximum of 1."""
    cy, cx = c.cy - c.y0, c.cx - c.x0
    if how.center_radius:
        cy, cx = moved_center(m, cy, cx, how.center_radius)
        c.cy, c.cx = cy + c.y0, cx + c.x0
    before = m
    m = monotonic(m, cy, cx)
    if how.use_mask:
        keep = reached(before, cy, cx)
        m = np.where(keep, before, m)
    return bounded_shape(c, m, how)


def bounded_shape(c: Component, m: np.ndarray, how: How) -> np.ndarray:
    """A monotonic morphology above the background (or positive), with a floor at the box's middle and a maximum of 1."""
    ny, nx = m.shape
    if how.cut and c.rms is not None:
        bright = c.sed > 0
        least = (how.bg_thresh * c.rms[bright] / c.sed[bright]).min() if bright.any() else np.inf
        m = np.where(m >= least, m, 0.0)
    else:
        m = np.maximum(m, 0.0)
    m[ny // 2, nx // 2] = max(m[ny // 2, nx // 2], FLOOR)
    return m / m.max()


def advance(c: Component, by_sed: np.ndarray, by_morph: np.ndarray, how: How, mean_weight: float) -> None:
    """One step of a component: the SED along its gradient, the morphology along its own, then their constraints."""
    moved, psi, step, finish = moved_by(c, by_sed, by_morph, how, mean_weight)
    if c.param.ndim == 3:
        prox = lambda w: thresholded(w, how.thresh)
    else:
        prox = lambda m: constrained_shape(c, m, how)
    finish(proximal(moved, psi, step, prox, how.prox_iter, how.prox_e_rel) if how.constrained else moved)


def advance_all(steps: list[tuple[Component, np.ndarray, np.ndarray, float]], how: How) -> None:
    """``advance`` for many components, of any images: boxes of one shape and centre become monotonic at once."""
    if not how.constrained or how.prox_iter != 1 or how.center_radius or how.use_mask or any(c.param.ndim == 3 for c, *_ in steps):
        for c, by_sed, by_morph, mean_weight in steps:
            advance(c, by_sed, by_morph, how, mean_weight)
        return
    alike: dict[tuple, list[tuple]] = {}
    for c, by_sed, by_morph, mean_weight in steps:
        moved, _, _, finish = moved_by(c, by_sed, by_morph, how, mean_weight)
        alike.setdefault((*moved.shape, c.cy - c.y0, c.cx - c.x0), []).append((c, moved, finish))
    for (ny, nx, cy, cx), some in alike.items():
        most = max(1, AT_ONCE // (ny * nx))
        for part in (some[i : i + most] for i in range(0, len(some), most)):
            for (c, _, finish), m in zip(part, monotonic_all(np.array([moved for _, moved, _ in part]), cy, cx), strict=True):
                finish(bounded_shape(c, m, how))


def moved_by(c: Component, by_sed: np.ndarray, by_morph: np.ndarray, how: How, mean_weight: float) -> tuple[np.ndarray, np.ndarray, float, Callable[[np.ndarray], None]]:
    """A step without the morphology's constraints: where it would go, psi and the step, and what takes the constrained one; the SED has moved."""
    if c.param.ndim == 3:
        by_param, old = reconstructed_adjoint(by_morph, len(c.param) - 1), c.m
    else:
        by_param, old = by_morph, c.param
    lift = (lambda s: np.maximum(s, FLOOR)) if how.constrained else (lambda s: s)
    old_sed, later = c.sed, 0.5 * (1 + math.sqrt(1 + 4 * c.t * c.t))
    if how.scheme == "fista":
        if not c.it:
            c.sed_moments[0], c.moments[0] = c.sed.copy(), c.param.copy()
        steps = [1 / (2 * mean_weight) / max(float((a * a).sum()), 1e-300) for a in (old, old_sed)]
        new_sed, psi, step = lift(c.sed_moments[0] - steps[0] * by_sed), np.ones_like(by_param), steps[1]
        moved = c.moments[0] - step * by_param
    else:
        first = 10 if c.it == 0 else 1
        phi, psi = directions(by_sed, c.sed_moments, c.it, how.scheme)
        step = max(1e-12, how.sed_step * float(c.sed.mean()))
        moved_sed = c.sed - step * phi / psi / first
        new_sed = proximal(moved_sed, psi, step, lift, how.prox_iter, how.prox_e_rel)
        phi, psi = directions(by_param, c.moments, c.it, how.scheme)
        step = max(1e-12, how.morph_step * float(c.param.mean()))
        moved = c.param - step * phi / psi / first
    c.sed = new_sed

    def finish(param: np.ndarray) -> None:
        old_param, c.param = c.param, param
        if how.scheme == "fista":
            w = 1 + (c.t - 1) / later
            c.sed_moments[0], c.moments[0], c.t = old_sed + w * (c.sed - old_sed), old_param + w * (c.param - old_param), later

    return moved, psi, step, finish


def resized(c: Component, how: How) -> None:
    """Cut empty borders down to the ladder of box sizes (21, 31, ...), or grow a step where one of four edges is bright or pulled outwards.

    An edge is bright when its flux per positive pixel exceeds thresh x rms in a band. With ``edge_pull`` a box also grows where the first moment of an
    edge asks for more: the mean of -m1 / sqrt(m2hat) over the edge is above it. New pixels and moments are 0.
    """
    ny, nx = c.param.shape
    my, mx = ny // 2, nx // 2
    y, x = np.mgrid[:ny, :nx]
    far = np.maximum(np.abs(y - my), np.abs(x - mx))
    edge, reach = int(far.max()), int(far[c.param > 0].max(initial=0))
    rows = [(slice(None), 0), (slice(None), nx - 1), (0, slice(None)), (ny - 1, slice(None))]
    bright = float((c.sed / c.rms).max()) if c.rms is not None else 0.0
    thresh = 1.0 if how.bg_thresh is None else how.bg_thresh
    grows = any((e > 0).any() and e.sum() / (e > 0).sum() * bright > thresh for e in (c.param[r] for r in rows))
    if how.edge_pull is not None and not grows:
        pull = -c.moments[0] / (np.sqrt(c.moments[2]) + 1e-8)
        grows = any(float(pull[r].mean()) > how.edge_pull for r in rows)
    size = 2 * edge + 11 if grows else 2 * reach + 1
    box = 21 + 10 * math.ceil(max(0, size - 21) / 10)
    half = box // 2 if grows else min(box // 2, edge)

    def fitted(a: np.ndarray) -> np.ndarray:
        out = np.zeros((2 * half + 1, 2 * half + 1))
        low, high = max(0, my - half), max(0, mx - half)
        part = a[low : my + half + 1, high : mx + half + 1]
        oy, ox = half - my + low, half - mx + high
        out[oy : oy + part.shape[0], ox : ox + part.shape[1]] = part
        return out

    c.param, c.moments = fitted(c.param), [fitted(a) for a in c.moments]
    c.y0, c.x0 = c.y0 + my - half, c.x0 + mx - half


def after_step(c: Component, loss: float, how: How) -> None:
    """Box sizes, the stopping rule and the iteration count after a step."""
    if how.resize and c.it and c.it % how.resize == 0 and c.param.ndim == 2:
        resized(c, how)
    if c.last is not None and c.it > how.min_iter and abs(loss - c.last) < how.e_rel * abs(loss):
        c.settled = True
    c.last, c.it = loss, c.it + 1
