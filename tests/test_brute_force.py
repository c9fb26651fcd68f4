"""Wavelets, detection, constraints and fits against plain NumPy on small images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions.grid import densify
from pixelloom.operators import constrain, detect, fit, stencil

PIXELS = "image_id long, band string, y int, x int, value double, variance double"
MORPHS = "image_id long, source_id long, comp_id int, y int, x int, m double"
SEDS = "image_id long, source_id long, comp_id int, band string, sed double"


def smooth(a, scale):
    step = 2**scale
    for axis in (0, 1):
        a = np.moveaxis(a, axis, 0)
        out = 6 * a
        for gap, k in ((step, 4), (2 * step, 1)):
            if gap < len(a):
                out[gap:] += k * a[:-gap]
                out[:-gap] += k * a[gap:]
        a = np.moveaxis(out / 16, 0, axis)
    return a


def planes_of(a, scales, generation=2):
    out, c = [], a
    for j in range(scales):
        d = smooth(c, j)
        out.append(c - (smooth(d, j) if generation == 2 else d))
        c = d
    return np.array([*out, c])


def rebuilt(p):
    c = p[-1]
    for j in reversed(range(len(p) - 1)):
        c = smooth(c, j) + p[j]
    return c


def support(p, sigma, k=3, epsilon=0.1, rounds=20):
    s = np.full(len(p), sigma)
    for _ in range(rounds - 1):
        new = np.array([np.where(np.abs(x) <= k * t, x, 0).std() for x, t in zip(p, s, strict=True)])
        if all(n <= 0 or abs(n - t) / n < epsilon for n, t in zip(new, s, strict=True)):
            break
        s = new
    return np.array([np.abs(x) > k * t for x, t in zip(p, s, strict=True)])


def regions(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start]:
            continue
        seen[start], front, found = True, [start], []
        while front:
            y, x = front.pop()
            found.append((int(y), int(x)))
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= min(p) and p[0] < mask.shape[0] and p[1] < mask.shape[1] and mask[p] and not seen[p]:
                    seen[p] = True
                    front.append(p)
        out.append(sorted(found))
    return out


def kept_regions(mask, least=4):
    return [r for r in regions(mask) if len(r) >= least and np.prod(np.ptp(np.array(r), axis=0) + 1) > least]


def peaks_of(a, region):
    own = set(region)
    near = lambda p: [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    return {p for p in region if all(a[p] > a[q] for q in near(p) if q in own)}


@pytest.fixture(scope="module")
def scene(spark):
    """Two bands of one image with sources and noise, dense."""
    rng = np.random.default_rng(21)
    y, x = np.mgrid[:24, :28]
    shapes = [np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * s * s)) for a, b, s in ((6, 7, 1.5), (15, 18, 2.5), (17, 6, 1.2))]
    bands = [sum(f * s for f, s in zip(flux, shapes, strict=True)) + rng.normal(0, 0.5, (24, 28)) for flux in ((40, 25, 30), (15, 35, 10))]
    rows = [(3, "gr"[b], int(i), int(j), float(a[i, j]), 0.25) for b, a in enumerate(bands) for i in range(24) for j in range(28)]
    return np.array(bands), spark.createDataFrame(rows, PIXELS)


def cube(rows, planes, shape, value="value"):
    out = np.full((planes, *shape), np.nan)
    for r in rows:
        out[r["scale"], r["y"], r["x"]] = r[value]
    return out


def test_wavelet_denoise(spark, scene):
    a, df = scene
    found = stencil.wavelet_denoise(df, 3).collect()
    for b, image in zip("gr", a, strict=True):
        p = planes_of(image, 3)
        m = support(p, np.median(np.abs(image - np.median(image))))
        x = rebuilt(p)
        for _ in range(20):
            x = np.maximum(x + rebuilt(m * (p - planes_of(x, 3))), 0)
        got = np.zeros(image.shape)
        for r in found:
            if r.band == b:
                got[r.y, r.x] = r.value
        assert np.allclose(got, x, atol=1e-6)


def test_wavelets_of_bands_and_of_their_sum(spark, scene):
    a, df = scene
    found = stencil.band_wavelets(df, 3).collect()
    for b, image in zip("gr", a, strict=True):
        p = planes_of(image, 3)
        assert np.allclose(cube([r for r in found if r.band == b], 4, image.shape), p * support(p, 0.5))
    p = planes_of(a.sum(axis=0), 3)
    assert np.allclose(cube(stencil.detect_wavelets(df, 3).collect(), 4, a[0].shape), p * support(p, 0.5))


def test_footprints_structures_and_peaks_of_scales(spark, scene):
    a, df = scene
    p = planes_of(a.sum(axis=0), 3)
    p = p * support(p, 0.5)
    coeffs = stencil.detect_wavelets(df, 3)
    table, inside = detect.scale_footprints(coeffs, 3)
    own = {s: kept_regions(p[s] > 0) for s in range(3)}
    got = {}
    for r in inside.collect():
        got.setdefault((r.scale, r.label), []).append((r.y, r.x))
    for s in range(3):
        assert sorted(sorted(v) for (k, _), v in got.items() if k == s) == sorted(own[s])
    box = lambda r: (*np.min(r, axis=0), *(np.max(r, axis=0) + 1))
    meet = lambda u, v: u[0] < v[2] and v[0] < u[2] and u[1] < v[3] and v[1] < u[3]
    want = []
    for r in own[2]:
        linked = [(2, r)] + [(s, q) for s in (0, 1) for q in own[s] if meet(box(r), box(q))]
        want.append(sorted({(s, *k) for s, q in linked for k in peaks_of(p[s], q)}))
    structures = {}
    for r in detect.blend_structures(table, inside).collect():
        structures.setdefault(r.struct_id, []).append((r.scale, r.y, r.x))
    assert sorted(sorted(v) for v in structures.values()) == sorted(w for w in want if w)
    found = {(r.y, r.x) for r in detect.detect_peaks(df, 3).collect()}
    assert found == set().union(*(peaks_of(p[1], r) for r in own[1])) and found


def test_labels_of_an_image_wider_than_65536(spark):
    df = spark.createDataFrame([(0, 0, 65_540, 1.0), (0, 1, 4, 1.0), (0, 1, 5, 1.0), (1, 0, 0, 1.0)], "image_id long, y int, x int, value double")
    rows = detect.label_components(df).collect()
    labels = {(r.image_id, r.y, r.x): r.label for r in rows}
    assert labels[0, 1, 4] == labels[0, 1, 5] != labels[0, 0, 65_540]


def test_gaps_in_a_plane_are_told(spark):
    df = spark.createDataFrame([(0, "b", 0, 0, 16.0, 1.0), (0, "b", 0, 10, 16.0, 1.0)], PIXELS)
    with pytest.raises(Exception, match="densify"):
        stencil.bspline_smooth(df).collect()
    dense = densify(df.drop("variance")).withColumn("value", F.col("value").cast("double"))
    got = {(r.y, r.x): r.value for r in stencil.bspline_smooth(dense).collect()}
    assert got[0, 0] == got[0, 10] == 16 * 36 / 256 and got[0, 5] == 0


def test_footprint_overlap_counts_shared_pixels(spark):
    rng = np.random.default_rng(22)
    a, b = ([(int(i), int(k), int(y), int(x)) for i, k, y, x in zip(rng.integers(0, 2, 300), rng.integers(0, 5, 300), rng.integers(0, 9, 300), rng.integers(0, 9, 300), strict=True)] for _ in range(2))
    schema = "image_id long, label long, y int, x int"
    found = detect.footprint_overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    want = {}
    for i, k, y, x in set(a):
        for j, m, v, u in set(b):
            if (i, y, x) == (j, v, u):
                want[i, k, m] = want.get((i, k, m), 0) + 1
    assert {(r.image_id, r.a_id, r.b_id): r.n for r in found} == want
    assert detect.footprint_overlap_join(spark.createDataFrame([], schema), spark.createDataFrame(b, schema)).count() == 0


def monotonic(m, center, g=0.0):
    m, (cy, cx) = m.copy(), center
    at = sorted(np.ndindex(m.shape), key=lambda p: (p[0] - cy) ** 2 + (p[1] - cx) ** 2)
    for y, x in at:
        total = weight = 0.0
        r = (y - cy) ** 2 + (x - cx) ** 2
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v, u = y + dy, x + dx
                if (dy or dx) and (v - cy) ** 2 + (u - cx) ** 2 < r:
                    cos = -(dy * (y - cy) + dx * (x - cx)) / np.sqrt((dy * dy + dx * dx) * r)
                    if abs(cos) > 1e-12:
                        total, weight = total + cos * m[v, u], weight + cos
        if weight:
            m[y, x] = min(m[y, x], (1 - g) * total / weight)
    return m


def test_extended_constraints(spark):
    rng = np.random.default_rng(23)
    m = rng.normal(0.4, 0.5, (9, 9))
    df = spark.createDataFrame([(0, 0, 0, int(i), int(j), float(m[i, j])) for i, j in np.ndindex(9, 9)], MORPHS)
    centers = spark.createDataFrame([(0, 0, 0, 4, 4)], "image_id long, source_id long, comp_id int, cy int, cx int")
    for symmetric in (False, True):
        want = monotonic(m, (4, 4))
        want = (want + want[::-1, ::-1]) / 2 if symmetric else want
        want = np.maximum(want, 0)
        want[4, 4] = max(want[4, 4], 1e-6)
        got = {(r.y, r.x): r.m for r in constrain.extended_constraints(df, centers, symmetric=symmetric).collect()}
        assert np.allclose([got[p] for p in np.ndindex(9, 9)], (want / want.max()).ravel())


def test_symmetry_about_a_subpixel_centre_keeps_a_symmetric_image(spark):
    y, x = np.mgrid[:21, :21]
    for dy, dx in ((0.0, 0.0), (0.3, -0.4)):
        a = np.exp(-((y - 10 - dy) ** 2 + (x - 10 - dx) ** 2) / 8.0)
        df = spark.createDataFrame([(0, "b", int(i), int(j), float(a[i, j])) for i, j in np.ndindex(21, 21)], "image_id long, band string, y int, x int, value double")
        shifts = spark.createDataFrame([(0, dy, dx)], "image_id long, shift_y double, shift_x double")
        got = {(r.y, r.x): r.value for r in constrain.symmetry_subpixel(df, shifts).collect()}
        assert max(abs(got[p] - a[p]) for p in np.ndindex(21, 21)) < 0.02


def fitted(images, weights, kernel, seds, morphs, rms, thresh, rounds, plane_weights=None):
    """The constrained fit of one image: losses, seds, morphologies (components x bands, components x y x x)."""

    def convolved(a, sign):
        out = np.zeros_like(a)
        for (dy, dx), k in kernel.items():
            moved = np.zeros_like(a)
            ny, nx = a.shape
            dy, dx = sign * dy, sign * dx
            moved[max(dy, 0) : ny + min(dy, 0), max(dx, 0) : nx + min(dx, 0)] = a[max(-dy, 0) : ny + min(-dy, 0), max(-dx, 0) : nx + min(-dx, 0)]
            out += k * moved
        return out

    state = [[np.zeros_like(v) for _ in range(3)] for v in (seds, morphs)]
    losses = []
    for it in range(rounds):
        loss, grad = 0.0, np.zeros_like(images[0])
        for image, weight in zip(images, weights, strict=True):
            rest = np.array([convolved(np.tensordot(seds[:, b], morphs, 1), 1) for b in range(len(image))]) - image
            loss += (weight * rest**2).sum() / 2
            rest = weight * rest
            if plane_weights:
                rest = np.array([np.tensordot(plane_weights, planes_of(r, len(plane_weights) - 1, 1), 1) for r in rest])
            grad += np.array([convolved(r, -1) for r in rest])
        losses.append(loss)
        steps = np.maximum(1e-12, 0.01 * seds.mean(axis=1))[:, None], np.maximum(1e-12, 0.01 * morphs.mean(axis=(1, 2)))[:, None, None]
        grads = np.einsum("byx,cyx->cb", grad, morphs), np.einsum("byx,cb->cyx", grad, seds)
        moved = []
        for v, g, step, m in zip((seds, morphs), grads, steps, state, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            m[2] = np.maximum(m[2], m[1])
            moved.append(v - step * m[0] / (np.sqrt(m[2]) + 1e-8) / (10 if it == 0 else 1))
        seds = np.maximum(moved[0], 1e-20)
        made = []
        for c, m in enumerate(moved[1]):
            middle = tuple(n // 2 for n in m.shape)
            m = monotonic(m, middle)
            if rms is None:
                m = np.maximum(m, 0)
            else:
                least = min(thresh * r / s for r, s in zip(rms, seds[c], strict=True) if s > 0)
                m = np.where(m >= least, m, 0)
                m[middle] = max(m[middle], 1e-20)
                m = m / m.max()
            m[middle] = max(m[middle], 1e-20)
            made.append(m / m.max())
        morphs = np.array(made)
    return losses, seds, morphs


@pytest.mark.parametrize("how", ["plain", "background", "two", "wavelet"])
def test_constrained_fits_of_a_blend(spark, how):
    rng = np.random.default_rng(24)
    y, x = np.mgrid[:9, :9]
    shapes = np.array([np.exp(-((y - a) ** 2 + (x - b) ** 2) / 4.0) for a, b in ((4, 4), (4.6, 4.8))])
    true = np.array([[20.0, 8.0], [6.0, 15.0]])
    image = np.einsum("cb,cyx->byx", true, shapes) + rng.normal(0, 0.3, (2, 9, 9))
    weight = rng.uniform(0.5, 2.0, (2, 9, 9))
    kernel = {(dy, dx): (2 - abs(dy)) * (2 - abs(dx)) / 16 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    seds, morphs = true * 0.7, np.clip(shapes**0.8 + rng.normal(0, 0.02, shapes.shape), 0, None)
    rms = [0.9, 1.1] if how == "background" else None
    images = [image, image * 1.1] if how == "two" else [image]
    wavelet = [1.0, 0.8, 0.5] if how == "wavelet" else None
    losses, want_s, want_m = fitted(images, [weight] * len(images), kernel, seds.copy(), morphs.copy(), rms, 2.0, 4, wavelet)

    at = list(np.ndindex(9, 9))
    frame = lambda a: spark.createDataFrame([(5, "gr"[b], i, j, float(a[b, i, j]), float(weight[b, i, j])) for b in (0, 1) for i, j in at], "image_id long, band string, y int, x int, value double, weight double")
    k = spark.createDataFrame([(5, b, dy, dx, v) for b in "gr" for (dy, dx), v in kernel.items()], "image_id long, band string, dy int, dx int, k double")
    start = spark.createDataFrame([(5, c, 0, "gr"[b], float(seds[c, b])) for c in (0, 1) for b in (0, 1)], SEDS)
    shaped = spark.createDataFrame([(5, c, 0, i, j, float(morphs[c, i, j])) for c in (0, 1) for i, j in at], MORPHS)
    noise = rms and spark.createDataFrame([(5, b, r) for b, r in zip("gr", rms, strict=True)], "image_id long, band string, rms double")
    got_s, got_m, got_l = fit.fit_multi([(frame(a), k) for a in images], start, shaped, rms=noise, bg_thresh=2.0 if rms else None, max_iter=4, e_rel=1e-12, resize=None, plane_weights=wavelet)
    assert np.allclose([r.loss for r in got_l.orderBy("it").collect()], losses, rtol=1e-9)
    found = {(r.source_id, r.band): r.sed for r in got_s.collect()}
    assert np.allclose([[found[c, b] for b in "gr"] for c in (0, 1)], want_s, rtol=1e-9)
    found = {(r.source_id, r.y, r.x): r.m for r in got_m.collect()}
    assert np.allclose([found[c, i, j] for c in (0, 1) for i, j in at], want_m.ravel(), rtol=1e-8, atol=1e-12)


def test_fit_over_two_resolutions(spark):
    y, x = np.mgrid[:12, :12]
    shapes = np.array([np.exp(-((y - a) ** 2 + (x - b) ** 2) / 5.0) for a, b in ((5, 5), (6, 7))])
    true = np.array([[20.0], [9.0]])
    # The second grid is rotated, and half as fine.
    place = {"m_yy": 1.6, "m_yx": -1.2, "m_xy": 1.2, "m_xx": 1.6, "m_y0": 4.5, "m_x0": 0.25}
    sinc = lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)
    ty, tx = np.mgrid[:5, :5]
    ay, ax = place["m_yy"] * ty + place["m_yx"] * tx + place["m_y0"], place["m_xy"] * ty + place["m_xx"] * tx + place["m_x0"]
    matrix = sinc(ay[..., None, None] - y) * sinc(ax[..., None, None] - x)
    fine = np.einsum("cb,cyx->byx", true, shapes)[0]
    coarse = np.tensordot(matrix, fine, 2)
    seds, morphs = true * 0.6, shapes**0.8
    at, low = list(np.ndindex(12, 12)), list(np.ndindex(5, 5))
    frame = lambda a, cells: spark.createDataFrame([(1, "b", i, j, float(a[i, j]), 1.0) for i, j in cells], "image_id long, band string, y int, x int, value double, weight double")
    mapping = spark.createDataFrame([(1, 5, 5, *place.values())], "image_id long, ny int, nx int, " + ", ".join(f"{n} double" for n in place))
    weights = stencil.resample_weights(mapping)
    kernel = spark.createDataFrame([(1, "b", 0, 0, 1.0)], "image_id long, band string, dy int, dx int, k double")
    start = spark.createDataFrame([(1, c, 0, "b", float(seds[c, 0])) for c in (0, 1)], SEDS)
    shaped = spark.createDataFrame([(1, c, 0, i, j, float(morphs[c, i, j])) for c in (0, 1) for i, j in at], MORPHS)
    got = fit.fit_multi([(frame(fine, at), kernel), (frame(coarse, low), kernel, weights)], start, shaped, max_iter=4, e_rel=1e-12, resize=None, constrained=False)[2]

    state = [[np.zeros_like(v) for _ in range(3)] for v in (seds, morphs)]
    losses = []
    for it in range(4):
        model = np.einsum("cb,cyx->byx", seds, morphs)[0]
        rest = model - fine, np.tensordot(matrix, model, 2) - coarse
        losses.append(sum((r**2).sum() for r in rest) / 2)
        grad = rest[0] + np.einsum("uvyx,uv->yx", matrix, rest[1])
        steps = 0.01 * seds.mean(axis=1)[:, None], 0.01 * morphs.mean(axis=(1, 2))[:, None, None]
        moved = []
        for v, g, step, m in zip((seds, morphs), ((morphs * grad).sum(axis=(1, 2))[:, None], seds[:, :, None] * grad), steps, state, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            m[2] = np.maximum(m[2], m[1])
            moved.append(v - step * m[0] / (np.sqrt(m[2]) + 1e-8) / (10 if it == 0 else 1))
        seds, morphs = moved
    assert np.allclose([r.loss for r in got.orderBy("it").collect()], losses, rtol=1e-9)
