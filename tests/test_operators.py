"""Golden values and properties of single operators."""

import math

import numpy as np
import pytest

from pixelloom.functions.graph import components
from pixelloom.operators import boxes, constrain, detect, fit, frames, measure, models, pixels, stencil

COMP = "image_id long, source_id long, comp_id int, y int, x int, m double"
PIX = "image_id long, band string, y int, x int, value double"


def comp(spark, a):
    return spark.createDataFrame([(0, 0, 0, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], COMP)


def image(spark, a, band="b"):
    return spark.createDataFrame([(0, band, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], PIX)


def matrix(df, col="m"):
    found = df.collect()
    out = np.zeros((max(r.y for r in found) + 1, max(r.x for r in found) + 1))
    for r in found:
        out[r.y, r.x] = r[col]
    return out


RAMP = np.arange(25.0).reshape(5, 5)


def test_box_from_data(spark):
    a = RAMP.copy()
    a[0] = 0
    a[:, -2:] = 0
    box = boxes.box_from_data(image(spark, a)).first()
    assert (box.y0, box.y1, box.x0, box.x1) == (1, 5, 0, 3)


def test_box_from_data_of_nothing(spark):
    box = boxes.box_from_data(image(spark, np.zeros((3, 3)))).first()
    assert (box.y0, box.y1, box.x0, box.x1) == (0, 0, 0, 0)


def test_box_overlap_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), i, int(y), int(y + h), int(x), int(x + w)) for i, (y, x, h, w) in enumerate(zip(*(rng.integers(0, 60, 80) for _ in range(2)), rng.integers(0, 40, 80), rng.integers(0, 40, 80), strict=True))]
    df = spark.createDataFrame(rows, "image_id long, box_id long, y0 int, y1 int, x0 int, x1 int")
    found = sorted((r.a_id, r.b_id) for r in boxes.box_overlap_join(df, df).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3]) and max(a[4], b[4]) < min(a[5], b[5]))
    assert found == want


@pytest.mark.parametrize(("strength", "check"), [(1.0, lambda m: np.allclose(m, 12)), (0.5, lambda m: np.allclose(m, 0.5 * 12 + 0.5 * RAMP))])
def test_symmetry(spark, strength, check):
    assert check(matrix(constrain.symmetry(comp(spark, RAMP), strength)))


def swept(a, weight, g):
    """Brute force of the monotonic constraint."""
    out, c = a.copy(), ((a.shape[0] - 1) // 2, (a.shape[1] - 1) // 2)
    cells = sorted(((y - c[0]) ** 2 + (x - c[1]) ** 2, y, x) for y in range(a.shape[0]) for x in range(a.shape[1]))
    for d, y, x in cells[1:]:
        n = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                v, u = y + dy, x + dx
                if (dy or dx) and 0 <= v < a.shape[0] and 0 <= u < a.shape[1] and (v - c[0]) ** 2 + (u - c[1]) ** 2 < d:
                    n.append((-(dy * (y - c[0]) + dx * (x - c[1])) / math.sqrt(d * (dy * dy + dx * dx)), out[v, u]))
        n = [e for e in n if abs(e[0]) > 1e-12]
        ref = max(n)[1] if weight == "nearest" else sum(w * v for w, v in n) / sum(w for w, _ in n)
        out[y, x] = min(out[y, x], (1 - g) * ref)
    return out


@pytest.mark.parametrize(("weight", "g"), [("nearest", 0.0), ("nearest", 0.2), ("angle", 0.0), ("angle", 0.25)])
def test_monotonic(spark, weight, g):
    a = np.random.default_rng(1).random((9, 9))
    df = comp(spark, a)
    centers = constrain.middle(df)
    made = constrain.monotonic_nearest(df, centers, g) if weight == "nearest" else constrain.monotonic_weighted(df, centers, weight, g)
    assert np.allclose(matrix(made), swept(a, weight, g))


def test_starlet_round_trip(spark):
    y, x = np.mgrid[:32, :32] - 16
    df = image(spark, np.exp(-(y**2 + x**2) / 8.0))
    coeffs = stencil.starlet_transform(df, 3)
    assert np.allclose(matrix(stencil.starlet_reconstruct(coeffs, 3), "value"), np.exp(-(y**2 + x**2) / 8.0))


def test_match_psf_round_trip(spark):
    base = spark.createDataFrame([(0, "b", 1.0)], "image_id long, band string, sigma double")
    small, large = models.gaussian_psf(base, 25, integrated=False), models.gaussian_psf(base.withColumn("sigma", base.sigma * 2), 25, integrated=False)
    kernel = stencil.match_psf(large, small, padding=3)
    field = spark.createDataFrame([(0, "b", r.dy + 12, r.dx + 12, r.k) for r in small.collect()], PIX)
    seen = matrix(stencil.convolve(field, kernel), "value")
    want = np.zeros((25, 25))
    for r in large.collect():
        want[r.dy + 12, r.dx + 12] = r.k
    assert np.abs(seen - want)[6:-6, 6:-6].max() < 1e-4


def test_convolution_sign_and_adjoint(spark):
    a = np.zeros((5, 5))
    a[2, 2] = 1
    k = spark.createDataFrame([(0, "b", 1, 0, 2.0)], "image_id long, band string, dy int, dx int, k double")
    assert matrix(stencil.convolve(image(spark, a), k), "value")[3, 2] == 2
    assert {(r.y, r.x): r.value for r in stencil.convolve_adjoint(image(spark, a), k).collect()}[1, 2] == 2


def test_components_of_hot_nodes(spark):
    """Stars around a least and a greatest node, joined by chance edges: as union-find has it, key by key."""
    import random

    rng = random.Random(5)
    edges = [("p", 0, k) for k in range(1, 400)] + [("p", 9000, k) for k in range(1000, 1400)] + [("q", 9000, k) for k in range(300)]
    edges += [("q", rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)] + [("q", 7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in edges:
        one, two = root((k, a)), root((k, b))
        parent[max(one, two)] = min(one, two)
    found = {(r.k, r.node): r.root for r in components(spark.createDataFrame(edges, "k string, a long, b long"), ("k",)).collect()}
    assert found == {x: root(x)[1] for x in parent if root(x) != x}


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == found[103] == 100


def test_plateaus_have_no_peak(spark):
    a = np.zeros((6, 6))
    a[1:4, 1:4] = 2.0
    table, inside = detect.footprints(image(spark, a).select("image_id", "y", "x", "value"))
    assert table.first().area == 9 and detect.local_maxima(inside).count() == 0


def test_suppress_close_is_greedy(spark):
    rng = np.random.default_rng(3)
    pts = [(0, 0, int(y), int(x), float(f)) for y, x, f in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.permutation(60), strict=True)]
    pts = list({(p[2], p[3]): p for p in pts}.values())
    kept = []
    for p in sorted(pts, key=lambda p: -p[4]):
        if all((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 >= 25 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(pts, "image_id long, label long, y int, x int, flux double")
    assert sorted((r.y, r.x) for r in detect.suppress_close(df, 5.0).collect()) == sorted((p[2], p[3]) for p in kept)


def test_sky_round_trip(spark):
    f = spark.createDataFrame([(0, 10, 10, 0.8, -0.6, 0.6, 0.8, 5.0, 4.0, 120.0, 30.0)], "image_id long, ny int, nx int, pc11 double, pc12 double, pc21 double, pc22 double, crpix1 double, crpix2 double, crval1 double, crval2 double")
    p = spark.createDataFrame([(0, 1.5, 7.25)], "image_id long, y double, x double")
    back = frames.sky_to_pixel(frames.pixel_to_sky(p, f, tangent=True).drop("y", "x"), f, tangent=True).first()
    assert math.isclose(back.y, 1.5, abs_tol=1e-9) and math.isclose(back.x, 7.25, abs_tol=1e-9)


def test_weights_of_masked_and_missing_variance(spark):
    df = spark.createDataFrame([(0, "b", 0, 0, 1.0, 2.0, True), (0, "b", 0, 1, 1.0, None, False), (0, "b", 0, 2, 1.0, 4.0, None)], PIX + ", variance double, masked boolean")
    assert [r.weight for r in pixels.with_weights(df).orderBy("x").collect()] == [0.0, 0.0, 0.25]


def test_spergel_is_exponential_at_one_half(spark):
    c = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.5)], "image_id long, source_id long, cy double, cx double, radius double, e1 double, e2 double, nu double")
    found = {(r.y, r.x): r.value for r in models.spergel_profile(c, "5").collect()}
    scale = sum(z * 0.5 ** (4 - i) for i, z in enumerate(models.SPERGEL))
    for (y, x), v in found.items():
        q = scale * math.sqrt((y * y + x * x) / 4 + 1e-4)
        assert math.isclose(v, math.exp(-q), rel_tol=1e-5)


def test_fit_lowers_the_loss(spark):
    y, x = np.mgrid[:9, :9] - 4
    true = np.exp(-(y**2 + x**2) / 4.0)
    df = image(spark, 50 * true).selectExpr("*", "1.0D AS weight")
    k = spark.createDataFrame([(0, "b", 0, 0, 1.0)], "image_id long, band string, dy int, dx int, k double")
    seds = spark.createDataFrame([(0, 0, 0, "b", 30.0)], "image_id long, source_id long, comp_id int, band string, sed double")
    start = comp(spark, np.exp(-(y**2 + x**2) / 9.0))
    _, _, losses = fit.fit_blends(df, seds, start, k, max_iter=4, e_rel=1e-9, sed_step=0.05, morph_step=0.02)
    values = [r.loss for r in losses.orderBy("it").collect()]
    assert len(values) == 4 and values[-1] < values[0]


def test_fit_seds_solves_two_overlapping_sources(spark):
    y, x = np.mgrid[:12, :12]
    a, b = np.exp(-((y - 4) ** 2 + (x - 4) ** 2) / 4.0), np.exp(-((y - 7) ** 2 + (x - 7) ** 2) / 4.0)
    rows = [(0, s, 0, i, j, float(m[i, j])) for s, m in ((1, a), (2, b), (3, b)) for i in range(12) for j in range(12)]
    df = image(spark, 5 * a + 3 * b).selectExpr("*", "1.0D AS weight")
    k = spark.createDataFrame([(0, "b", 0, 0, 1.0)], "image_id long, band string, dy int, dx int, k double")
    found = {r.source_id: r.sed for r in fit.fit_seds(df, spark.createDataFrame(rows, COMP), k).collect()}
    assert math.isclose(found[1], 5, rel_tol=1e-6) and math.isclose(found[2], 3, rel_tol=1e-6) and found[3] == 0


def test_magnitude_of_no_flux_is_null(spark):
    assert measure.magnitude(spark.createDataFrame([(0.0,)], "flux double")).first().mag is None
