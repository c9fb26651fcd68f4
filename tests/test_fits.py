"""Fits against plain NumPy, their tiles, options and saved states, and known sources that deblending has to recover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import blend
from pixelloom.operators import blocks, constrain, fit
from pixelloom.plans import registry
from pixelloom.sources import tables

PIXELS = "image_id long, band string, y int, x int, value double, weight double, variance double"
KERNEL = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx)) / 16) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def kernels(spark, bands, images=(0,), entries=KERNEL):
    return spark.createDataFrame([(i, b, dy, dx, float(k)) for i in images for b in bands for dy, dx, k in entries], "image_id long, band string, dy int, dx int, k double")


def pixel_rows(image, band, a, weight=None, variance=1.0):
    w = np.full(a.shape, 1.0 / variance) if weight is None else weight
    return [(image, band, i, j, float(a[i, j]), float(w[i, j]), variance) for i in range(a.shape[0]) for j in range(a.shape[1])]


def seen(a):
    out = np.zeros_like(a)
    for dy, dx, k in KERNEL:
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                if 0 <= y - dy < a.shape[0] and 0 <= x - dx < a.shape[1]:
                    out[y, x] += k * a[y - dy, x - dx]
    return out


def scene(spark, ny=34, nx=45):
    """Two images of two bands: three round sources each, one at an edge, and where fits begin."""
    y, x = np.mgrid[:ny, :nx]
    rng = np.random.default_rng(4)
    rows, seds, morphs = [], [], []
    for image in (0, 1):
        places = [(9, 10 + image), (12, 17), (ny - 2, nx - 3)]
        total = {b: np.zeros((ny, nx)) for b in "gr"}
        for s, (cy, cx) in enumerate(places):
            shape = np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 6.0)
            for b, f in zip("gr", (20 + 5 * s, 10 + 9 * s), strict=True):
                total[b] += f * shape
                seds.append((image, s, 0, b, 0.8 * f))
            for i in range(cy - 6, cy + 7):
                for j in range(cx - 6, cx + 7):
                    morphs.append((image, s, 0, i, j, float(np.exp(-((i - cy) ** 2 + (j - cx) ** 2) / 4.0))))
        for b in "gr":
            rows += pixel_rows(image, b, seen(total[b]) + 0.1 * rng.normal(size=(ny, nx)), np.where(rng.random((ny, nx)) < 0.03, 0.0, 100.0))
    return (
        spark.createDataFrame(rows, PIXELS), kernels(spark, "gr", (0, 1)),
        spark.createDataFrame(seds, "image_id long, source_id long, comp_id int, band string, sed double"), spark.createDataFrame(morphs, "image_id long, source_id long, comp_id int, y int, x int, m double"),
    )


def table(df, *keys):
    rows = df.collect()
    last = [c for c in df.columns if c not in keys][-1]
    return {tuple(r[k] for k in keys): r[last] for r in rows}


def close(a, b, **how):
    assert set(a) == set(b) and np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)], **how)


@pytest.mark.parametrize("how", [{}, {"plane_weights": [1.0, 0.7, 0.4]}, {"scheme": "fista"}])
def test_an_image_of_many_tiles_is_fitted_like_one(spark, how):
    pixels, kern, seds, morphs = scene(spark)
    made = [fit.fit_multi([(pixels, kern)], seds, morphs, max_iter=4, e_rel=1e-12, resize=2, tile=t, **how) for t in (256, 16)]
    for n, keys in enumerate((("image_id", "source_id", "band"), ("image_id", "source_id", "y", "x"), ("image_id", "it"))):
        close(table(made[0][n].drop("comp_id"), *keys), table(made[1][n].drop("comp_id"), *keys), rtol=1e-9, atol=1e-12)
    loss = table(made[0][2], "image_id", "it")
    assert sorted(loss) == [(i, t) for i in (0, 1) for t in range(4)] and all(loss[i, 3] < loss[i, 0] for i in (0, 1))


def test_a_saved_fit_goes_on_as_if_it_had_not_stopped(spark, tmp_path):
    pixels, kern, seds, morphs = scene(spark)
    begun = blocks.started(seds, morphs, rms=fit.weight_noise(pixels))
    whole = fit.fit_state([(pixels, kern)], begun, 4, e_rel=1e-12)
    tables.save_state(fit.fit_state([(pixels, kern)], begun, 2, e_rel=1e-12), str(tmp_path / "state"))
    again = fit.fit_state([(pixels, kern)], tables.load_state(spark, str(tmp_path / "state")), 4, e_rel=1e-12)
    close(table(blocks.losses_of(whole), "image_id", "it"), table(blocks.losses_of(again), "image_id", "it"), rtol=1e-12)
    close(table(blocks.morphs_of(whole).drop("comp_id"), "image_id", "source_id", "y", "x"), table(blocks.morphs_of(again).drop("comp_id"), "image_id", "source_id", "y", "x"), rtol=1e-12)
    first, rest = "source_id < 2", "source_id = 2"
    some = fit.fit_state([(pixels, kern)], blocks.started(seds.where(first), morphs.where(first)), 3, e_rel=1e-12)
    more = fit.fit_state([(pixels, kern)], blocks.joined_by(some, seds.where(rest), morphs.where(rest)), 6, e_rel=1e-12)
    assert blocks.seds_of(more).select("source_id").distinct().count() == 3
    loss = table(blocks.losses_of(more), "image_id", "it")
    assert loss[0, 3] < 0.9 * loss[0, 2] and max(t for _, t in loss) == 5


def test_few_jobs_an_iteration(spark):
    pixels, kern, seds, morphs = scene(spark)
    sc = spark.sparkContext
    jobs = []
    for n in (10, 30):
        sc.setJobGroup(f"fit{n}", "")
        fit.fit_multi([(pixels, kern)], seds, morphs, max_iter=n, e_rel=0)[2].count()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 20  # two rounds of ten iterations more


def stencil_matrix(n, scale):
    h = np.zeros((n, n))
    for i in range(n):
        for k, w in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True):
            if 0 <= i + k * 2**scale < n:
                h[i, i + k * 2**scale] += w / 16
    return h


def test_starlet_parameters_equal_plain_matrices(spark):
    ny, nx, scales, thresh = 11, 13, 2, 0.02
    hs = [np.kron(stencil_matrix(ny, j), stencil_matrix(nx, j)) for j in range(scales)]
    eye = np.eye(ny * nx)
    rec = np.hstack([eye, hs[0], hs[0] @ hs[1]])  # c0 = w0 + H0 (w1 + H1 w2)
    rng = np.random.default_rng(1)
    w, g = rng.normal(size=(scales + 1, ny, nx)), rng.normal(size=(ny, nx))
    assert np.allclose(blend.reconstructed(w).ravel(), rec @ w.ravel())
    assert np.isclose((blend.reconstructed(w) * g).sum(), (w * blend.reconstructed_adjoint(g, scales)).sum())
    y, x = np.mgrid[:ny, :nx]
    shape = np.exp(-((y - 5) ** 2 + (x - 6) ** 2) / 5.0)
    image, m0, sed = 30 * shape, shape**0.8, np.array([25.0])
    dec = np.vstack([eye - hs[0] @ hs[0], (eye - hs[1] @ hs[1]) @ hs[0], hs[1] @ hs[0]])
    p = (dec @ m0.ravel()).reshape(scales + 1, ny, nx)
    mom = {"s": [0.0, 0.0, 0.0], "p": [np.zeros_like(p)] * 3}
    losses = []
    for it in range(4):
        m = (rec @ p.ravel()).reshape(ny, nx)
        r = sed[0] * m - image
        losses.append((r * r).sum() / 2)
        new = {}
        for name, value, grad in (("s", sed[0], (m * r).sum()), ("p", p, (rec.T @ (sed[0] * r).ravel()).reshape(p.shape))):
            a, b, c = mom[name]
            a, b = 0.9 * a + 0.1 * grad, 0.999 * b + 0.001 * grad * grad
            c = np.maximum(c, b)
            mom[name] = [a, b, c]
            new[name] = value - max(1e-12, 0.01 * np.mean(value)) * a / (np.sqrt(c) + 1e-8) / (10 if it == 0 else 1)
        sed, p = np.array([max(new["s"], 1e-20)]), new["p"]
        for j in range(scales):
            p[j] = np.where((p[j] > 0) & (p[j] > thresh * np.sqrt((p[j] ** 2).sum())), p[j], 0)
    pixels = spark.createDataFrame(pixel_rows(0, "b", image), PIXELS)
    seds = spark.createDataFrame([(0, 0, 0, "b", 25.0)], "image_id long, source_id long, comp_id int, band string, sed double")
    morphs = spark.createDataFrame([(0, 0, 0, i, j, float(m0[i, j])) for i in range(ny) for j in range(nx)], "image_id long, source_id long, comp_id int, y int, x int, m double")
    s, m, loss = fit.fit_multi([(pixels, kernels(spark, "b", entries=[(0, 0, 1.0)]))], seds, morphs, max_iter=4, e_rel=1e-12, scales=scales, thresh=thresh)
    assert np.allclose([r.loss for r in loss.orderBy("it").collect()], losses, rtol=1e-9)
    assert np.allclose([r.m for r in m.orderBy("y", "x").collect()], rec @ p.ravel(), rtol=1e-8, atol=1e-12)


def plain_monotonic(m, cy, cx):
    out = m.copy()
    places = sorted(((y - cy) ** 2 + (x - cx) ** 2, y, x) for y in range(m.shape[0]) for x in range(m.shape[1]))
    for d2, y, x in places[1:]:
        total = mean = 0.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                b, a = y + dy, x + dx
                if (dy or dx) and 0 <= b < m.shape[0] and 0 <= a < m.shape[1] and (b - cy) ** 2 + (a - cx) ** 2 < d2:
                    cos = -(dy * (y - cy) + dx * (x - cx)) / np.sqrt((dy * dy + dx * dx) * d2)
                    if abs(cos) > 1e-12:
                        total, mean = total + cos, mean + cos * out[b, a]
        if total > 0:
            out[y, x] = min(out[y, x], mean / total)
    return out


def test_proximal_iterations_of_the_monotonic_chain(spark):
    rng = np.random.default_rng(6)
    comps = [rng.normal(0.2, 0.5, (7, 9)), rng.random((5, 5)), np.zeros((3, 3))]
    psis = [0.1 + rng.random(c.shape) for c in comps]

    def project(z):
        z = np.maximum(plain_monotonic(z, z.shape[0] // 2, z.shape[1] // 2), 0)
        z[z.shape[0] // 2, z.shape[1] // 2] = max(z[z.shape[0] // 2, z.shape[1] // 2], 1e-20)
        return z / z.max()

    want, turns = [], []
    for x, psi in zip(comps, psis, strict=True):
        z, pull = x, psi / psi.max()
        for n in range(12):
            new = project(z - pull * (z - x))
            settled = ((new - z) ** 2).sum() <= 1e-8 * (z**2).sum()
            z = new
            if settled:
                break
        want.append(z)
        turns.append(n)
    assert len(set(turns)) > 1  # each leaves by its own test
    rows = [(0, s, 0, i, j, float(c[i, j]), float(p[i, j])) for s, (c, p) in enumerate(zip(comps, psis, strict=True)) for i in range(c.shape[0]) for j in range(c.shape[1])]
    df = spark.createDataFrame(rows, "image_id long, source_id long, comp_id int, y int, x int, m double, psi double")
    centers = constrain.middle(df)
    prox = lambda z: constrain.max_normalised(constrain.center_on(constrain.positivity(constrain.monotonic_weighted(z, centers)), 1e-20))
    found = table(fit.proximal_iterations(df, prox, max_iter=12, e_rel=1e-4).drop("psi"), "image_id", "source_id", "comp_id", "y", "x")
    for s, z in enumerate(want):
        assert all(np.isclose(found[0, s, 0, i, j], z[i, j], atol=1e-9) for i in range(z.shape[0]) for j in range(z.shape[1]))
    how = blend.How()
    for x, psi, z in zip(comps, psis, want, strict=True):
        c = blend.Component((0, 0), 0, 0, x.shape[0] // 2, x.shape[1] // 2, np.ones(1), [], x, [], None)
        assert np.allclose(blend.proximal(x, psi, 1.0, lambda m, c=c: blend.constrained_shape(c, m, how), 12, 1e-4), z, atol=1e-9)


def test_fits_use_proximal_sub_iterations(spark):
    pixels, kern, seds, morphs = scene(spark)
    one, many = (table(fit.fit_blends(pixels, seds, morphs, kern, max_iter=6, e_rel=1e-12, prox_iter=n)[2], "image_id", "it") for n in (1, 8))
    assert one[0, 1] == many[0, 1] or abs(one[0, 1] - many[0, 1]) < 0.2 * one[0, 1]
    assert any(abs(one[k] - many[k]) > 1e-9 * one[k] for k in one) and many[0, 5] < many[0, 0]


def test_moving_centers_and_the_mask(spark):
    rng = np.random.default_rng(9)
    y, x = np.mgrid[:13, :13]
    a = np.exp(-((y - 7) ** 2 + (x - 5) ** 2) / 9.0) + 0.05 * rng.random((13, 13))
    df = spark.createDataFrame([(0, 0, 0, i, j, float(a[i, j])) for i in range(13) for j in range(13)], "image_id long, source_id long, comp_id int, y int, x int, m double")
    found = table(constrain.monotonic_weighted(df, constrain.middle(df), center_radius=2, use_mask=True), "image_id", "source_id", "comp_id", "y", "x")
    part = a[4:9, 4:9]
    cy, cx = (int(v) + 4 for v in np.unravel_index(part.argmax(), part.shape))
    want, seen_, front = plain_monotonic(a, cy, cx), {(cy, cx)}, [(cy, cx)]
    while front:
        b, c = front.pop()
        for at in ((b + 1, c), (b - 1, c), (b, c + 1), (b, c - 1)):
            if at not in seen_ and min(at) >= 0 and max(at) < 13 and 0 < a[at] < a[b, c]:
                seen_.add(at)
                front.append(at)
    for at in seen_:
        want[at] = a[at]
    assert (cy, cx) != (6, 6) and all(np.isclose(found[0, 0, 0, i, j], want[i, j]) for i in range(13) for j in range(13))


def test_boxes_grow_for_one_bright_edge(spark):
    def grown(m, sed, pull=None):
        rows = [(0, 0, 0, i, j, float(m[i, j])) for i in range(21) for j in range(21)]
        df = spark.createDataFrame(rows, "image_id long, source_id long, comp_id int, y int, x int, m double")
        seds = spark.createDataFrame([(0, 0, 0, "b", sed)], "image_id long, source_id long, comp_id int, band string, sed double")
        rms = spark.createDataFrame([(0, "b", 1.0)], "image_id long, band string, rms double")
        c = blend.Component((0, 0), 0, 0, 10, 10, np.array([sed]), [], m.copy(), [np.zeros_like(m) if pull is None else pull, np.zeros_like(m), np.ones_like(m)], np.array([1.0]))
        blend.resized(c, blend.How(edge_pull=None if pull is None else 0.1))
        return fit.resize_components(seds, df, rms).selectExpr("max(y) - min(y) + 1").first()[0], c.param.shape[0]

    m = np.zeros((21, 21))
    m[10, 10], m[0, 5], m[0, 6] = 1.0, 0.3, 0.3
    m[20, :], m[:, 0], m[:, 20] = 1e-6, 1e-6, 1e-6  # the mean over the whole rim is small
    assert grown(m, 10.0) == (31, 31) and grown(m, 2.0) == (21, 21)
    pull = np.zeros((21, 21))
    pull[:, 20] = -0.2
    assert grown(m, 2.0, pull) == (21, 31)


def test_shares_add_up_to_the_data(spark):
    pixels, kern, seds, morphs = scene(spark)
    shares = fit.reweight(pixels, seds, morphs, kern).groupBy("image_id", "band", "y", "x").agg(F.sum("value").alias("value"))
    found, data = table(shares, "image_id", "band", "y", "x"), {(r.image_id, r.band, r.y, r.x): (r.value, r.weight) for r in pixels.collect()}
    assert len(found) > 500 and all(np.isclose(v, data[k][0] if data[k][1] > 0 else 0.0, atol=1e-9) for k, v in found.items())


def test_sources_under_a_mask_leave_the_system(spark):
    y, x = np.mgrid[:15, :30]
    shapes = [np.exp(-((y - 7) ** 2 + (x - c) ** 2) / 4.0) for c in (7, 22)]
    weight = np.where(x > 18, 0.0, 1.0)
    weight[7, 19] = 1.0
    pixels = spark.createDataFrame(pixel_rows(0, "b", 5 * shapes[0] + 3 * shapes[1], weight), PIXELS)
    morphs = spark.createDataFrame([(0, s, 0, i, j, float(m[i, j])) for s, m in enumerate(shapes) for i in range(15) for j in range(30)], "image_id long, source_id long, comp_id int, y int, x int, m double")
    found = {r.source_id: r.sed for r in fit.fit_seds(pixels, morphs, kernels(spark, "b", entries=[(0, 0, 1.0)])).collect()}
    assert np.isclose(found[0], 5.0, rtol=1e-3) and found[1] == 0.0
    found = {r.source_id: r.sed for r in fit.fit_seds(pixels, morphs, kernels(spark, "b", entries=[(0, 0, 1.0)]), least_share=0).collect()}
    assert np.isclose(found[1], 3.0, rtol=1e-3)


def injected(spark, rng):
    """A bright bulge with a disk, a round source, a faint point and nothing; their images in two bands and true fluxes."""
    y, x = np.mgrid[:61, :61]
    gauss = lambda cy, cx, s: np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
    parts = {0: [((40.0, 80.0), gauss(16, 16, 1.2)), ((60.0, 30.0), gauss(16, 16, 5.0))], 1: [((25.0, 40.0), gauss(44, 44, 2.0))], 2: [((6.0, 6.0), gauss(15, 46, 0.7))]}
    rows, flux = [], {}
    for b, band in enumerate("gr"):
        a = np.zeros((61, 61))
        for s, own in parts.items():
            for sed, shape in own:
                a += sed[b] * shape
                flux[s, band] = flux.get((s, band), 0.0) + sed[b] * shape.sum()
        out = np.zeros_like(a)
        for dy, dx, k in KERNEL:
            out += k * np.roll(np.roll(a, dy, 0), dx, 1)
        rows += pixel_rows(0, band, out + 0.2 * rng.normal(size=a.shape), variance=0.04)
    catalog = spark.createDataFrame([(0, 0, 16, 16), (0, 1, 44, 44), (0, 2, 15, 46), (0, 3, 30, 5)], "image_id long, source_id long, y int, x int")
    return spark.createDataFrame(rows, PIXELS), catalog, flux


@pytest.mark.parametrize("how", [{}, {"wavelet": True, "reweighted": True}])
def test_known_sources_are_recovered(spark, how):
    pixels, catalog, flux = injected(spark, np.random.default_rng(8))
    truth = catalog.join(spark.createDataFrame([(s, b, float(27 - 2.5 * np.log10(f))) for (s, b), f in flux.items()], "source_id long, band string, mag double"), "source_id").select("image_id", "y", "x", "band", "mag")
    records = {r.source_id: r for r in fit.deblend_and_measure(pixels, catalog, truth, kernels(spark, "gr"), ["g", "r"], "test", max_iter=60, **how).collect()}
    assert set(records) == {0, 1, 2}
    for s in (0, 1):
        assert abs(records[s].g_diff) < 0.1 and abs(records[s].r_diff) < 0.1, records[s]
    assert records[0].logl > records[0].init_logl


def test_wavelet_seeds(spark):
    pixels, catalog, _ = injected(spark, np.random.default_rng(8))
    seds, morphs, skipped = fit.init_sources_wavelet(pixels, catalog, kernels(spark, "gr"), scales=4, min_snr=50)
    counts = {r.source_id: r.n for r in morphs.groupBy("source_id").agg(F.countDistinct("comp_id").alias("n")).collect()}
    assert counts[0] == 2 and counts[1] >= 1 and counts[2] == 1
    sed = table(seds.select("source_id", "comp_id", "band", "sed"), "source_id", "comp_id", "band")
    assert sed[0, 0, "r"] > sed[0, 0, "g"] and sed[0, 1, "g"] > sed[0, 1, "r"]  # the bulge is redder than the disk
    top = {r.source_id: r.top for r in morphs.groupBy("source_id", "comp_id").agg(F.max("m").alias("top")).collect()}
    assert all(np.isclose(t, 1.0) for t in top.values())
    assert skipped.count() + len(counts) == 4


def test_pair_seds_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    u, v, data = rng.random((6, 6)), rng.random((6, 6)), rng.random((6, 6))
    rows = [(0, 0, c, i, j, float(m[i, j])) for c, m in enumerate((u, v)) for i in range(6) for j in range(6)] + [(0, 1, c, i, j, float(u[i, j])) for c in (0, 1) for i in range(6) for j in range(6)]
    morphs = spark.createDataFrame(rows, "image_id long, source_id long, comp_id int, y int, x int, m double")
    found = table(fit.pair_seds(spark.createDataFrame(pixel_rows(0, "b", data), PIXELS), morphs, kernels(spark, "b")).select("source_id", "comp_id", "sed"), "source_id", "comp_id")
    a = np.array([seen(u).ravel(), seen(v).ravel()]).T
    want = np.maximum(np.linalg.lstsq(a, data.ravel(), rcond=None)[0], 0)
    assert np.allclose([found[0, 0], found[0, 1]], want, rtol=1e-8)
    assert found[1, 1] == 0 and np.isclose(found[1, 0], (a[:, 0] @ data.ravel()) / (a[:, 0] @ a[:, 0]))


@pytest.mark.parametrize("name", ["l6_fit_blends", "l6_fit_fista", "l7_fit_multi", "l10_fit_blends_wavelet", "l10_fit_starlets", "a8_resume_fit"])
def test_registered_fits_end_and_improve(spark, sf_dir, name):
    loss = table(registry.QUERIES[name](spark, sf_dir), "image_id", "it")
    for image in {i for i, _ in loss}:
        its = sorted(t for i, t in loss if i == image)
        assert its == list(range(len(its))) and len(its) <= 20 and loss[image, its[-1]] <= loss[image, its[len(its) // 2]] * (1 + 1e-9)


def test_registered_measurement(spark, sf_dir):
    rows = registry.QUERIES["l11_deblend_and_measure"](spark, sf_dir).collect()
    assert rows and all(r.iterations is None or 1 <= r.iterations <= 100 for r in rows)
    assert registry.QUERIES["j6_init_sources"](spark, sf_dir).count() > 0


def test_mask_fill_against_plain_loops(spark):
    rng = np.random.default_rng(11)
    y, x = np.mgrid[:11, :11]
    images = [np.exp(-((y - 5) ** 2 + (x - 5) ** 2) / 12.0) + 0.1 * rng.random((11, 11)) for _ in range(3)]
    for a in images:
        a[5, 8] = a[2, 5] = 3.0
    rows = [(0, s, 0, i, j, float(a[i, j])) for s, a in enumerate(images) for i in range(11) for j in range(11)]
    df = spark.createDataFrame(rows, "image_id long, source_id long, comp_id int, y int, x int, m double")
    found = {(r.source_id, r.y, r.x): (r.m, r.valid) for r in constrain.monotonic_mask(df, constrain.middle(df), 0.01, max_iter=2).collect()}
    filled = 0
    for s, a in enumerate(images):
        valid, front = {(5, 5): a[5, 5]}, [(5, 5)]
        around = lambda p: [q for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)) if min(q) >= 0 and max(q) < 11]
        while front:
            p = front.pop()
            for q in around(p):
                if q not in valid and 0 < a[q] < a[p] + 0.01:
                    valid[q] = a[q]
                    front.append(q)
        for _ in range(2):
            new = {}
            for p in {q for v in valid for q in around(v)} - set(valid):
                guess = [2 * valid[u] - valid[v] for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (u := (p[0] + dy, p[1] + dx)) in valid and (v := (p[0] + 2 * dy, p[1] + 2 * dx)) in valid and valid[v] > valid[u]]
                if guess and np.mean(guess) > 0:
                    new[p] = np.mean(guess)
            filled += len(new)
            valid |= new
        for p in ((i, j) for i in range(11) for j in range(11)):
            assert found[s, *p][1] == (p in valid) and np.isclose(found[s, *p][0], valid.get(p, 0.0))
    assert filled


def test_banded_resampling_is_near_the_exact_one(spark):
    from pixelloom.operators import stencil

    y, x = np.mgrid[:30, :30]
    a = np.exp(-((y - 14.3) ** 2 + (x - 15.1) ** 2) / 12.0)
    pixels = spark.createDataFrame(pixel_rows(0, "b", a), PIXELS)
    mapping = spark.createDataFrame([(0, 14, 14, 2.0, 0.0, 0.0, 2.0, 0.5, 0.25)], "image_id long, ny int, nx int, m_yy double, m_yx double, m_xy double, m_xx double, m_y0 double, m_x0 double")
    exact, banded = (table(stencil.resample(pixels, mapping, window=w), "band", "y", "x") for w in (None, 3))
    assert set(exact) == set(banded) and max(abs(exact[k] - banded[k]) for k in exact) < 0.02
    noisy = spark.createDataFrame(pixel_rows(0, "b", 50 * a + np.random.default_rng(0).normal(size=a.shape)), PIXELS)
    plain, quiet = (table(stencil.resample(noisy, mapping, denoise=d), "band", "y", "x") for d in (None, {"scales": 3, "max_iter": 4}))
    error = lambda found: sum((found[k] - 50 * exact[k]) ** 2 for k in exact)
    assert error(quiet) < 0.6 * error(plain)
