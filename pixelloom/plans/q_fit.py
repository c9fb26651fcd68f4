"""Queries over initial models and fits (groups J and L)."""

from pyspark.sql import functions as F

from pixelloom.functions.grid import cut, scratch
from pixelloom.operators import blocks
from pixelloom.operators import fit as J
from pixelloom.operators.pixels import band_noise, spectrum_coadd, sum_coadd, with_weights
from pixelloom.plans import fixtures as X
from pixelloom.plans.q_models import MORPHS, SEDS, morphs, seds
from pixelloom.plans.q_stencil import convolve_sql, smooth_sql, transform_sql
from pixelloom.plans.registry import over, query
from pixelloom.sources import tables

KERN = X.kernel_sql("v", X.BINOMIAL3)
PARTS = [X.V, X.CATALOG, SEDS, MORPHS]


def weighted(s, d):
    return with_weights(X.v(s, d))


def psf(s, d):
    return X.kernel(X.v_planes(s, d), X.BINOMIAL3)


@query("j1_init_compact", over(X.V, X.CATALOG, "p AS (SELECT band, 4e0 / 16 AS peak FROM v GROUP BY band)", select="SELECT c.image_id, source_id, CAST(0 AS INTEGER) AS comp_id, v.band, round(v.value / peak / 4, 6) AS sed FROM catalog c JOIN v USING (image_id, y, x) JOIN p ON p.band = v.band"))
def j1(s, d):
    k = psf(s, d)
    shape = k.groupBy("dy", "dx").agg(F.max("k").alias("k"))
    return J.init_compact(X.catalog(s, d), X.v(s, d), k, shape)[0].withColumn("sed", F.round("sed", 6))


@query("j2_init_point", over(X.V, X.CATALOG, select="SELECT c.image_id, source_id, CAST(0 AS INTEGER) AS comp_id, band, v.value / 4 AS sed FROM catalog c JOIN v USING (image_id, y, x)"))
def j2(s, d):
    return J.init_point(X.catalog(s, d), X.v(s, d), psf(s, d))


@query("j3_init_extended")
def j3(s, d):
    v = X.v(s, d)
    return J.init_extended(X.catalog(s, d), spectrum_coadd(v), psf(s, d)).withColumn("m", F.round("m", 6))


@query("j4_layer_by_flux", over(*PARTS, "t AS (SELECT *, max(m) OVER (PARTITION BY image_id, source_id) AS top FROM mo)", "r AS (SELECT image_id, source_id, CAST(k AS INTEGER) AS comp_id, y, x, greatest(0, least(m, hi * top) - lo * top) AS m FROM t CROSS JOIN (VALUES (0, 0e0, 0.5e0), (1, 0.5e0, 1e0)) l(k, lo, hi))",
    select="SELECT image_id, source_id, comp_id, y, x, round(m / max(m) OVER (PARTITION BY image_id, source_id, comp_id), 9) AS m FROM r"))
def j4(s, d):
    return J.layer_by_flux(morphs(s, d), (50,)).withColumn("m", F.round("m", 9))


@query("j5_init_monotonic")
def j5(s, d):
    return J.init_monotonic(sum_coadd(X.v(s, d)), X.catalog(s, d)).withColumn("m", F.round("m", 6))


@query("j6_init_sources")
def j6(s, d):
    return J.init_sources(weighted(s, d), X.catalog(s, d), psf(s, d), sum_coadd(X.v(s, d)))[0].withColumn("sed", F.round("sed", 6))


@query("j6_init_sources_wavelet")
def j6b(s, d):
    v = weighted(s, d)
    return J.init_sources_wavelet(v, X.catalog(s, d), psf(s, d), scales=3, min_snr=20)[0].withColumn("sed", F.round("sed", 4))


@query("j7_init_profile", over(X.V, X.CATALOG, select="SELECT c.image_id, source_id, CAST(0 AS INTEGER) AS comp_id, band, round(v.value / exp(-(0.25 * 0.25 + 0.25 * 0.25) / 2 / 4), 6) AS sed FROM catalog c JOIN v USING (image_id, y, x)"))
def j7(s, d):
    from pixelloom.operators.models import gaussian_profile

    c = X.catalog(s, d)
    shaped = gaussian_profile(c.selectExpr("image_id", "source_id", "y + 0.25D AS cy", "x - 0.25D AS cx", "2.0D AS radius", "0.0D AS e1", "0.0D AS e2"), "9")
    return J.init_profile(c, X.v(s, d), shaped)[0].withColumn("sed", F.round("sed", 6))


ONE = "o AS (SELECT image_id, min(source_id) AS source_id FROM catalog GROUP BY image_id)"


@query("j8_fit_seds", over(*PARTS, KERN, ONE, "w AS (SELECT *, CASE WHEN masked THEN 0 ELSE 1e0 / variance END AS weight FROM v)", "mw AS (SELECT image_id, band, avg(weight) AS mean FROM w GROUP BY ALL)", "mm AS (SELECT image_id, band, p.y + dy AS y, p.x + dx AS x, sum(m * k) AS m FROM mo p JOIN o USING (image_id, source_id) JOIN kern USING (image_id) GROUP BY ALL)",
    select="SELECT o.image_id, o.source_id, CAST(0 AS INTEGER) AS comp_id, mm.band, round(CASE WHEN sum(weight * m) / sum(m) / max(mean) > 0.1 THEN greatest(0, sum(weight * m * value) / sum(weight * m * m)) ELSE 0 END, 4) AS sed FROM mm JOIN o USING (image_id) JOIN mw ON mw.image_id = mm.image_id AND mw.band = mm.band JOIN w ON w.image_id = mm.image_id AND w.band = mm.band AND w.y = mm.y AND w.x = mm.x AND mm.y >= (SELECT min(y) FROM mo q WHERE q.image_id = mm.image_id AND q.source_id = o.source_id) AND mm.y <= (SELECT max(y) FROM mo q WHERE q.image_id = mm.image_id AND q.source_id = o.source_id) AND mm.x >= (SELECT min(x) FROM mo q WHERE q.image_id = mm.image_id AND q.source_id = o.source_id) AND mm.x <= (SELECT max(x) FROM mo q WHERE q.image_id = mm.image_id AND q.source_id = o.source_id) GROUP BY ALL"))
def j8(s, d):
    one = X.catalog(s, d).groupBy("image_id").agg(F.min("source_id").alias("source_id"))
    m = morphs(s, d).join(one, ["image_id", "source_id"], "left_semi")
    return J.fit_seds(weighted(s, d), m, psf(s, d)).withColumn("sed", F.round("sed", 4))


@query("j8_fit_seds_all")
def j8b(s, d):
    return J.fit_seds(weighted(s, d), morphs(s, d), psf(s, d)).withColumn("sed", F.round("sed", 3))


@query("j8_flux_shares", over(*PARTS, KERN, "w AS (SELECT *, CASE WHEN masked THEN 0 ELSE 1e0 / variance END AS weight FROM v)", "mw AS (SELECT image_id, band, avg(weight) AS mean FROM w GROUP BY ALL)", "mm AS (SELECT image_id, source_id, band, p.y + dy AS y, p.x + dx AS x, sum(m * k) AS m FROM mo p JOIN kern USING (image_id) GROUP BY ALL)", "bb AS (SELECT image_id, min(y) AS y0, max(y) AS y9, min(x) AS x0, max(x) AS x9 FROM mo GROUP BY ALL)",
    select="SELECT image_id, band, source_id, round(sum(m * weight) / sum(m) / max(mean), 6) AS share FROM mm JOIN w USING (image_id, band, y, x) JOIN mw USING (image_id, band) JOIN bb USING (image_id) WHERE y BETWEEN y0 AND y9 AND x BETWEEN x0 AND x9 GROUP BY ALL"))
def j8c(s, d):
    w = weighted(s, d)
    one = morphs(s, d).join(w.select("image_id", "band").distinct(), "image_id").selectExpr("image_id", "band", "source_id AS comp", "y", "x", "m AS value")
    shown = J.convolve(one, psf(s, d), keys=("image_id", "comp", "band"))
    return J.flux_shares(w, shown).selectExpr("image_id", "band", "comp AS source_id", "round(share, 6) AS share")


@query("j9_drop_empty", over(*PARTS, "z AS (SELECT *, CASE WHEN source_id % 3 = 0 THEN 0 ELSE sed END AS s2 FROM sd)", select="SELECT image_id, source_id, comp_id, band, s2 AS sed FROM z WHERE (image_id, source_id) IN (SELECT (image_id, source_id) FROM z WHERE s2 > 0) AND source_id % 5 <> 1"))
def j9(s, d):
    t = seds(s, d).withColumn("sed", F.expr("CASE WHEN source_id % 3 = 0 THEN 0 ELSE sed END"))
    m = morphs(s, d).withColumn("m", F.expr("CASE WHEN source_id % 5 = 1 THEN 0 ELSE m END"))
    return J.drop_empty(t, m)[0]


@query("j10_starlet_source", over(*PARTS, "mv AS (SELECT image_id, source_id, comp_id, y, x, m AS value FROM mo)", *transform_sql("mv", 1, 2, "s", "image_id, source_id, comp_id"), "nm AS (SELECT image_id, source_id, comp_id, scale, sqrt(sum(value * value)) AS norm FROM sw GROUP BY ALL)",
    "kp AS (SELECT sw.*, CASE WHEN scale = 1 OR (value > 0 AND value > 0.05e0 * norm) THEN value ELSE 0 END AS kept FROM sw JOIN nm USING (image_id, source_id, comp_id, scale))", "k1 AS (SELECT image_id, source_id, comp_id, y, x, kept AS value FROM kp WHERE scale = 1)", smooth_sql("k1", "hs", 1, "image_id, source_id, comp_id"),
    select="SELECT hs.image_id, hs.source_id, hs.comp_id, hs.y, hs.x, round(hs.value + kp.kept, 6) AS m FROM hs JOIN kp ON kp.image_id = hs.image_id AND kp.source_id = hs.source_id AND kp.y = hs.y AND kp.x = hs.x AND kp.scale = 0"))
def j10(s, d):
    return J.starlet_source(morphs(s, d), 1, 0.05).withColumn("m", F.round("m", 6))


G = f"""w AS (SELECT *, CASE WHEN masked THEN 0 ELSE 1e0 / variance END AS weight FROM v),
bm AS (SELECT v.image_id, v.band, v.y, v.x, coalesce(t.value, 0) AS value FROM v LEFT JOIN (SELECT sd.image_id, band, y, x, sum(sed * m) AS value FROM sd JOIN mo USING (image_id, source_id) GROUP BY ALL) t USING (image_id, band, y, x)),
{convolve_sql('bm', 'cm')}, rs AS (SELECT w.image_id, w.band, w.y, w.x, weight * (cm.value - w.value) AS value, weight * (cm.value - w.value) * CAST(cm.value - w.value AS DOUBLE) / 2 AS loss FROM w JOIN cm USING (image_id, band, y, x)),
gr AS (SELECT image_id, band, p.y - dy AS y, p.x - dx AS x, sum(value * k) AS g FROM rs p JOIN kern USING (image_id, band) WHERE p.y - dy BETWEEN 0 AND 29 AND p.x - dx BETWEEN 0 AND 23 GROUP BY ALL)"""


def gradient(s, d):
    return J.likelihood_gradient(weighted(s, d), seds(s, d), morphs(s, d), psf(s, d))


@query("l1_likelihood_gradient", over(*PARTS, KERN, G, select="SELECT image_id, band, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(g, 4) + 0 AS g FROM gr"))
def l1(s, d):
    return gradient(s, d)[0].withColumn("g", F.round("g", 4) + 0)


@query("l1_loss", over(*PARTS, KERN, G, select="SELECT image_id, round(sum(loss), 1) AS loss FROM rs GROUP BY image_id"))
def l1b(s, d):
    return gradient(s, d)[1].withColumn("loss", F.round("loss", 1))


@query("l2_grad_sed", over(*PARTS, KERN, G, select="SELECT mo.image_id, mo.source_id, mo.comp_id, band, round(sum(g * m), 2) + 0 AS g FROM mo JOIN gr USING (image_id, y, x) GROUP BY ALL"))
def l2(s, d):
    return J.grad_sed(gradient(s, d)[0], morphs(s, d)).withColumn("g", F.round("g", 2) + 0)


@query("l2_grad_morph", over(*PARTS, KERN, G, select="SELECT mo.image_id, mo.source_id, mo.comp_id, CAST(mo.y AS INTEGER) AS y, CAST(mo.x AS INTEGER) AS x, round(sum(sed * g) / 1e6, 3) + 0 AS g FROM mo JOIN sd USING (image_id, source_id) JOIN gr ON gr.image_id = mo.image_id AND gr.band = sd.band AND gr.y = mo.y AND gr.x = mo.x GROUP BY ALL"))
def l2b(s, d):
    return J.grad_morph(gradient(s, d)[0], seds(s, d), morphs(s, d)).withColumn("g", F.round(F.col("g") / 1e6, 3) + 0)


@query("l3_step_size", over(*PARTS, "w AS (SELECT image_id, avg(1e0 / variance) AS mean FROM v WHERE NOT masked GROUP BY image_id)", "n AS (SELECT image_id, source_id, comp_id, CAST(sum(m * m) AS DOUBLE) AS n FROM mo GROUP BY ALL)", "r AS (SELECT image_id, source_id, greatest(0.01e0, 0.1e0 * avg(sed)) AS relative FROM sd GROUP BY ALL)",
    select="SELECT image_id, source_id, comp_id, round(relative, 6) AS relative, round(1 / (2 * mean) / n, 9) AS fista FROM n JOIN w USING (image_id) JOIN r USING (image_id, source_id)"))
def l3(s, d):
    rel = J.relative_step(seds(s, d), "sed", 0.1, 0.01).withColumnRenamed("step", "relative")
    fista = J.fista_step(weighted(s, d), morphs(s, d), "m").withColumnRenamed("step", "fista")
    return rel.join(fista, ["image_id", "source_id", "comp_id"]).selectExpr("image_id", "source_id", "comp_id", "round(relative, 6) AS relative", "round(fista, 9) AS fista")


def moments(s, d):
    return X.v(s, d).selectExpr("image_id", "band", "y", "x", "value / 100.0D AS v0", "(y - x) / 10.0D AS g", "0.1D AS m1", "0.2D AS m2", "0.15D AS m2hat", "0.5D AS step")


@query("l4_adaptive_update", over(X.V, "t AS (SELECT image_id, band, y, x, value / 100e0 AS v0, (y - x) / 10e0 AS g FROM v)", "u AS (SELECT *, 0.9e0 * 0.1e0 + 0.1e0 * g AS m, 0.999e0 * 0.2e0 + 0.001e0 * g * g AS q FROM t)",
    select="SELECT image_id, band, y, x, round(v0 - 0.5e0 * (m / (1 - pow(0.9e0, 3))) / (sqrt(q / (1 - pow(0.999e0, 3))) + 1e-8), 6) AS adam, round(v0 - 0.5e0 * ((0.9e0 * m + 0.1e0 * g) / (1 - pow(0.9e0, 3))) / (sqrt(q / (1 - pow(0.999e0, 3))) + 1e-8), 6) AS nadam, round(v0 - 0.5e0 * m / (sqrt(greatest(0.15e0, q)) + 1e-8), 6) AS amsgrad, round(v0 - 0.5e0 * m / (pow(greatest(0.15e0, q), 0.25e0) + 1e-8), 6) AS padam, round(v0 - 0.5e0 * m / (sqrt(greatest(0.15e0, q)) + 1e-8), 6) AS adamx, round(v0 - 0.5e0 * m / (1 - pow(0.9e0, 3)), 6) AS radam FROM u"))
def l4(s, d):
    out = None
    for scheme in J.SCHEMES:
        made = J.adaptive_update(moments(s, d).withColumn("x_", F.col("v0")), 2, scheme, "x_").select("image_id", "band", "y", "x", F.round("x_", 6).alias(scheme))
        out = made if out is None else out.join(made, ["image_id", "band", "y", "x"])
    return out


@query("l4_proximal", over(*PARTS, "z0 AS (SELECT *, m - 1.5e0 AS x_, m - 1.5e0 AS z, (1e0 + (y + x) % 3) / max(1e0 + (y + x) % 3) OVER (PARTITION BY image_id, source_id, comp_id) AS pull FROM (SELECT image_id, source_id, comp_id, y + 100 AS y, x + 100 AS x, m FROM mo))",
    *[f"p{i} AS (SELECT *, greatest(0, z - pull * (z - x_)) AS p FROM z{i - 1}), z{i} AS (SELECT image_id, source_id, comp_id, y, x, x_, pull, p / max(p) OVER (PARTITION BY image_id, source_id, comp_id) AS z FROM p{i})" for i in (1, 2, 3)], select="SELECT image_id, source_id, comp_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(z, 6) + 0 AS m FROM z3"))
def l4b(s, d):
    from pixelloom.operators.constrain import max_normalised, positivity

    t = morphs(s, d).selectExpr("image_id", "source_id", "comp_id", "y + 100 AS y", "x + 100 AS x", "m - 1.5D AS m", "1.0D + (y + x + 200) % 3 AS psi")
    made = J.proximal_iterations(t, lambda z: max_normalised(positivity(z), ("image_id", "source_id", "comp_id")), max_iter=3, e_rel=0)
    return made.selectExpr("image_id", "source_id", "comp_id", "y", "x", "round(m, 6) + 0 AS m")


@query("l5_fista_update", over(X.V, "t AS (SELECT image_id, band, y, x, value / 100e0 AS v0, (y - x) / 10e0 AS g FROM v)", "u AS (SELECT *, greatest(0, v0 + 1 - 0.5e0 * g) AS p FROM t)", select="SELECT image_id, band, y, x, round(p, 6) AS m, round(v0 + (1 + 1 / (0.5e0 * (1 + sqrt(17e0)))) * (p - v0), 6) AS z FROM u"))
def l5(s, d):
    from pixelloom.operators.constrain import positivity

    df = moments(s, d).selectExpr("image_id", "band", "y", "x", "v0 AS m", "v0 + 1 AS z", "g", "step")
    return J.fista_update(df, 2.0, lambda t: positivity(t), "m")[0].selectExpr("image_id", "band", "y", "x", "round(m, 6) AS m", "round(z, 6) AS z")


def blends(s, d):
    """All sources of the catalogue, with morphologies of maximum 1."""
    return seds(s, d), morphs(s, d).withColumn("m", F.col("m") / 3.0)


@query("l6_fit_blends")
def l6(s, d):
    t, m = blends(s, d)
    return J.fit_blends(weighted(s, d), t, m, psf(s, d).withColumn("k", F.col("k") / 16.0))[2].withColumn("loss", F.round("loss", 1))


@query("l6_fit_fista")
def l6b(s, d):
    t, m = blends(s, d)
    return J.fit_blends(weighted(s, d), t, m, psf(s, d).withColumn("k", F.col("k") / 16.0), scheme="fista")[2].withColumn("loss", F.round("loss", 1))


@query("l6_reweight", over(*PARTS, KERN, "sm AS (SELECT sd.image_id, source_id, band, y, x, sum(sed * m) AS value FROM sd JOIN mo USING (image_id, source_id) GROUP BY ALL)", "sn AS (SELECT image_id, source_id, band, p.y + dy AS y, p.x + dx AS x, greatest(0, sum(value * k)) AS value FROM sm p JOIN kern USING (image_id, band) GROUP BY ALL)",
    select="SELECT sn.image_id, sn.source_id, sn.band, CAST(sn.y AS INTEGER) AS y, CAST(sn.x AS INTEGER) AS x, round(CASE WHEN v.masked THEN 0 ELSE v.value * coalesce(greatest(0, least(1, sn.value / CAST(nullif(sum(sn.value) OVER (PARTITION BY sn.image_id, sn.band, sn.y, sn.x), 0) AS DOUBLE))), 0) END, 4) AS value FROM sn JOIN v USING (image_id, band, y, x)"))
def l6c(s, d):
    return J.reweight(weighted(s, d), seds(s, d), morphs(s, d), psf(s, d)).withColumn("value", F.round("value", 4))


@query("l7_fit_multi")
def l7(s, d):
    t, m = blends(s, d)
    w, k = weighted(s, d), psf(s, d).withColumn("k", F.col("k") / 16.0)
    return J.fit_multi([(w, k), (w.withColumn("value", F.col("value") * 1.1), k)], t, m)[2].withColumn("loss", F.round("loss", 1))


@query("l8_resize_components")
def l8(s, d):
    t, m = blends(s, d)
    return J.resize_components(t, m, band_noise(X.v(s, d)))


@query("l8_edge_brightness", over(*PARTS, "b AS (SELECT *, y - min(y) OVER w AS t, max(y) OVER w - y AS bo, x - min(x) OVER w AS l, max(x) OVER w - x AS r FROM (SELECT *, CASE WHEN (y + x + 100) % 4 = 0 THEN 0 ELSE m END AS m2 FROM mo) WINDOW w AS (PARTITION BY image_id, source_id, comp_id))",
    select="SELECT image_id, source_id, comp_id, round(greatest(avg(m2) FILTER (t = 0 AND m2 > 0), avg(m2) FILTER (bo = 0 AND m2 > 0), avg(m2) FILTER (l = 0 AND m2 > 0), avg(m2) FILTER (r = 0 AND m2 > 0)), 6) AS edge FROM b GROUP BY ALL"))
def l8b(s, d):
    return J.edge_brightness(morphs(s, d).withColumn("m", F.expr("CASE WHEN (y + x + 100) % 4 = 0 THEN 0 ELSE m END"))).selectExpr("image_id", "source_id", "comp_id", "round(edge, 6) AS edge")


@query("l9_retried", over(X.CATALOG, select="SELECT image_id, source_id, CAST(CASE WHEN source_id % 6 = 0 THEN 0 WHEN source_id % 4 = 1 THEN 1 ELSE 2 END AS INTEGER) AS k FROM catalog"))
def l9b(s, d):
    def make(left):
        kept = left.select("image_id", "source_id", "k")
        t = seds(s, d).join(kept, ["image_id", "source_id"]).withColumn("sed", F.expr("CASE WHEN source_id % 6 = 0 OR source_id % 4 = 1 AND k = 2 THEN DOUBLE('NaN') ELSE CAST(sed AS DOUBLE) END")).drop("k")
        return t, morphs(s, d).join(kept.drop("k"), ["image_id", "source_id"])

    return J.retried(make, X.catalog(s, d))[2]


@query("l9_check_finite", over(*PARTS, select="SELECT DISTINCT image_id, source_id, comp_id FROM sd WHERE source_id % 4 = 1 OR source_id % 6 = 2"))
def l9(s, d):
    t = seds(s, d).withColumn("sed", F.expr("CASE WHEN source_id % 4 = 1 THEN DOUBLE('NaN') ELSE CAST(sed AS DOUBLE) END"))
    m = morphs(s, d).withColumn("m", F.expr("CASE WHEN source_id % 6 = 2 THEN DOUBLE('Infinity') ELSE CAST(m AS DOUBLE) END"))
    return J.check_finite(t, m)[2]


@query("l10_fit_blends_wavelet")
def l10(s, d):
    t, m = blends(s, d)
    return J.fit_blends_wavelet(weighted(s, d), t, m, psf(s, d).withColumn("k", F.col("k") / 16.0), [1.0, 0.8, 0.5])[2].withColumn("loss", F.round("loss", 1))


@query("l10_fit_starlets")
def l10b(s, d):
    t, m = blends(s, d)
    return J.fit_blends(weighted(s, d), t, m, psf(s, d).withColumn("k", F.col("k") / 16.0), scales=1, thresh=0.05)[2].withColumn("loss", F.round("loss", 1))


@query("a8_resume_fit")
def a8b(s, d):
    """Ten iterations over half of the sources, saved and read again; then all sources go on to twenty."""
    t, m = blends(s, d)
    w, k = weighted(s, d), psf(s, d).withColumn("k", F.col("k") / 16.0)
    noise = J.weight_noise(w)
    state = J.fit_state([(w, k)], blocks.started(t.where("source_id % 2 = 0"), m.where("source_id % 2 = 0"), rms=noise), 10)
    path = scratch(s, "state")
    tables.save_state(state, path)
    grown = blocks.joined_by(tables.load_state(s, path), t.where("source_id % 2 = 1"), m.where("source_id % 2 = 1"), rms=noise)
    return blocks.losses_of(J.fit_state([(w, k)], grown, 20)).withColumn("loss", F.round("loss", 1))


@query("l11_deblend_and_measure")
def l11(s, d):
    return cut(J.deblend_and_measure(weighted(s, d), X.catalog(s, d), X.truth(s, d), psf(s, d), ["click", "error", "purchase", "signup", "view"], "main"))
