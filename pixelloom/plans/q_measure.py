"""Queries over measurement (group H)."""

from pyspark.sql import functions as F

from pixelloom.operators import measure as M
from pixelloom.operators.pixels import with_weights
from pixelloom.plans import fixtures as X
from pixelloom.plans.q_models import MORPHS, morphs
from pixelloom.plans.q_stencil import gaussian_kernel
from pixelloom.plans.registry import over, query


@query("h1_flux", over(X.V, select="SELECT image_id, band, CAST(sum(value) AS BIGINT) AS flux FROM v GROUP BY ALL"))
def h1(s, d):
    return M.flux(X.v(s, d))


@query("h2_magnitude", over(X.V, select="SELECT image_id, band, CAST(sum(value) AS BIGINT) AS flux, round(27 - 2.5 * log10(sum(value)), 6) AS mag FROM v GROUP BY ALL"))
def h2(s, d):
    return M.magnitude(M.flux(X.v(s, d))).withColumn("mag", F.round("mag", 6))


@query("h3_centroid", over(X.V, select="SELECT image_id, band, round(sum(y * value) / CAST(sum(value) AS DOUBLE), 6) AS cy, round(sum(x * value) / CAST(sum(value) AS DOUBLE), 6) AS cx FROM v GROUP BY ALL"))
def h3(s, d):
    return M.centroid(X.v(s, d)).selectExpr("image_id", "band", "round(cy, 6) AS cy", "round(cx, 6) AS cx")


@query("h4_max_pixel", over(X.L, select="SELECT image_id, band, y, x, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id, band ORDER BY value DESC, y, x) AS k FROM l) WHERE k = 1"))
def h4(s, d):
    return M.max_pixel(X.l(s, d))


@query("h5_moments", over(X.V, select="SELECT image_id, band, " + ", ".join(f"CAST(sum(pow(y - 15, {p}) * pow(x - 12, {t - p}) * value) AS DOUBLE) AS m_{p}_{t - p}" for t in range(3) for p in range(t + 1)) + " FROM v GROUP BY ALL"))
def h5(s, d):
    return M.moments(X.v(s, d))


MODEL = "md AS (SELECT image_id, band, y, x, value // 2 + y AS value FROM v)"


def model(s, d):
    return X.v(s, d).selectExpr("image_id", "band", "y", "x", "value div 2 + y AS value")


@query("h6_model_snr", over(X.V, MODEL, "w AS (SELECT md.*, md.value / CAST(sum(md.value) OVER (PARTITION BY md.image_id, md.band) AS DOUBLE) AS w, variance FROM md JOIN v USING (image_id, band, y, x))", select="SELECT image_id, round(sum(value * w) / sqrt(sum(variance * w * w)), 4) AS snr FROM w GROUP BY image_id"))
def h6(s, d):
    return M.model_snr(X.v(s, d), model(s, d)).withColumn("snr", F.round("snr", 4))


KERN = X.kernel_sql("v", X.BINOMIAL3)
STAMP = "st AS (SELECT c.image_id, c.source_id, kern.band, k, v.value, v.variance, v.masked FROM catalog c JOIN kern USING (image_id) LEFT JOIN v ON v.image_id = c.image_id AND v.band = kern.band AND v.y = c.y + dy AND v.x = c.x + dx)"


@query("h7_psf_snr", over(X.V, X.CATALOG, KERN, STAMP, select="SELECT image_id, source_id, round(sum(value * k) / sqrt(sum(k * k * variance)), 4) AS snr FROM st GROUP BY ALL"))
def h7(s, d):
    v = X.v(s, d)
    return M.psf_snr(v, X.kernel(v, X.BINOMIAL3), X.catalog(s, d)).withColumn("snr", F.round("snr", 4))


@query("h8_pixel_spectrum", over(X.V, X.CATALOG, select="SELECT c.image_id, source_id, band, value / length(band) AS sed, value <= 0 AS bad FROM catalog c JOIN v USING (image_id, y, x)"))
def h8(s, d):
    v = X.v(s, d)
    return M.pixel_spectrum(v, X.catalog(s, d), v.select("band").distinct().selectExpr("band", "length(band) AS peak"))


@query("h9_psf_spectrum", over(X.V, X.CATALOG, KERN, STAMP, select="SELECT image_id, source_id, band, round(coalesce(sum(value * k), 0) / CAST(sum(k * k) AS DOUBLE), 6) AS sed FROM st WHERE NOT coalesce(masked, FALSE) GROUP BY ALL"))
def h9(s, d):
    v = X.v(s, d)
    return M.psf_spectrum(v, X.kernel(v, X.BINOMIAL3), X.catalog(s, d)).withColumn("sed", F.round("sed", 6))


GAUSS = "g AS (SELECT image_id, band, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, exp(-(dy * dy + dx * dx) / (2 * sg * sg)) / (2 * pi() * sg * sg) AS k FROM (SELECT DISTINCT image_id, band, 1.5e0 + length(band) / 20e0 AS sg FROM v) CROSS JOIN range(-10, 11) a(dy) CROSS JOIN range(-10, 11) b(dx))"


@query("h10_psf_size", over(X.V, GAUSS, select="SELECT image_id, band, round(3 * sqrt(sum(CASE WHEN k > m / 2 THEN 1 ELSE 0 END) / pi()) / sqrt(2 * ln(2)), 6) AS size FROM (SELECT *, max(k) OVER (PARTITION BY image_id, band) AS m FROM g) GROUP BY ALL"))
def h10(s, d):
    return M.psf_size(gaussian_kernel(X.v(s, d), 1.5, 10)).withColumn("size", F.round("size", 6))


@query("h11_min_psf", over(X.V, GAUSS, "p AS (SELECT image_id, max(k) AS m FROM g GROUP BY ALL)", select="SELECT a.image_id, CAST(max(CASE WHEN abs(a.k - b.k) > 0.01 * m THEN greatest(abs(a.dy), abs(a.dx)) ELSE 0 END) AS INTEGER) AS radius FROM g a JOIN g b ON a.image_id = b.image_id AND a.dy = b.dy AND a.dx = b.dx AND a.band < b.band JOIN p ON p.image_id = a.image_id GROUP BY ALL"))
def h11(s, d):
    return M.min_psf(gaussian_kernel(X.v(s, d), 1.5, 10))


W = "w AS (SELECT *, CASE WHEN masked THEN 0 ELSE 1e0 / variance END AS weight FROM v)"
NORM = "sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) / 2e0 * ln(2 * pi()) + sum(CASE WHEN weight > 0 THEN -ln(weight) / 2 ELSE 0 END)"


@query("h12_log_likelihood", over(X.V, W, MODEL, select=f"SELECT image_id, round({NORM}, 3) AS log_norm, round(-0.5 * sum(weight * (w.value - md.value) * (w.value - md.value)) - ({NORM}), 2) AS logl FROM w JOIN md USING (image_id, band, y, x) GROUP BY image_id"))
def h12(s, d):
    w = with_weights(X.v(s, d))
    return M.log_norm(w).join(M.log_likelihood(w, model(s, d)), "image_id").selectExpr("image_id", "round(log_norm, 3) AS log_norm", "round(logl, 2) AS logl")


@query("h13_lite_log_likelihood", over(X.V, W, MODEL, select="SELECT image_id, round(-0.5 * sum(weight * (w.value - md.value) * (w.value - md.value)), 2) AS logl FROM w JOIN md USING (image_id, band, y, x) GROUP BY image_id"))
def h13(s, d):
    return M.lite_log_likelihood(with_weights(X.v(s, d)), model(s, d)).withColumn("logl", F.round("logl", 2))


@query("h14_component_count", over(X.V, X.CATALOG, KERN, STAMP, "q AS (SELECT image_id, source_id, sum(value * k) / sqrt(sum(k * k * variance)) AS snr FROM st GROUP BY ALL)", select="SELECT image_id, source_id, CAST(least(3, greatest(1, floor(snr / 50))) AS INTEGER) AS k, CASE WHEN snr / 50 < 1 THEN 'psf' WHEN snr / 50 < 2 THEN 'single' ELSE 'double' END AS kind FROM q"))
def h14(s, d):
    v = X.v(s, d)
    snr = M.psf_snr(v, X.kernel(v, X.BINOMIAL3), X.catalog(s, d))
    kinds = M.component_count(snr, 50, lite=True).withColumnRenamed("k", "kind")
    return M.component_count(kinds, 50, 1, 3).select("image_id", "source_id", "k", "kind")


@query("h15_measure_blend", over(X.V, X.CATALOG, X.TRUTH, select="SELECT image_id, source_id, y, x, " + ", ".join(f"round(max(CASE WHEN v.band = '{b}' THEN 27 - 2.5 * log10(v.value + 1) END), 6) AS {b}_mag, max(CASE WHEN v.band = '{b}' THEN t.mag END) AS {b}_truth, round(max(CASE WHEN v.band = '{b}' THEN t.mag - (27 - 2.5 * log10(v.value + 1)) END), 6) AS {b}_diff" for b in ("click", "error")) + " FROM catalog c JOIN v USING (image_id, y, x) JOIN truth t USING (image_id, y, x, band) GROUP BY image_id, source_id, y, x"))
def h15(s, d):
    c = X.catalog(s, d)
    mags = M.magnitude(c.join(X.v(s, d), ["image_id", "y", "x"]).selectExpr("image_id", "source_id", "band", "value + 1 AS flux"))
    out = M.measure_blend(mags, c, X.truth(s, d), ["click", "error"])
    return out.select("image_id", "source_id", "y", "x", *[F.round(f, 6).alias(f) if not f.endswith("truth") else F.col(f) for b in ("click", "error") for f in (f"{b}_mag", f"{b}_truth", f"{b}_diff")])


SEDS = "sd AS (SELECT c.image_id, source_id, band, v.value + 1 AS sed FROM catalog c JOIN v USING (image_id, y, x)), rf AS (SELECT image_id, min(source_id) AS source_id FROM catalog GROUP BY image_id)"


def seds(s, d):
    return X.catalog(s, d).join(X.v(s, d), ["image_id", "y", "x"]).selectExpr("image_id", "source_id", "band", "value + 1 AS sed")


@query("h16_color_similarity", over(X.V, X.CATALOG, SEDS, "r AS (SELECT sd.image_id, band, sed AS ref FROM sd JOIN rf USING (image_id, source_id))", "k AS (SELECT image_id, source_id, sum(CAST(sed AS DOUBLE) * ref) / sqrt(sum(CAST(sed AS DOUBLE) * sed) * sum(CAST(ref AS DOUBLE) * ref)) AS c FROM sd JOIN r USING (image_id, band) GROUP BY ALL)", select="SELECT image_id, source_id, round(c, 6) AS cosine, c > 0.6 AS similar FROM k"))
def h16(s, d):
    t = seds(s, d)
    return M.color_similarity(t, t.groupBy("image_id").agg(F.min("source_id").alias("source_id")), 0.6).withColumn("cosine", F.round("cosine", 6))


@query("h16_similar_model", over(X.V, X.CATALOG, SEDS, MORPHS, "r AS (SELECT sd.image_id, band, sed AS ref FROM sd JOIN rf USING (image_id, source_id))", "k AS (SELECT image_id, source_id FROM sd JOIN r USING (image_id, band) GROUP BY ALL HAVING sum(CAST(sed AS DOUBLE) * ref) / sqrt(sum(CAST(sed AS DOUBLE) * sed) * sum(CAST(ref AS DOUBLE) * ref)) > 0.6 UNION SELECT image_id, source_id FROM rf)",
    select="SELECT image_id, band, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(sum(sed * m) AS BIGINT) AS value, count(DISTINCT source_id) AS n_sources FROM k JOIN sd USING (image_id, source_id) JOIN mo USING (image_id, source_id) GROUP BY ALL"))
def h16b(s, d):
    t = seds(s, d).withColumn("comp_id", F.lit(0))
    return M.similar_model(t, morphs(s, d), t.groupBy("image_id").agg(F.min("source_id").alias("source_id")), 0.6).withColumn("value", F.col("value").cast("long"))


@query("h17_compare_spectra", over(X.V, X.CATALOG, SEDS, select="SELECT image_id, source_id, band, sed AS main, CASE WHEN source_id % 2 = 0 THEN sed // 2 END AS lite FROM sd"))
def h17(s, d):
    t = seds(s, d).withColumnRenamed("sed", "value")
    return M.compare_spectra({"main": t, "lite": t.where("source_id % 2 = 0").withColumn("value", F.expr("value div 2"))})


@query("h18_sdr", over(X.V, MODEL, select="SELECT image_id, round(10 * log10(sqrt(sum(CAST(v.value AS DOUBLE) * v.value)) / sqrt(sum(CAST(v.value - md.value AS DOUBLE) * (v.value - md.value)))), 6) AS sdr FROM v JOIN md USING (image_id, band, y, x) GROUP BY image_id"))
def h18(s, d):
    return M.sdr(X.v(s, d), model(s, d)).withColumn("sdr", F.round("sdr", 6))


SRC = "sm AS (SELECT c.image_id, source_id, kern.band, c.y + dy AS y, c.x + dx AS x, k * (1 + source_id % 3) AS value FROM catalog c JOIN kern USING (image_id))"


@query("h19_redistribute_flux", over(X.V, X.CATALOG, KERN, SRC, select="SELECT sm.image_id, source_id, band, y, x, round(CASE WHEN masked THEN 0 ELSE v.value * greatest(0, least(1, sm.value / CAST(sum(sm.value) OVER (PARTITION BY sm.image_id, band, y, x) AS DOUBLE))) END, 4) AS value FROM sm JOIN v USING (image_id, band, y, x)"))
def h19(s, d):
    v = X.v(s, d)
    m = X.catalog(s, d).join(X.kernel(v, X.BINOMIAL3), "image_id").selectExpr("image_id", "source_id", "band", "y + dy AS y", "x + dx AS x", "k * (1 + source_id % 3) AS value")
    return M.redistribute_flux(v, m).withColumn("value", F.round("value", 4))


@query("h20_param_snr", over(X.V, select="SELECT image_id, band, y, x, round(CASE WHEN value > 0 THEN y * sqrt(value) END, 6) AS snr FROM v"))
def h20(s, d):
    return M.param_snr(X.v(s, d).withColumn("m", F.col("y")).withColumn("m2", F.col("value"))).selectExpr("image_id", "band", "y", "x", "round(snr, 6) AS snr")
