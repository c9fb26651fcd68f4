"""Queries over pixel projections and coadds (groups D and E)."""

from pyspark.sql import functions as F

from pixelloom.operators import pixels as P
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query

PIX = "image_id, band, y, x"
W = "w AS (SELECT *, CASE WHEN masked OR variance <= 0 THEN 0.0 ELSE 1.0 / CAST(variance AS DOUBLE) END AS weight FROM v)"


@query("d1_with_weights", over(X.V, W, select=f"SELECT {PIX}, round(CAST(weight AS DOUBLE), 9) AS weight FROM w"))
def d1(s, d):
    return P.with_weights(X.v(s, d)).selectExpr("image_id", "band", "y", "x", "round(weight, 9) AS weight")


@query("d2_noise_rms", over(X.V, W, select=f"SELECT {PIX}, round(CASE WHEN weight > 0 THEN 1.0 / sqrt(weight) END, 4) AS rms FROM w"))
def d2(s, d):
    return P.noise_rms(P.with_weights(X.v(s, d))).selectExpr("image_id", "band", "y", "x", "round(rms, 4) AS rms")


@query("d3_band_noise", over(X.V, select="SELECT image_id, band, round(avg(sqrt(variance)), 4) AS rms FROM v GROUP BY ALL"))
def d3(s, d):
    return P.band_noise(X.v(s, d)).selectExpr("image_id", "band", "round(rms, 4) AS rms")


@query("d4_mask_zero_weight", over(X.V, select=f"SELECT {PIX}, CASE WHEN masked THEN 0 ELSE value END AS value, masked AS empty FROM v"))
def d4(s, d):
    return P.mask_zero_weight(P.with_weights(X.v(s, d))).select("image_id", "band", "y", "x", "value", "empty")


@query("d5_residual", over(X.V, select=f"SELECT {PIX}, value - CASE WHEN y >= 10 THEN value // 3 ELSE 0 END AS value FROM v"))
def d5(s, d):
    v = X.v(s, d)
    return P.residual(v, v.where("y >= 10").withColumn("value", F.expr("value div 3"))).select("image_id", "band", "y", "x", "value")


@query("d6_normalize_band", over(X.V, select=f"SELECT {PIX}, round(value / sum(value) OVER (PARTITION BY image_id, band), 9) AS by_sum, round(value / max(value) OVER (PARTITION BY image_id, band), 9) AS by_max FROM v"))
def d6(s, d):
    v = X.v(s, d).withColumn("by_sum", F.col("value")).withColumn("by_max", F.col("value"))
    n = P.normalize_band(P.normalize_band(v, "sum", value="by_sum"), "max", value="by_max")
    return n.selectExpr("image_id", "band", "y", "x", "round(by_sum, 9) AS by_sum", "round(by_max, 9) AS by_max")


@query("d7_to_rgb_linear", over(X.V, "k AS (SELECT *, dense_rank() OVER (ORDER BY band) - 1 AS k FROM v)", select="""SELECT image_id, y, x, round(sum(value * CASE k WHEN 3 THEN 0.667e0 / 1.667e0 WHEN 4 THEN 1 / 1.667e0 ELSE 0 END), 3) AS r,
 round(sum(value * CASE k WHEN 1 THEN 0.333e0 / 1.667e0 WHEN 2 THEN 1 / 1.667e0 WHEN 3 THEN 0.333e0 / 1.667e0 ELSE 0 END), 3) AS g, round(sum(value * CASE k WHEN 0 THEN 1 / 1.667e0 WHEN 1 THEN 0.667e0 / 1.667e0 ELSE 0 END), 3) AS b FROM k GROUP BY ALL"""))
def d7(s, d):
    v = X.v(s, d)
    names = sorted(r[0] for r in v.select("band").distinct().collect())
    return P.to_rgb_linear(v, names).selectExpr("image_id", "y", "x", *[f"round({c}, 3) AS {c}" for c in "rgb"])


ENDS = "ends AS (SELECT image_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM l GROUP BY ALL)"


@query("d8_percentile_stretch", over(X.L, ENDS, "t AS (SELECT l.*, (greatest(least(value, hi), lo) - lo) / nullif(hi - lo, 0) AS t FROM l JOIN ends USING (image_id))",
    select=f"SELECT {PIX}, CAST(coalesce(floor(t * 255 + 1e-9), 0) AS INTEGER) AS linear, CAST(coalesce(floor(asinh(t * sinh(1)) * 255 + 1e-9), 0) AS INTEGER) AS asinh FROM t"))
def d8(s, d):
    stretched = P.percentile_stretch(X.l(s, d)).withColumnRenamed("level", "linear")
    return P.percentile_stretch(stretched, kind="asinh").selectExpr("image_id", "band", "y", "x", "linear", "level AS asinh")


U9 = "(CAST('0x' || substr(sha256('7:{salt}:' || image_id || ':' || band || ':' || y || ':' || x), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0"


@query("d9_inject_noise", over(X.V, f"u AS (SELECT *, {U9.format(salt='radius')} AS u1, {U9.format(salt='angle')} AS u2 FROM v)",
    select="SELECT image_id, band, y, x, round(value + CASE WHEN masked THEN 0 ELSE sqrt(-2e0 * ln(u1)) * cos(2e0 * pi() * u2) * sqrt(CAST(variance AS DOUBLE)) END, 4) AS value, round(CASE WHEN masked THEN 0 ELSE 1e0 / variance END / 2, 9) AS weight FROM u"))
def d9(s, d):
    return P.inject_noise(P.with_weights(X.v(s, d)), 1.0, 7).selectExpr("image_id", "band", "y", "x", "round(value, 4) + 0 AS value", "round(weight, 9) AS weight")


COADD = "coadd AS (SELECT image_id, y, x, CAST(sum(value) AS BIGINT) AS value FROM v GROUP BY ALL)"


@query("d10_center_flux", over(X.V, X.CATALOG, COADD, "n AS (SELECT c.image_id, source_id, a.y, a.x, a.value FROM catalog c JOIN coadd a ON a.image_id = c.image_id AND abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1)",
    select="SELECT image_id, source_id, y, x, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id, source_id ORDER BY value DESC, y, x) AS k FROM n) WHERE k = 1"))
def d10(s, d):
    return P.center_flux(P.sum_coadd(X.v(s, d)), X.catalog(s, d))


@query("e1_sum_coadd", over(X.V, COADD, select="SELECT * FROM coadd"))
def e1(s, d):
    return P.sum_coadd(X.v(s, d))


@query("e2_chi2_coadd", over(X.V, "n AS (SELECT image_id, band, avg(sqrt(variance)) AS rms FROM v GROUP BY ALL)", select="SELECT image_id, y, x, round(sum(value / (rms * rms)), 6) AS value FROM v JOIN n USING (image_id, band) GROUP BY ALL"))
def e2(s, d):
    v = X.v(s, d)
    return P.chi2_coadd(v, P.band_noise(v)).selectExpr("image_id", "y", "x", "round(value, 6) AS value")


@query("e3_spectrum_coadd", over(X.V, select="SELECT image_id, y, x, round(sum(length(band) * value / variance), 6) AS value, round(sqrt(sum(length(band) * length(band) / CAST(variance AS DOUBLE))), 6) AS std FROM v WHERE NOT masked GROUP BY ALL"))
def e3(s, d):
    v = X.v(s, d)
    spectra = v.select("image_id", "band").distinct().selectExpr("image_id", "band", "CAST(length(band) AS DOUBLE) AS s")
    return P.spectrum_coadd(v, spectra).selectExpr("image_id", "y", "x", "round(value, 6) AS value", "round(std, 6) AS std")
