"""Queries over frames (group B)."""

from pyspark.sql import functions as F

from pixelloom.operators import boxes as B
from pixelloom.operators import frames as O
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query


@query("b1_frame_of", over(X.V, select="SELECT image_id, count(DISTINCT band) AS n_channels, max(y) + 1 AS ny, max(x) + 1 AS nx, string_agg(DISTINCT band, ',' ORDER BY band) AS channels FROM v GROUP BY image_id"))
def b1(s, d):
    return O.frame_of(X.v(s, d)).withColumn("channels", F.concat_ws(",", "channels"))


CHANNELS = "ch AS (SELECT image_id, band, row_number() OVER (PARTITION BY image_id ORDER BY band) - 1 AS k FROM (SELECT DISTINCT image_id, band FROM v))"


@query("b2_channel_map", over(X.V, CHANNELS, """o AS (SELECT image_id, band, k AS model_index, row_number() OVER (PARTITION BY image_id ORDER BY k DESC) - 1 AS obs_index FROM ch WHERE k % 2 = image_id % 2)""", select="""SELECT image_id, band, CAST(obs_index AS INTEGER) AS obs_index, CAST(model_index AS INTEGER) AS model_index,
 max(model_index) OVER w - min(model_index) OVER w + 1 = count(*) OVER w AS contiguous FROM o WINDOW w AS (PARTITION BY image_id)"""))
def b2(s, d):
    f = O.frame_of(X.v(s, d)).withColumn("observed", F.reverse(F.filter("channels", lambda c, i: i % 2 == F.col("image_id") % 2)))
    return O.channel_map(f)


@query("b3_map_channels", over(X.V, select="SELECT image_id, CASE WHEN band < 'm' THEN 'blue' ELSE 'red' END AS band, y, x, CAST(sum(value * length(band)) AS BIGINT) AS value FROM v GROUP BY ALL"))
def b3(s, d):
    v = X.v(s, d)
    m = v.select("image_id", "band").distinct().selectExpr("image_id", "band", "CASE WHEN band < 'm' THEN 'blue' ELSE 'red' END AS out_band", "length(band) AS weight")
    return O.map_channels(v, m)


SKY = "SELECT c.image_id, source_id, round(crval1 + pc11 * (x - crpix1) + pc12 * (y - crpix2), 6) AS ra, round(crval2 + pc21 * (x - crpix1) + pc22 * (y - crpix2), 6) AS dec FROM catalog c JOIN frames USING (image_id)"


@query("b4_pixel_to_sky", over(X.CATALOG, X.FRAMES, select=SKY))
def b4(s, d):
    return O.pixel_to_sky(X.catalog(s, d), X.frames(s, d)).selectExpr("image_id", "source_id", "round(ra, 6) AS ra", "round(dec, 6) AS dec")


@query("b4_sky_to_pixel", over(X.CATALOG, select="SELECT image_id, source_id, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM catalog"))
def b4b(s, d):
    f = X.frames(s, d)
    return O.sky_to_pixel(O.pixel_to_sky(X.catalog(s, d), f, tangent=True).drop("y", "x"), f, tangent=True).selectExpr("image_id", "source_id", "round(y, 5) AS y", "round(x, 5) AS x")


OTHER = "other AS (SELECT image_id, 2.0 AS m11, 0.5 AS m12, -0.5 AS m21, 2.0 AS m22, crpix1, crpix2, crval1, crval2 FROM frames)"


def other_frames(s, d):
    return X.frames(s, d).selectExpr("image_id", "ny", "nx", "2.0D AS pc11", "0.5D AS pc12", "-0.5D AS pc21", "2.0D AS pc22", "crpix1", "crpix2", "crval1", "crval2", "'wide' AS psf")


@query("b5_convert_pixels", over(X.FRAMES, OTHER, select="""SELECT image_id, CAST(gy AS INTEGER) AS y_from, CAST(gx AS INTEGER) AS x_from, round((m11 * (pc21 * (gx - 12) + pc22 * (gy - 15)) - m21 * (pc11 * (gx - 12) + pc12 * (gy - 15))) / 4.25 + 15, 6) + 0 AS y_to,
 round((m22 * (pc11 * (gx - 12) + pc12 * (gy - 15)) - m12 * (pc21 * (gx - 12) + pc22 * (gy - 15))) / 4.25 + 12, 6) + 0 AS x_to FROM frames JOIN other USING (image_id) CROSS JOIN range(30) a(gy) CROSS JOIN range(24) b(gx)"""))
def b5(s, d):
    return O.convert_pixels(None, X.frames(s, d), other_frames(s, d)).selectExpr("image_id", "y_from", "x_from", "round(y_to, 6) + 0 AS y_to", "round(x_to, 6) + 0 AS x_to")


@query("b6_scale_rotation", over(X.FRAMES, OTHER, select="""SELECT image_id, round(sqrt(abs(pc11 * pc22 - pc12 * pc21)), 6) AS scale, round((pc11 * m11 + pc21 * m21) / sqrt((pc11 * pc11 + pc21 * pc21) * (m11 * m11 + m21 * m21)), 6) AS cos,
 round((pc11 * m21 - pc21 * m11) / sqrt((pc11 * pc11 + pc21 * pc21) * (m11 * m11 + m21 * m21)), 6) AS sin, round(sqrt(abs(pc11 * pc22 - pc12 * pc21) / 4.25), 6) AS ratio FROM frames JOIN other USING (image_id)"""))
def b6(s, d):
    f = X.frames(s, d)
    return O.pixel_scale(f).join(O.frame_rotation(f, other_frames(s, d)), "image_id").selectExpr("image_id", *[f"round({c}, 6) AS {c}" for c in ("scale", "cos", "sin", "ratio")])


@query("b7_match_kind", over(X.FRAMES, select="SELECT image_id, CASE WHEN image_id % 3 <> 0 THEN 'resample' WHEN image_id % 2 = 0 THEN 'null' ELSE 'convolve' END AS kind FROM frames"))
def b7(s, d):
    f = X.frames(s, d)
    model = f.selectExpr("image_id", "1.0D AS pc11", "0.0D AS pc12", "0.0D AS pc21", "1.0D AS pc22", "'narrow' AS psf")
    return O.match_kind(f.withColumn("psf", F.when(F.col("image_id") % 2 == 0, "narrow").otherwise("wide")), model)


@query("b8_common_frame", over(X.BOXES, select="""SELECT image_id, min(y0) - 2 AS y0, max(y1) + 2 AS y1, min(x0) - 2 AS x0, max(x1) + 2 AS x1, string_agg('b' || CAST(box_id AS VARCHAR), ',' ORDER BY box_id) AS channels,
 CAST(min(y1 - y0) AS DOUBLE) AS scale, min_by(box_id, CAST(x1 - x0 AS BIGINT) * 1000000000 + box_id) AS narrowest, max_by(box_id, CAST(x1 - x0 AS BIGINT) * 1000000000 + box_id) AS widest FROM boxes GROUP BY image_id"""))
def b8(s, d):
    o = X.boxes(s, d).selectExpr("image_id", "box_id AS obs_id", "y0", "y1", "x0", "x1", "array(concat('b', box_id)) AS channels", "CAST(y1 - y0 AS DOUBLE) AS scale", "x1 - x0 AS psf_size")
    return O.common_frame(o, "union", 2).withColumn("channels", F.concat_ws(",", "channels"))


@query("b9_project_to_frame", over(X.V, X.BOXES, "f AS (SELECT image_id, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM boxes GROUP BY ALL)", select="""SELECT f.image_id, v0.band, CAST(gy - y0 AS INTEGER) AS y, CAST(gx - x0 AS INTEGER) AS x, coalesce(v.value, 0) AS value
 FROM f JOIN (SELECT DISTINCT image_id, band FROM v) v0 USING (image_id) CROSS JOIN range(60) a(gy) CROSS JOIN range(60) b(gx)
 LEFT JOIN v ON v.image_id = f.image_id AND v.band = v0.band AND v.y = gy AND v.x = gx WHERE gy >= y0 AND gy < y1 AND gx >= x0 AND gx < x1"""))
def b9(s, d):
    return O.project_to_frame(X.v(s, d), B.box_union_agg(X.boxes(s, d), ["image_id"])).selectExpr("image_id", "band", "CAST(y AS INT) AS y", "CAST(x AS INT) AS x", "CAST(value AS BIGINT) AS value")
