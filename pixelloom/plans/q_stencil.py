"""Queries over stencils, wavelets, convolution and resampling (group F)."""

from pyspark.sql import functions as F

from pixelloom.operators import stencil as S
from pixelloom.operators.frames import frame_of
from pixelloom.plans import fixtures as X
from pixelloom.plans.registry import over, query

COLS = ["image_id", "band", "y", "x"]


def smooth_sql(source: str, name: str, step: int, keys: str = "image_id, band", value: str = "value") -> str:
    """SQL of one separable smoothing, named ``name``, with column ``value``."""
    part = lambda w: f"(lag(value, {2 * step}, 0) OVER {w} + lead(value, {2 * step}, 0) OVER {w} + 4 * (lag(value, {step}, 0) OVER {w} + lead(value, {step}, 0) OVER {w}) + 6 * value) / 16e0"
    return f"""{name}_r AS (SELECT {keys}, y, x, {part('w')} AS value FROM (SELECT {keys}, y, x, CAST({value} AS DOUBLE) AS value FROM {source}) WINDOW w AS (PARTITION BY {keys}, x ORDER BY y)),
{name} AS (SELECT {keys}, y, x, {part('w')} AS value FROM {name}_r WINDOW w AS (PARTITION BY {keys}, y ORDER BY x))"""


def transform_sql(source: str, scales: int, generation: int = 2, prefix: str = "s", keys: str = "image_id, band") -> list[str]:
    """CTEs of a starlet transform; the last is ``{prefix}w`` (keys, y, x, scale, value)."""
    out, c, planes = [], source, []
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in [*keys.split(","), "y", "x"])
    cols = ", ".join(f"a.{k.strip()}" for k in [*keys.split(","), "y", "x"])
    for j in range(scales):
        out.append(smooth_sql(c, f"{prefix}c{j + 1}", 2**j, keys))
        low = f"{prefix}c{j + 1}"
        if generation == 2:
            out.append(smooth_sql(low, f"{prefix}h{j}", 2**j, keys))
            low = f"{prefix}h{j}"
        planes.append(f"SELECT {cols}, {j} AS scale, a.value - b.value AS value FROM {c} a JOIN {low} b ON {on}")
        c = f"{prefix}c{j + 1}"
    planes.append(f"SELECT {cols}, {scales} AS scale, a.value FROM {c} a")
    return [*out, f"{prefix}w AS ({' UNION ALL '.join(planes)})"]


def rounded(df, n=6, *more):
    return df.select(*[c for c in COLS if c in df.columns], *more, F.round("value", n).alias("value"))


@query("f1_bspline_smooth", over(X.V, smooth_sql("v", "s", 2), select="SELECT image_id, band, y, x, round(value, 6) AS value FROM s"))
def f1(s, d):
    return rounded(S.bspline_smooth(X.v(s, d), 1))


@query("f2_starlet_scales", over(X.L, select="SELECT image_id, CAST(max(y) + 1 AS INTEGER) AS ny, CAST(max(x) + 1 AS INTEGER) AS nx, CAST(least(3, floor(log2(least(max(y) + 1, max(x) + 1))) - 1) AS INTEGER) AS scales FROM l GROUP BY image_id"))
def f2(s, d):
    return S.starlet_scales(frame_of(X.l(s, d)), 3).select("image_id", "ny", "nx", "scales")


BYSUM = "c AS (SELECT image_id, 'sum' AS band, y, x, sum(value) AS value FROM v GROUP BY ALL)"


@query("f3_starlet_transform", over(X.V, BYSUM, *transform_sql("c", 3), select="SELECT image_id, band, y, x, scale, round(value, 6) + 0 AS value FROM sw"))
def f3(s, d):
    c = X.v(s, d).groupBy("image_id", F.lit("sum").alias("band"), "y", "x").agg(F.sum("value").alias("value"))
    return rounded(S.starlet_transform(c, 3), 6, "scale").withColumn("value", F.col("value") + 0)


@query("f4_multiband_starlet", over(X.V, *transform_sql("v", 2, 1), select="SELECT image_id, band, y, x, scale, round(value, 6) + 0 AS value FROM sw"))
def f4(s, d):
    return rounded(S.starlet_transform(X.v(s, d), 2, generation=1), 6, "scale").withColumn("value", F.col("value") + 0)


@query("f5_starlet_reconstruct", over(X.V, select="SELECT image_id, band, y, x, round(CAST(value AS DOUBLE), 4) AS value FROM v"))
def f5(s, d):
    return rounded(S.starlet_reconstruct(S.starlet_transform(X.v(s, d), 3), 3), 4).withColumn("value", F.col("value") + 0)


@query("f6_starlet_norm", over("f AS (SELECT DISTINCT l_suppkey // 5 AS image_id FROM lineitem)", "u AS (SELECT image_id, 'unit' AS band, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CASE WHEN gy = 25 AND gx = 25 THEN 1e0 ELSE 0e0 END AS value FROM f CROSS JOIN range(50) a(gy) CROSS JOIN range(50) b(gx))",
    *transform_sql("u", 3), select="SELECT image_id, scale, round(sqrt(sum(value * value)), 9) AS norm FROM sw GROUP BY ALL"))
def f6(s, d):
    return S.starlet_norm(frame_of(X.l(s, d)), 3).withColumn("norm", F.round("norm", 9))


def support_sql(coeffs: str, sigma: str, rounds: int) -> list[str]:
    out, last = [], "s0"
    out.append(f"s0 AS (SELECT image_id, band, scale, sigma FROM (SELECT DISTINCT image_id, band, scale FROM {coeffs}) JOIN {sigma} USING (image_id, band))")
    for i in range(1, rounds):
        out.append(f"s{i} AS (SELECT image_id, band, scale, stddev_pop(CASE WHEN abs(value) <= 3 * sigma THEN value ELSE 0 END) AS sigma FROM {coeffs} JOIN {last} USING (image_id, band, scale) GROUP BY ALL)")
        last = f"s{i}"
    out.append(f"support AS (SELECT image_id, band, y, x, scale, CAST(abs(value) > 3 * sigma AS INTEGER) AS support FROM {coeffs} JOIN {last} USING (image_id, band, scale))")
    return out


@query("f7_multiresolution_support", over(X.V, *transform_sql("v", 2), "sg AS (SELECT image_id, band, median(sqrt(variance)) * 20 AS sigma FROM v GROUP BY ALL)", *support_sql("sw", "sg", 4), select="SELECT * FROM support"))
def f7(s, d):
    v = X.v(s, d)
    sigma = v.groupBy("image_id", "band").agg((F.median(F.sqrt("variance")) * 20).alias("sigma"))
    return S.multiresolution_support(S.starlet_transform(v, 2), sigma, epsilon=0.0, max_iter=4).select(*COLS, "scale", "support")


@query("f8_wavelet_denoise")
def f8(s, d):
    c = X.v(s, d).groupBy("image_id", F.lit("sum").alias("band"), "y", "x").agg(F.sum("value").alias("value"))
    return rounded(S.wavelet_denoise(c, 2), 3)


@query("f9_band_wavelets")
def f9(s, d):
    return rounded(S.band_wavelets(X.v(s, d), 2), 3, "scale")


@query("f9_detect_wavelets")
def f9b(s, d):
    return rounded(S.detect_wavelets(X.v(s, d), 3), 3, "scale")


@query("f10_wavelet_layers", over(X.V, BYSUM, *transform_sql("c", 3), select="SELECT image_id, y, x, round(sum(CASE WHEN scale < 3 THEN greatest(value, 0) ELSE 0 END), 4) AS detect, round(sum(CASE WHEN scale < 2 THEN greatest(value, 0) ELSE 0 END), 4) AS bulge, round(sum(CASE WHEN scale = 2 THEN greatest(value, 0) ELSE 0 END), 4) AS disk FROM sw GROUP BY ALL"))
def f10(s, d):
    c = X.v(s, d).groupBy("image_id", F.lit("sum").alias("band"), "y", "x").agg(F.sum("value").alias("value"))
    return S.wavelet_layers(S.starlet_transform(c, 3), 3).select("image_id", "y", "x", *[F.round(c, 4).alias(c) for c in ("detect", "bulge", "disk")])


@query("f11_threshold_starlets", over(X.L, *transform_sql("l", 2), "n AS (SELECT image_id, 2 - scale AS k, scale, 0.5e0 + scale AS norm FROM sw GROUP BY ALL)", select="SELECT image_id, band, y, x, scale, round(CASE WHEN scale = 2 OR (value > 0 AND value > norm) THEN value ELSE 0 END, 6) AS value FROM sw JOIN n USING (image_id, scale)"))
def f11(s, d):
    w = S.starlet_transform(X.l(s, d), 2)
    norms = w.select("image_id", "scale").distinct().withColumn("norm", 0.5 + F.col("scale"))
    return rounded(S.threshold_starlets(w, norms, 1.0, 2), 6, "scale")


def convolve_sql(source: str, name: str, sign: int = 1, ny: int = 30, nx: int = 24) -> str:
    return f"{name} AS (SELECT image_id, band, CAST(p.y + {sign} * dy AS INTEGER) AS y, CAST(p.x + {sign} * dx AS INTEGER) AS x, CAST(sum(value * k) AS BIGINT) AS value FROM {source} p JOIN kern USING (image_id, band) WHERE p.y + {sign} * dy BETWEEN 0 AND {ny - 1} AND p.x + {sign} * dx BETWEEN 0 AND {nx - 1} GROUP BY ALL)"


KERN = X.kernel_sql("v", X.ASYMMETRIC3)


@query("f12_scale_residuals", over(X.V, X.kernel_sql("v", X.BINOMIAL3), convolve_sql("v", "m"), "r AS (SELECT image_id, band, y, x, v.value - m.value AS value FROM v JOIN m USING (image_id, band, y, x))", *transform_sql("r", 2), select="SELECT image_id, band, y, x, scale, round(value, 4) + 0 AS value FROM sw"))
def f12(s, d):
    v = X.v(s, d)
    return rounded(S.scale_residuals(v, v, X.kernel(X.v_planes(s, d), X.BINOMIAL3), 2), 4, "scale").withColumn("value", F.col("value") + 0)


@query("f13_convolve", over(X.V, KERN, convolve_sql("v", "m"), select="SELECT * FROM m"))
def f13(s, d):
    v = X.v(s, d)
    return S.convolve(v, X.kernel(X.v_planes(s, d), X.ASYMMETRIC3))


@query("f14_convolve_adjoint", over(X.V, KERN, convolve_sql("v", "m", -1), select="SELECT * FROM m"))
def f14(s, d):
    v = X.v(s, d)
    return S.convolve_adjoint(v, X.kernel(X.v_planes(s, d), X.ASYMMETRIC3))


def gaussian_kernel(pixels, sigma, r):
    g = pixels.select("image_id", "band").distinct().selectExpr("*", f"{sigma} + length(band) / 20.0D AS sg", f"explode(sequence(-{r}, {r})) AS dy").selectExpr("*", f"explode(sequence(-{r}, {r})) AS dx")
    return g.selectExpr("image_id", "band", "dy", "dx", "exp(-(dy * dy + dx * dx) / (2 * sg * sg)) / (2 * pi() * sg * sg) AS k")


@query("f15_match_psf")
def f15(s, d):
    v = X.v(s, d)
    return S.match_psf(gaussian_kernel(v, 1.5, 10), gaussian_kernel(v, 0.9, 10)).selectExpr("image_id", "band", "dy", "dx", "round(k, 9) AS k")


SHIFT = "sh AS (SELECT DISTINCT l_linenumber AS n, l_linenumber / 8e0 - 0.5 AS shift FROM lineitem)"


@query("f16_kernel_table", over(SHIFT, """b AS (SELECT n, shift, 'bilinear' AS kind, unnest(CASE WHEN shift >= 0 THEN [0, 1] ELSE [-1, 0] END) AS d FROM sh UNION ALL SELECT n, shift, 'catmull_rom', unnest([-1, 0, 1, 2]) + CAST(floor(shift) AS INTEGER) FROM sh
 UNION ALL SELECT n, shift, 'lanczos', unnest([-2, -1, 0, 1, 2, 3]) + CAST(floor(shift) AS INTEGER) FROM sh)""", "t AS (SELECT *, abs(shift - d) AS t FROM b)", select="""SELECT n, kind, d, round(CASE kind WHEN 'bilinear' THEN 1 - t WHEN 'catmull_rom' THEN CASE WHEN t <= 1 THEN (9 * t * t * t - 15 * t * t + 6) / 6 WHEN t < 2 THEN (-3 * t * t * t + 15 * t * t - 24 * t + 12) / 6 ELSE 0 END
 ELSE CASE WHEN t < 1e-12 THEN 1 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END END, 9) + 0 AS k FROM t"""))
def f16(s, d):
    sh = X.table(s, d, "lineitem").selectExpr("l_linenumber AS n", "l_linenumber / 8.0D - 0.5D AS shift").distinct()
    parts = [S.kernel_table(sh, k).selectExpr("n", f"'{k}' AS kind", "d", "round(k, 9) + 0 AS k") for k in ("bilinear", "catmull_rom", "lanczos")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f17_shift_image", over(X.V, """k1 AS (SELECT DISTINCT image_id, band, dy, dx, (CASE dy WHEN 0 THEN 0.75e0 ELSE 0.25e0 END) * (CASE dx WHEN 0 THEN 0.5e0 ELSE 0.5e0 END) AS k FROM v CROSS JOIN (VALUES (0), (1)) a(dy) CROSS JOIN (VALUES (0), (-1)) b(dx))""",
    select="SELECT image_id, band, CAST(v.y + dy AS INTEGER) AS y, CAST(v.x + dx AS INTEGER) AS x, round(sum(value * k), 4) AS value FROM v JOIN k1 USING (image_id, band) WHERE v.y + dy BETWEEN 0 AND 29 AND v.x + dx BETWEEN 0 AND 23 GROUP BY ALL"))
def f17(s, d):
    v = X.v(s, d)
    sh = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "0.25D AS shift_y", "-0.5D AS shift_x")
    return rounded(S.shift_image(v, sh, "bilinear"), 4)


@query("f17_shift_fourier", over(X.V, select="SELECT image_id, band, (y + 3) % 30 AS y, (x + 22) % 24 AS x, CAST(value AS DOUBLE) AS value FROM v"))
def f17b(s, d):
    v = X.v(s, d)
    sh = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "3.0D AS shift_y", "-2.0D AS shift_x")
    return rounded(S.shift_image(v, sh, "fourier"), 3).withColumn("value", F.col("value") + 0)


SINC = "CASE WHEN abs({t}) < 1e-12 THEN 1 ELSE sin(pi() * ({t})) / (pi() * ({t})) END"


@query("f18_resample", over(X.V, "r AS (SELECT image_id, band, CAST(g AS INTEGER) AS ty, x, sum(value * " + SINC.format(t="(2e0 * g + 0.5) - y") + ") AS value FROM v CROSS JOIN range(14) a(g) GROUP BY ALL)",
    select="SELECT image_id, band, ty AS y, CAST(g AS INTEGER) AS x, round(sum(value * " + SINC.format(t="(2e0 * g + 0.25) - x") + "), 3) AS value FROM r CROSS JOIN range(11) a(g) GROUP BY image_id, band, ty, g"))
def f18(s, d):
    v = X.v(s, d)
    m = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "14 AS ny", "11 AS nx", "2.0D AS m_yy", "0.0D AS m_yx", "0.0D AS m_xy", "2.0D AS m_xx", "0.5D AS m_y0", "0.25D AS m_x0")
    return rounded(S.resample(v, m, window=None), 3)


LANCZOS = "(" + SINC + ") * (" + SINC.format(t="({t}) / 3e0") + ")"


@query("f18_resample_banded", over(X.V, "r AS (SELECT image_id, band, CAST(g AS INTEGER) AS ty, x, sum(value * " + LANCZOS.format(t="(2e0 * g + 0.5) - y") + ") AS value FROM v CROSS JOIN range(14) a(g) WHERE abs((2e0 * g + 0.5) - y) < 3 GROUP BY ALL)",
    select="SELECT image_id, band, ty AS y, CAST(g AS INTEGER) AS x, round(sum(value * " + LANCZOS.format(t="(2e0 * g + 0.25) - x") + "), 3) + 0 AS value FROM r CROSS JOIN range(11) a(g) WHERE abs((2e0 * g + 0.25) - x) < 3 GROUP BY image_id, band, ty, g"))
def f18c(s, d):
    v = X.v(s, d)
    m = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "14 AS ny", "11 AS nx", "2.0D AS m_yy", "0.0D AS m_yx", "0.0D AS m_xy", "2.0D AS m_xx", "0.5D AS m_y0", "0.25D AS m_x0")
    return rounded(S.resample(v, m), 3).withColumn("value", F.col("value") + 0)


@query("f18_resample_rotated", over(X.V, "c AS (SELECT image_id, CAST(gy AS INTEGER) AS ty, CAST(gx AS INTEGER) AS tx, 0.8e0 * gy - 0.6e0 * gx + 8.5e0 AS ay, 0.6e0 * gy + 0.8e0 * gx + 2.25e0 AS ax FROM (SELECT DISTINCT image_id FROM v) CROSS JOIN range(20) a(gy) CROSS JOIN range(20) b(gx))",
    select="SELECT image_id, band, ty AS y, tx AS x, round(sum(value * " + LANCZOS.format(t="ay - y") + " * " + LANCZOS.format(t="ax - x") + "), 3) + 0 AS value FROM c JOIN v USING (image_id) WHERE abs(ay - y) < 3 AND abs(ax - x) < 3 GROUP BY image_id, band, ty, tx"))
def f18b(s, d):
    v = X.v(s, d)
    m = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "20 AS ny", "20 AS nx", "0.8D AS m_yy", "-0.6D AS m_yx", "0.6D AS m_xy", "0.8D AS m_xx", "8.5D AS m_y0", "2.25D AS m_x0")
    return rounded(S.resample(v, m, aligned=False), 3).withColumn("value", F.col("value") + 0)


RESAMPLED = ["r AS (SELECT image_id, band, CAST(g AS INTEGER) AS ty, x, sum(value * " + SINC.format(t="(2e0 * g + 0.5) - y") + ") AS value FROM v CROSS JOIN range(14) a(g) GROUP BY ALL)",
    "rv AS (SELECT image_id, band, ty AS y, CAST(g AS INTEGER) AS x, sum(value * " + SINC.format(t="(2e0 * g + 0.25) - x") + ") AS value FROM r CROSS JOIN range(11) a(g) GROUP BY image_id, band, ty, g)"]


@query("f19_render_resampled", over(X.V, X.kernel_sql("v", X.BINOMIAL3), *RESAMPLED, "m AS (SELECT image_id, band, p.y + dy AS y, p.x + dx AS x, sum(value * k) AS value FROM rv p JOIN kern USING (image_id, band) GROUP BY ALL)",
    select="SELECT image_id, band, y - 2 AS y, x - 3 AS x, round(value, 2) + 0 AS value FROM m WHERE y BETWEEN 2 AND 11 AND x BETWEEN 3 AND 8"))
def f19b(s, d):
    v = X.v(s, d)
    m = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "14 AS ny", "11 AS nx", "2.0D AS m_yy", "0.0D AS m_yx", "0.0D AS m_xy", "2.0D AS m_xx", "0.5D AS m_y0", "0.25D AS m_x0")
    boxes = m.selectExpr("image_id", "2 AS y0", "12 AS y1", "3 AS x0", "9 AS x1")
    return rounded(S.render(v, m.selectExpr("image_id", "'resample' AS kind"), X.kernel(X.v_planes(s, d), X.BINOMIAL3), m, boxes), 2).withColumn("value", F.col("value") + 0)


@query("f19_render", over(X.V, X.kernel_sql("v", X.BINOMIAL3), convolve_sql("v", "m"), select="SELECT image_id, band, y - 2 AS y, x - 3 AS x, CAST(CASE WHEN image_id % 2 = 0 THEN v.value ELSE m.value END AS DOUBLE) AS value FROM v JOIN m USING (image_id, band, y, x) WHERE y BETWEEN 2 AND 11 AND x BETWEEN 3 AND 12"))
def f19(s, d):
    v = X.v(s, d)
    kinds = X.v_planes(s, d).select("image_id").distinct().selectExpr("image_id", "CASE WHEN image_id % 2 = 0 THEN 'null' ELSE 'convolve' END AS kind")
    boxes = kinds.selectExpr("image_id", "2 AS y0", "12 AS y1", "3 AS x0", "13 AS x1")
    return S.render(v, kinds, X.kernel(X.v_planes(s, d), X.BINOMIAL3), None, boxes)


@query("f20_pad_crop", over(X.V, select="SELECT image_id, band, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, CAST(coalesce(v.value, 0) AS BIGINT) AS value FROM (SELECT DISTINCT image_id, band FROM v) g CROSS JOIN range(32) a(gy) CROSS JOIN range(25) b(gx) LEFT JOIN v USING (image_id, band) WHERE v.y = gy - 1 AND v.x = gx"
    " UNION ALL SELECT image_id, band, CAST(gy AS INTEGER), CAST(gx AS INTEGER), 0 FROM (SELECT DISTINCT image_id, band FROM v) g CROSS JOIN range(32) a(gy) CROSS JOIN range(25) b(gx) WHERE gy < 1 OR gy > 30 OR gx > 23"))  # fmt: skip
def f20(s, d):
    # The crop of 34 x 28 to 32 x 25 takes one row off the top and two columns off the left.
    padded = S.pad_zero(X.v(s, d), 2, 2)
    return S.center_crop(padded, 32, 25).withColumn("value", F.col("value").cast("long"))


SPLINE = "sk(scale, d, k) AS (VALUES " + ", ".join(f"({j}, {o}, {w!r}e0)" for j, o, w in S.spline_entries(2)) + ")"


@query("f21_scale_spline_convolve", over(X.V, *transform_sql("v", 2), SPLINE, "r AS (SELECT image_id, band, scale, y + d AS y, x, sum(value * k) AS value FROM sw JOIN sk USING (scale) WHERE y + d BETWEEN 0 AND 29 GROUP BY ALL)", "q AS (SELECT image_id, band, scale, y, x + d AS x, sum(value * k) AS value FROM r JOIN sk USING (scale) WHERE x + d BETWEEN 0 AND 23 GROUP BY ALL)",
    select="SELECT image_id, band, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, scale, round(value, 3) + 0 AS value FROM q"))
def f21(s, d):
    return rounded(S.starlet_splines(X.v(s, d), 2), 3, "scale").withColumn("value", F.col("value") + 0)
