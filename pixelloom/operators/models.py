"""Source models: outer products of spectra and morphologies, sums over components, analytic profiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.grid import IMAGE, PLACE, explode_grid, uniform

SOURCE = [IMAGE, "source_id"]
COMPONENT = [*SOURCE, "comp_id"]


def component_model(seds: DataFrame, morphs: DataFrame) -> DataFrame:
    """value = sed x m for every band and pixel of each component.

    The hint, as Spark takes the pixels of exploded shapes for as few as their sources and would broadcast them.
    """
    by = [c for c in COMPONENT if c in seds.columns and c in morphs.columns]
    return seds.join(morphs.hint("merge"), by).select(*by, "band", "y", "x", (F.col("sed") * F.col("m")).alias("value"))


def cube_model(cubes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Free cubes (box-local y, x, m) at their origins (y0, x0)."""
    by = [c for c in COMPONENT if c in cubes.columns and c in boxes.columns]
    return cubes.join(boxes, by).selectExpr(*by, "band", "y + y0 AS y", "x + x0 AS x", "m AS value")


def combine(models: DataFrame, how: str = "add", by: tuple[str, ...] = tuple(PLACE)) -> DataFrame:
    """The sum or the product of all models at each pixel."""
    if how == "add":
        return models.groupBy(*by).agg(F.sum("value").alias("value"))
    return models.groupBy(*by).agg(F.aggregate(F.collect_list(F.col("value").cast("double")), F.lit(1.0), lambda a, v: a * v).alias("value"))


def source_model(seds: DataFrame, morphs: DataFrame) -> DataFrame:
    """The sum of a source's components."""
    return component_model(seds, morphs).groupBy(*SOURCE, "band", "y", "x").agg(F.sum("value").alias("value"))


def blend_model(seds: DataFrame, morphs: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """The sum of all sources of an image; with ``grid`` (image_id, band, y, x) dense, 0 where there is no source."""
    total = component_model(seds, morphs).groupBy(*PLACE).agg(F.sum("value").alias("value"))
    if grid is None:
        return total
    return grid.select(*PLACE).join(total, PLACE, "left").select(*PLACE, F.coalesce("value", F.lit(0)).alias("value"))


def erf(x: Column) -> Column:
    """The error function to 1.5e-7, by the rational approximation 7.1.26 of Abramowitz and Stegun (fixed values)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def centred(df: DataFrame, boxsize: str) -> DataFrame:
    """dy, dx over the odd square of each row's ``boxsize`` expression."""
    return explode_grid(df, f"-(({boxsize}) div 2)", f"({boxsize}) div 2 + 1", f"-(({boxsize}) div 2)", f"({boxsize}) div 2 + 1", "dy", "dx")


def unit_sum(df: DataFrame, keys: list[str], col: str = "k") -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn(col, F.col(col) / F.sum(col).over(Window.partitionBy(*keys)))


def gaussian_psf(sigmas: DataFrame, boxsize: int | None = None, integrated: bool = True) -> DataFrame:
    """keys, dy, dx, k: separable Gaussians of unit sum for each row's ``sigma``.

    The default box is ceil(10 sigma), made odd. Pixel-integrated values are differences of the error function.
    """
    keys = [c for c in sigmas.columns if c != "sigma"]
    size = str(boxsize) if boxsize else "2 * (CAST(ceil(10 * sigma) AS INT) div 2) + 1"
    g = centred(sigmas, size)
    if integrated:
        part = lambda c: erf((F.col(c) + 0.5) / (F.col("sigma") * math.sqrt(2))) - erf((F.col(c) - 0.5) / (F.col("sigma") * math.sqrt(2)))
        g = g.withColumn("k", part("dy") * part("dx"))
    else:
        g = g.withColumn("k", F.expr("exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))"))
    return unit_sum(g, keys).select(*keys, "dy", "dx", "k")


def moffat_psf(params: DataFrame, boxsize: int | None = None) -> DataFrame:
    """keys, dy, dx, k: (1 + r^2 / alpha^2)^-beta of unit sum; the default box is ceil(5 alpha), made odd."""
    keys = [c for c in params.columns if c not in ("alpha", "beta")]
    g = centred(params, str(boxsize) if boxsize else "2 * (CAST(ceil(5 * alpha) AS INT) div 2) + 1")
    return unit_sum(g.withColumn("k", F.expr("pow(1 + (dy * dy + dx * dx) / (alpha * alpha), -beta)")), keys).select(*keys, "dy", "dx", "k")


def sheared(catalog: DataFrame, boxsize: str) -> DataFrame:
    """Pixels around each source with ``r2``, the squared radius in units of ``radius`` after undoing the ellipticity (e1, e2)."""
    g = explode_grid(catalog, f"CAST(round(cy) AS INT) - ({boxsize}) div 2", f"CAST(round(cy) AS INT) + ({boxsize}) div 2 + 1", f"CAST(round(cx) AS INT) - ({boxsize}) div 2", f"CAST(round(cx) AS INT) + ({boxsize}) div 2 + 1")
    u, w = "((1 - e1) * (x - cx) - e2 * (y - cy))", "((1 + e1) * (y - cy) - e2 * (x - cx))"
    return g.withColumn("r2", F.expr(f"({u} * {u} + {w} * {w}) / ((1 - e1 * e1 - e2 * e2) * radius * radius)"))


def gaussian_profile(catalog: DataFrame, boxsize: str = "CAST(ceil(10 * radius) AS INT)") -> DataFrame:
    """image_id, source_id, y, x, value = exp(-R^2 / 2); columns cy, cx, radius, e1, e2 describe each source. Its integral is 2 pi radius^2."""
    return sheared(catalog, boxsize).withColumn("value", F.exp(-F.col("r2") / 2)).select(*SOURCE, "y", "x", "value")


# The quartic of the half-light constant of the Spergel profile, from the fourth power down.
SPERGEL = [-0.00788962, 0.0735303, -0.27770785, 0.99483285, 1.25227402]
# Lanczos's approximation of the gamma function with g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def gamma(z: Column) -> Column:
    """The gamma function for positive arguments."""
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        s = s + c / (z + i)
    t = z + 6.5
    return F.sqrt(F.lit(2 * math.pi)) * F.pow(t, z - 0.5) * F.exp(-t) * s


def spergel_profile(catalog: DataFrame, boxsize: str = "CAST(ceil(10 * radius) AS INT)", step: float = 0.05, top: float = 12.0) -> DataFrame:
    """value = (x / 2)^nu K_nu(x) / gamma(nu + 1) of each source's nu (-0.85 to 4), radius (half light), e1, e2, cy, cx.

    K_nu is the integral of exp(-x cosh t) cosh(nu t), summed over a fixed array of nodes inside the row.
    """
    nodes = np.arange(0, top + step / 2, step)
    weights = np.full(len(nodes), step)
    weights[0] = step / 2
    table = F.array(*[F.struct(F.lit(float(math.cosh(t))).alias("c"), F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in zip(nodes, weights, strict=True)])
    c = sum((F.lit(z) * F.pow("nu", F.lit(4 - i)) for i, z in enumerate(SPERGEL)), F.lit(0.0))
    g = sheared(catalog.withColumn("nu", F.greatest(F.lit(-0.85), F.least(F.lit(4.0), F.col("nu")))), boxsize).withColumn("q", F.sqrt(F.col("r2") + 1e-4) * c)
    bessel = F.aggregate(table, F.lit(0.0), lambda a, n: a + n["w"] * F.exp(-F.col("q") * n["c"]) * F.cosh(F.col("nu") * n["t"]))
    return g.withColumn("value", F.pow(F.col("q") / 2, F.col("nu")) * bessel / gamma(F.col("nu") + 1)).select(*SOURCE, "y", "x", "value")


def point_source_model(catalog: DataFrame, sigma: float, boxsize: int = 15) -> DataFrame:
    """The pixel-integrated Gaussian psf at each source's sub-pixel centre cy, cx, in the box around its rounded centre."""
    g = explode_grid(catalog, f"CAST(round(cy) AS INT) - {boxsize // 2}", f"CAST(round(cy) AS INT) + {boxsize // 2} + 1", f"CAST(round(cx) AS INT) - {boxsize // 2}", f"CAST(round(cx) AS INT) + {boxsize // 2} + 1")
    part = lambda a, c: (erf((F.col(a) - F.col(c) + 0.5) / (sigma * math.sqrt(2))) - erf((F.col(a) - F.col(c) - 0.5) / (sigma * math.sqrt(2)))) / 2
    return g.withColumn("value", part("y", "cy") * part("x", "cx")).select(*SOURCE, "y", "x", "value")


def integrate_profile(cells: DataFrame, profile, n_sub: int = 3) -> DataFrame:
    """Pixel averages of a profile: a trapezoid over ``n_sub`` (odd) points to a side, corners a quarter and edges a half.

    ``cells`` has keys, y, x; ``profile`` takes the sub-pixel positions as columns sy, sx and gives a column.
    """
    keys = [c for c in cells.columns if c not in ("y", "x")]
    last = n_sub - 1
    entries = ", ".join(f"({i / last - 0.5}D, {j / last - 0.5}D, {(0.5 if i in (0, last) else 1.0) * (0.5 if j in (0, last) else 1.0) / last**2}D)" for i in range(n_sub) for j in range(n_sub))
    fine = cells.selectExpr(*cells.columns, f"inline(array({entries})) AS (oy, ox, w)").withColumn("sy", F.col("y") + F.col("oy")).withColumn("sx", F.col("x") + F.col("ox"))
    return fine.withColumn("value", profile(F.col("sy"), F.col("sx")) * F.col("w")).groupBy(*keys, "y", "x").agg(F.sum("value").alias("value"))


def random_components(frames: DataFrame, bands: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Uniform random seds and morphologies over each image's whole frame; numbers follow from the seed and the place."""
    seds = frames.select(IMAGE).join(bands, IMAGE).select(IMAGE, F.lit(0).cast("long").alias("source_id"), F.lit(0).alias("comp_id"), "band", uniform(seed, "sed", IMAGE, "band").alias("sed"))
    morphs = explode_grid(frames.select(IMAGE, "ny", "nx"), "0", "ny", "0", "nx").select(IMAGE, F.lit(0).cast("long").alias("source_id"), F.lit(0).alias("comp_id"), "y", "x", uniform(seed, "m", IMAGE, "y", "x").alias("m"))
    return seds, morphs
