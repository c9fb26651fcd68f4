"""Pixel projections, display stretches and coadds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.grid import IMAGE, PLACE, uniform


def with_weights(pixels: DataFrame) -> DataFrame:
    """``weight``: 1 / variance, 0 where masked or where the variance isn't positive."""
    return pixels.withColumn("weight", F.when(F.coalesce("masked", F.lit(False)) | (F.coalesce("variance", F.lit(0)) <= 0), 0.0).otherwise(1.0 / F.col("variance")))


def noise_rms(pixels: DataFrame) -> DataFrame:
    """``rms``: 1 / sqrt(weight), null at weight 0."""
    return pixels.withColumn("rms", F.when(F.col("weight") > 0, 1.0 / F.sqrt("weight")))


def band_noise(pixels: DataFrame) -> DataFrame:
    """Mean of sqrt(variance) of each image and band."""
    return pixels.groupBy(IMAGE, "band").agg(F.avg(F.sqrt("variance")).alias("rms"))


def mask_zero_weight(pixels: DataFrame) -> DataFrame:
    """Value 0 where the weight is 0; ``empty`` says whether it is 0 in all bands of the pixel."""
    lit = F.max(F.col("weight")).over(Window.partitionBy(IMAGE, "y", "x"))
    return pixels.withColumn("empty", lit <= 0).withColumn("value", F.when(F.col("weight") > 0, F.col("value")).otherwise(F.lit(0)))


def residual(pixels: DataFrame, model: DataFrame) -> DataFrame:
    """Data less the model; pixels that the model lacks stay as they are."""
    m = model.select(*PLACE, F.col("value").alias("model_value"))
    return pixels.join(m, PLACE, "left").withColumn("value", F.col("value") - F.coalesce("model_value", F.lit(0))).drop("model_value")


def normalize_band(df: DataFrame, by: str = "sum", keys: tuple[str, ...] = (IMAGE, "band"), value: str = "value") -> DataFrame:
    """Each band (or kernel) divided by its sum or its largest value; null where that is 0."""
    total = (F.sum if by == "sum" else F.max)(value).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.col(value) / F.nullif(total, F.lit(0)))


# Weights of 1 to 7 channels, from blue to red, in red, green and blue, and what each table is divided by.
RGB_WEIGHTS = {
    1: ([[1.0], [1.0], [1.0]], 1.0),
    2: ([[0, 0.667], [0.333, 0.333], [0.667, 0]], 0.667),
    3: ([[0, 0, 1], [0, 1, 0], [1, 0, 0]], 1.0),
    4: ([[0, 0, 0.333, 1], [0, 0.667, 0.667, 0], [1, 0.333, 0, 0]], 1.333),
    5: ([[0, 0, 0, 0.667, 1], [0, 0.333, 1, 0.333, 0], [1, 0.667, 0, 0, 0]], 1.667),
    6: ([[0, 0, 0, 0.333, 0.667, 1], [0, 0.333, 0.667, 0.667, 0.333, 0], [1, 0.667, 0.333, 0, 0, 0]], 2.0),
    7: ([[0, 0, 0, 0.333, 0.667, 1, 2 / 3], [0, 0.333, 0.667, 0.667, 0.333, 0, 2 / 3], [1, 0.667, 0.333, 0, 0, 0, 2 / 3]], 2.0),
}


def channels_to_rgb(n: int) -> list[tuple[int, list[float]]]:
    """(channel, [red, green, blue] weights) for 1 to 7 channels ordered from blue to red."""
    if n not in RGB_WEIGHTS:
        raise ValueError("1 to 7 channels")
    rows, scale = RGB_WEIGHTS[n]
    return [(k, [rows[c][k] / scale for c in range(3)]) for k in range(n)]


def to_rgb_linear(pixels: DataFrame, channels: list[str], weights: list[tuple[int, list[float]]] | None = None) -> DataFrame:
    """The weighted sums of bands in the colours r, g, b; one narrow aggregation, no join."""
    weights = channels_to_rgb(len(channels)) if weights is None else weights
    share = lambda c: F.coalesce(*[F.when(F.col("band") == channels[k], F.lit(w[c])) for k, w in weights], F.lit(0.0))
    return pixels.groupBy(IMAGE, "y", "x").agg(*[F.sum(share(c) * F.col("value")).alias(n) for c, n in enumerate("rgb")])


def percentile_stretch(pixels: DataFrame, lo: float = 1, hi: float = 99, kind: str = "linear") -> DataFrame:
    """``level`` 0..255: each image clipped at two percentiles of its values, scaled linearly or by asinh.

    asinh takes the range as stretch and range / sinh(1) as softening, so that the top maps to 1.
    """
    ends = pixels.groupBy(IMAGE).agg(F.percentile("value", F.lit(lo / 100)).alias("lo"), F.percentile("value", F.lit(hi / 100)).alias("hi"))
    share = (F.greatest(F.least(F.col("value"), F.col("hi")), F.col("lo")) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    if kind == "asinh":
        share = F.asinh(share * F.sinh(F.lit(1.0)))
    return pixels.join(ends, IMAGE).withColumn("level", F.coalesce(F.floor(share * 255 + 1e-9), F.lit(0)).cast("int")).drop("lo", "hi")


def inject_noise(pixels: DataFrame, factor: float, seed: int) -> DataFrame:
    """Values with Gaussian noise of ``factor`` times the rms added, weights divided by factor + 1; a pixel's noise follows from the seed and its place."""
    normal = F.sqrt(-2 * F.log(uniform(seed, "radius", *PLACE))) * F.cos(2 * math.pi * uniform(seed, "angle", *PLACE))
    rms = F.when(F.col("weight") > 0, 1 / F.sqrt("weight")).otherwise(0.0)
    return pixels.withColumn("value", F.col("value") + normal * rms * F.sqrt(F.lit(float(factor)))).withColumn("weight", F.col("weight") / (factor + 1))


def center_flux(image: DataFrame, catalog: DataFrame, radius: int = 1) -> DataFrame:
    """Each source at the brightest pixel within ``radius`` rows and columns; ties take the lowest y, then x."""
    steps = ", ".join(f"({dy}, {dx})" for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))
    near = catalog.selectExpr(IMAGE, "source_id", "y AS y_in", "x AS x_in", f"inline(array({steps})) AS (dy, dx)").selectExpr(IMAGE, "source_id", "y_in + dy AS y", "x_in + dx AS x")
    best = near.join(image.select(IMAGE, "y", "x", "value"), [IMAGE, "y", "x"]).groupBy(IMAGE, "source_id").agg(F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"))
    return best.selectExpr(IMAGE, "source_id", "-b.ny AS y", "-b.nx AS x", "b.value AS value")


def sum_coadd(pixels: DataFrame) -> DataFrame:
    """The sum of all bands."""
    return pixels.groupBy(IMAGE, "y", "x").agg(F.sum("value").alias("value"))


def chi2_coadd(pixels: DataFrame, noise: DataFrame) -> DataFrame:
    """The sum over bands of value / rms squared; ``noise`` has image_id, band, rms."""
    return pixels.join(noise, [IMAGE, "band"]).groupBy(IMAGE, "y", "x").agg(F.sum(F.col("value") / (F.col("rms") * F.col("rms"))).alias("value"))


def spectrum_coadd(pixels: DataFrame, spectra: DataFrame | None = None) -> DataFrame:
    """The optimal coadd for a spectrum and its noise: sum of s d / var, and the root of the sum of s squared / var.

    ``spectra`` has image_id, band, s (1 where there is none); masked pixels take no part.
    """
    joined = pixels.withColumn("s", F.lit(1.0)) if spectra is None else pixels.join(spectra, [IMAGE, "band"])
    used = joined.where(~F.coalesce("masked", F.lit(False)) & (F.col("variance") > 0))
    return used.groupBy(IMAGE, "y", "x").agg(F.sum(F.col("s") * F.col("value") / F.col("variance")).alias("value"), F.sqrt(F.sum(F.col("s") * F.col("s") / F.col("variance"))).alias("std"))
