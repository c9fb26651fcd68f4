"""Photometry and shape measurement as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.grid import IMAGE, PLACE
from pixelloom.operators.models import component_model

BAND = (IMAGE, "band")
SOURCE = (IMAGE, "source_id")


def flux(df: DataFrame, by: tuple[str, ...] = BAND) -> DataFrame:
    """``flux``: the sum of values of each group."""
    return df.groupBy(*by).agg(F.sum("value").alias("flux"))


def magnitude(df: DataFrame, zeropoint: float = 27) -> DataFrame:
    """``mag``: zeropoint - 2.5 log10(flux), null for a flux that isn't positive."""
    return df.withColumn("mag", F.when(F.col("flux") > 0, zeropoint - 2.5 * F.log10("flux")))


def centroid(df: DataFrame, by: tuple[str, ...] = BAND) -> DataFrame:
    """``cy``, ``cx``: flux-weighted mean positions; null where the flux is 0."""
    total = F.nullif(F.sum("value"), F.lit(0))
    return df.groupBy(*by).agg((F.sum(F.col("y") * F.col("value")) / total).alias("cy"), (F.sum(F.col("x") * F.col("value")) / total).alias("cx"))


def max_pixel(df: DataFrame, by: tuple[str, ...] = BAND) -> DataFrame:
    """The brightest pixel of each group, the first in row-major order of equals."""
    top = df.groupBy(*by).agg(F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("t"))
    return top.selectExpr(*by, "-t.ny AS y", "-t.nx AS x", "t.value AS value")


def moments(df: DataFrame, n: int = 2, center: DataFrame | None = None, by: tuple[str, ...] = BAND, weight: str | None = None) -> DataFrame:
    """``m_p_q``: sums of (y - cy)^p (x - cx)^q value weight for all p + q <= n, in one aggregation.

    ``center`` has image_id, cy, cx; the default is the pixel (ny div 2, nx div 2).
    """
    if center is None:
        center = df.groupBy(IMAGE).agg(F.expr("(max(y) + 1) div 2").alias("cy"), F.expr("(max(x) + 1) div 2").alias("cx"))
    v = F.col("value") if weight is None else F.col("value") * F.col(weight)
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    power = lambda c, p: F.lit(1) if p == 0 else c if p == 1 else F.pow(c, F.lit(p))
    return df.join(center, IMAGE).groupBy(*by).agg(*[F.sum(power(dy, p) * power(dx, t - p) * v).cast("double").alias(f"m_{p}_{t - p}") for t in range(n + 1) for p in range(t + 1)])


def model_snr(df: DataFrame, model: DataFrame, by: tuple[str, ...] = (IMAGE,)) -> DataFrame:
    """``snr``: sum of M W over the root of the sum of var W^2, with W the model normalised within each band."""
    share = F.col("m") / F.nullif(F.sum("m").over(Window.partitionBy(*by, "band")), F.lit(0))
    m = model.select(*dict.fromkeys([*by, *PLACE]), F.col("value").alias("m")).withColumn("w", share)
    return m.join(df.select(*PLACE, "variance"), PLACE).groupBy(*by).agg((F.sum(F.col("m") * F.col("w")) / F.sqrt(F.sum(F.col("variance") * F.col("w") * F.col("w")))).alias("snr"))


def stamped(pixels: DataFrame, psf: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pixels around each source with the psf's weight there: image_id, source_id, band, k and the pixel's columns."""
    near = catalog.select(*SOURCE, F.col("y").alias("sy"), F.col("x").alias("sx")).join(psf, [c for c in (IMAGE,) if c in psf.columns])
    at = near.select(*SOURCE, "band", (F.col("sy") + F.col("dy")).alias("y"), (F.col("sx") + F.col("dx")).alias("x"), "k")
    return at.join(pixels, PLACE)


def psf_snr(pixels: DataFrame, psf: DataFrame, catalog: DataFrame) -> DataFrame:
    """``snr`` of a psf-shaped source at each position: sum img psf over the root of the sum of psf^2 var, over all bands."""
    k, v = F.col("k"), F.col("value")
    return stamped(pixels, psf, catalog).groupBy(*SOURCE).agg((F.sum(v * k) / F.sqrt(F.sum(k * k * F.col("variance")))).alias("snr"))


def pixel_spectrum(pixels: DataFrame, catalog: DataFrame, correct: DataFrame | None = None) -> DataFrame:
    """``sed``: each band's value at the rounded centre, divided by a peak per band if given; ``bad``: not positive.

    ``correct`` has band or source keys and ``peak`` (of the psf or of a model).
    """
    at = catalog.select(*SOURCE, F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"))
    sed = at.join(pixels.select(*PLACE, "value"), [IMAGE, "y", "x"])
    if correct is not None:
        sed = sed.join(correct, [c for c in (*SOURCE, "band") if c in correct.columns]).withColumn("value", F.col("value") / F.col("peak"))
    return sed.select(*SOURCE, "band", F.col("value").alias("sed"), (F.col("value") <= 0).alias("bad"))


def psf_spectrum(pixels: DataFrame, psf: DataFrame, catalog: DataFrame) -> DataFrame:
    """``sed``: the matched filter img psf / psf psf over unmasked pixels of each band.

    Pixels outside of the image count as unmasked zeros, as their psf weight stays in the denominator.
    """
    near = catalog.select(*SOURCE, F.col("y").alias("sy"), F.col("x").alias("sx")).join(psf, [c for c in (IMAGE,) if c in psf.columns])
    at = near.select(*SOURCE, "band", (F.col("sy") + F.col("dy")).alias("y"), (F.col("sx") + F.col("dx")).alias("x"), "k").join(pixels.select(*PLACE, "value", "masked"), PLACE, "left").where(~F.coalesce("masked", F.lit(False)))
    return at.groupBy(*SOURCE, "band").agg((F.coalesce(F.sum(F.col("value") * F.col("k")), F.lit(0)) / F.sum(F.col("k") * F.col("k"))).alias("sed"))


def psf_size(psf: DataFrame) -> DataFrame:
    """``size``: three sigma of each psf, sigma from the area above half of its maximum."""
    half = F.max("k").over(Window.partitionBy(*BAND)) / 2
    area = psf.withColumn("half", half).groupBy(*BAND).agg(F.sum(F.when(F.col("k") > F.col("half"), 1).otherwise(0)).alias("area"))
    return area.select(*BAND, (3 * F.sqrt(F.col("area") / math.pi) / math.sqrt(2 * math.log(2))).alias("size"))


def min_psf(psf: DataFrame, thresh: float = 0.01) -> DataFrame:
    """``radius``: the largest distance at which any two bands of an image differ by more than ``thresh`` of the peak.

    The spread over bands (greatest less least) says so without pairs; crop with it.
    """
    spread = psf.groupBy(IMAGE, "dy", "dx").agg((F.max("k") - F.min("k")).alias("d"))
    peak = psf.groupBy(IMAGE).agg(F.max("k").alias("peak"))
    return spread.join(peak, IMAGE).groupBy(IMAGE).agg(F.max(F.when(F.col("d") > thresh * F.col("peak"), F.greatest(F.abs("dy"), F.abs("dx"))).otherwise(0)).alias("radius"))


def log_norm(pixels: DataFrame) -> DataFrame:
    """``log_norm``: D / 2 log 2 pi + the sum of log sigma over the D unmasked pixels of each image."""
    used = F.col("weight") > 0
    return pixels.groupBy(IMAGE).agg((F.sum(F.when(used, 1).otherwise(0)) / 2 * math.log(2 * math.pi) + F.sum(F.when(used, -F.log("weight") / 2).otherwise(0.0))).alias("log_norm"))


def log_likelihood(pixels: DataFrame, model: DataFrame) -> DataFrame:
    """``logl``: - log_norm - sum of w r^2 / 2, over all observations of an image."""
    return log_norm(pixels).join(lite_log_likelihood(pixels, model), IMAGE).select(IMAGE, (F.col("logl") - F.col("log_norm")).alias("logl"))


def lite_log_likelihood(pixels: DataFrame, model: DataFrame) -> DataFrame:
    """``logl``: minus half the sum of w r^2."""
    r = F.col("value") - F.coalesce("m", F.lit(0))
    return pixels.join(model.select(*PLACE, F.col("value").alias("m")), PLACE, "left").groupBy(IMAGE).agg((-0.5 * F.sum(F.col("weight") * r * r)).alias("logl"))


def component_count(df: DataFrame, min_snr: float = 50, min_components: int = 1, max_components: int = 2, lite: bool = False) -> DataFrame:
    """``k``: components for a source's ``snr``: floor(snr / min_snr) within bounds; lite: psf below 1, single below 2, else bulge and disk."""
    ratio = F.floor(F.col("snr") / min_snr)
    if lite:
        return df.withColumn("k", F.when(F.col("snr") / min_snr < 1, "psf").when(F.col("snr") / min_snr < 2, "single").otherwise("double"))
    return df.withColumn("k", F.least(F.lit(max_components), F.greatest(F.lit(min_components), ratio)).cast("int"))


def measure_blend(mags: DataFrame, catalog: DataFrame, truth: DataFrame, bands: list[str]) -> DataFrame:
    """One row for each detection at a true position: magnitude, truth and their difference in every band, as columns.

    Detections without a true source at their very pixel are dropped.
    """
    found = catalog.join(truth.withColumnRenamed("mag", "true_mag"), [IMAGE, "y", "x"]).join(mags.select(*SOURCE, "band", "mag"), [*SOURCE, "band"])
    at = lambda b, c: F.max(F.when(F.col("band") == b, F.col(c)))
    return found.groupBy(*SOURCE, "y", "x").agg(*[e for b in bands for e in (at(b, "mag").alias(f"{b}_mag"), at(b, "true_mag").alias(f"{b}_truth"), (at(b, "true_mag") - at(b, "mag")).alias(f"{b}_diff"))])


def color_similarity(seds: DataFrame, reference: DataFrame, threshold: float = 0.995) -> DataFrame:
    """``cosine`` of each source's SED with its image's reference source (image_id, source_id), and whether it is ``similar``."""
    ref = seds.join(reference, list(SOURCE), "left_semi").select(IMAGE, "band", F.col("sed").alias("ref"))
    a, b = F.col("sed").cast("double"), F.col("ref").cast("double")
    cosine = seds.join(ref, [IMAGE, "band"]).groupBy(*SOURCE).agg((F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"))
    return cosine.withColumn("similar", F.col("cosine") > threshold)


def similar_model(seds: DataFrame, morphs: DataFrame, reference: DataFrame, threshold: float = 0.995) -> DataFrame:
    """image_id, band, y, x, value, n_sources: the summed model of the sources whose colour is like the image's reference source's, itself included."""
    like = color_similarity(seds.groupBy(*SOURCE, "band").agg(F.sum("sed").alias("sed")), reference, threshold).where("similar").select(*SOURCE)
    like = like.unionByName(reference.select(*SOURCE)).distinct()
    parts = component_model(seds.join(like, list(SOURCE), "left_semi"), morphs).groupBy(*PLACE, "source_id").agg(F.sum("value").alias("value"))
    return parts.groupBy(*PLACE).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_sources"))


def compare_spectra(runs: dict[str, DataFrame]) -> DataFrame:
    """Each source's SED in each run (tables image_id, source_id, band, value), as columns; a source that a run lacks is null there."""
    parts = [df.select(*SOURCE, "band", F.col("value"), F.lit(name).alias("run")) for name, df in runs.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*SOURCE, "band").pivot("run", list(runs)).agg(F.sum("value"))


def sdr(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """``sdr``: 10 log10 of the norm of the truth over the norm of the error."""
    t, e = F.col("value").cast("double"), F.coalesce("e", F.lit(0)).cast("double")
    return truth.join(estimate.select(*PLACE, F.col("value").alias("e")), PLACE, "left").groupBy(IMAGE).agg((10 * F.log10(F.sqrt(F.sum(t * t)) / F.sqrt(F.sum((t - e) * (t - e))))).alias("sdr"))


def redistribute_flux(pixels: DataFrame, models: DataFrame) -> DataFrame:
    """Each source's share of the data: data x its rendered model over the sum of all, between 0 and 1; masked pixels give 0.

    ``models`` has image_id, source_id, band, y, x, value: a rendered model within the source's grown box.
    """
    total = models.groupBy(*PLACE).agg(F.sum("value").alias("total"))
    share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") / F.nullif("total", F.lit(0)))), F.lit(0.0))
    seen = models.withColumnRenamed("value", "m").join(total, PLACE).join(pixels.select(*PLACE, "value", "masked"), PLACE)
    return seen.select(*SOURCE, "band", "y", "x", F.when(F.coalesce("masked", F.lit(False)), 0.0).otherwise(F.col("value") * share).alias("value"))


def param_snr(df: DataFrame, value: str = "m", second: str = "m2") -> DataFrame:
    """``snr``: value over its deviation 1 / sqrt(second moment); null where the moment is 0."""
    return df.withColumn("snr", F.when(F.col(second) > 0, F.col(value) * F.sqrt(second)))
