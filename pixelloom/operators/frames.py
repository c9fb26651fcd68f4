"""Frames: image sizes, channel maps and affine coordinates as columns and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.grid import IMAGE, explode_grid


def frame_of(pixels: DataFrame) -> DataFrame:
    """Number and sorted list of channels, height and width of each image."""
    return pixels.groupBy(IMAGE).agg(F.countDistinct("band").alias("n_channels"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"), F.sort_array(F.collect_set("band")).alias("channels"))


def channel_map(frames: DataFrame, observed: str = "observed", model: str = "channels") -> DataFrame:
    """For each observed channel its position in the model's list, and whether an image's positions are one run.

    Observed channels that the model lacks are left out.
    """
    m = frames.select(IMAGE, F.posexplode(model).alias("model_index", "band"))
    o = frames.select(IMAGE, F.posexplode(observed).alias("obs_index", "band"))
    found = o.join(m, [IMAGE, "band"])
    runs = found.groupBy(IMAGE).agg(((F.max("model_index") - F.min("model_index") + 1) == F.count(F.lit(1))).alias("contiguous"))
    return found.join(runs, IMAGE).select(IMAGE, "band", "obs_index", "model_index", "contiguous")


def map_channels(pixels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bands as ``mapping`` says: columns image_id, band, out_band and, for a mix, weight.

    Each output band is the weighted sum of the bands mapped to it; without weights they count once.
    """
    weight = F.col("weight") if "weight" in mapping.columns else F.lit(1)
    return pixels.join(mapping, [IMAGE, "band"]).groupBy(IMAGE, F.col("out_band").alias("band"), "y", "x").agg(F.sum(weight * F.col("value")).alias("value"))


def plane(df: DataFrame, frames: DataFrame) -> DataFrame:
    return df.join(frames.select(IMAGE, "pc11", "pc12", "pc21", "pc22", "crpix1", "crpix2", "crval1", "crval2"), IMAGE)


def pixel_to_sky(points: DataFrame, frames: DataFrame, tangent: bool = False) -> DataFrame:
    """``ra``, ``dec`` of pixel positions: the axes flip, so x goes with the first world axis.

    Affine by the PC matrix; with ``tangent`` the plane is projected back to the sphere around crval (degrees).
    """
    flat = plane(points, frames).selectExpr(*points.columns, "pc11 * (x - crpix1) + pc12 * (y - crpix2) AS u", "pc21 * (x - crpix1) + pc22 * (y - crpix2) AS w", "crval1", "crval2")
    if not tangent:
        return flat.selectExpr(*points.columns, "crval1 + u AS ra", "crval2 + w AS dec")
    return flat.selectExpr(
        *points.columns,
        "crval1 + degrees(atan2(radians(u), cos(radians(crval2)) - radians(w) * sin(radians(crval2)))) AS ra",
        "degrees(atan((sin(radians(crval2)) + radians(w) * cos(radians(crval2))) / sqrt(pow(cos(radians(crval2)) - radians(w) * sin(radians(crval2)), 2) + pow(radians(u), 2)))) AS dec",
    )


def sky_to_pixel(points: DataFrame, frames: DataFrame, tangent: bool = False) -> DataFrame:
    """The inverse of ``pixel_to_sky``: adds y, x."""
    names = [c for c in points.columns if c not in ("ra", "dec")]
    joined = plane(points, frames)
    if tangent:
        cosc = "(sin(radians(crval2)) * sin(radians(dec)) + cos(radians(crval2)) * cos(radians(dec)) * cos(radians(ra - crval1)))"
        flat = joined.selectExpr("*", f"degrees(cos(radians(dec)) * sin(radians(ra - crval1)) / {cosc}) AS u", f"degrees((cos(radians(crval2)) * sin(radians(dec)) - sin(radians(crval2)) * cos(radians(dec)) * cos(radians(ra - crval1))) / {cosc}) AS w")
    else:
        flat = joined.selectExpr("*", "ra - crval1 AS u", "dec - crval2 AS w")
    det = "(pc11 * pc22 - pc12 * pc21)"
    return flat.selectExpr(*names, f"(pc11 * w - pc21 * u) / {det} + crpix2 AS y", f"(pc22 * u - pc12 * w) / {det} + crpix1 AS x")


def convert_pixels(points: DataFrame | None, frames: DataFrame, target: DataFrame) -> DataFrame:
    """y_to, x_to: positions of one frame's pixels in another; all pixels of the frame if no points are given."""
    if points is None:
        points = explode_grid(frames.select(IMAGE, "ny", "nx"), "0", "ny", "0", "nx").select(IMAGE, "y", "x")
    sky = pixel_to_sky(points, frames).withColumnsRenamed({"y": "y_from", "x": "x_from"})
    return sky_to_pixel(sky, target).withColumnsRenamed({"y": "y_to", "x": "x_to"})


def pixel_scale(frames: DataFrame) -> DataFrame:
    """``scale``: the size of a pixel, the root of the determinant of the PC matrix."""
    return frames.selectExpr(IMAGE, "sqrt(abs(pc11 * pc22 - pc12 * pc21)) AS scale")


def frame_rotation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine and sine of the angle between two frames' first axes, and the ratio of their pixel sizes."""
    other = b.selectExpr(IMAGE, "pc11 AS b11", "pc21 AS b21", "pc12 AS b12", "pc22 AS b22")
    norm = "sqrt((pc11 * pc11 + pc21 * pc21) * (b11 * b11 + b21 * b21))"
    return a.join(other, IMAGE).selectExpr(IMAGE, f"(pc11 * b11 + pc21 * b21) / {norm} AS cos", f"(pc11 * b21 - pc21 * b11) / {norm} AS sin", "sqrt(abs(pc11 * pc22 - pc12 * pc21) / abs(b11 * b22 - b12 * b21)) AS ratio")


def match_kind(observed: DataFrame, model: DataFrame) -> DataFrame:
    """How a model frame is rendered to an observation: null, convolve or resample.

    Both have image_id, psf (a label, null: none) and the frame's matrix; equal sampling without a
    psf difference needs nothing.
    """
    other = model.selectExpr(IMAGE, "psf AS psf_m", "pc11 AS m11", "pc12 AS m12", "pc21 AS m21", "pc22 AS m22")
    same = "abs(pc11 - m11) < 1e-9 AND abs(pc12 - m12) < 1e-9 AND abs(pc21 - m21) < 1e-9 AND abs(pc22 - m22) < 1e-9"
    return observed.join(other, IMAGE).selectExpr(IMAGE, f"CASE WHEN NOT ({same}) THEN 'resample' WHEN psf <=> psf_m OR psf IS NULL THEN 'null' ELSE 'convolve' END AS kind")


def common_frame(obs: DataFrame, coverage: str = "union", pad: int = 0) -> DataFrame:
    """The joint frame of an image's observations.

    ``obs`` has image_id, obs_id, y0, y1, x0, x1, channels, scale, psf_size. The box is the union or the
    intersection, padded on all sides; channels are listed one observation after
    the other; the finest pixel and the observations with the narrowest and widest psf are named.
    """
    low, high = (F.min, F.max) if coverage == "union" else (F.max, F.min)
    joint = obs.groupBy(IMAGE).agg(
        (low("y0") - pad).alias("y0"), (high("y1") + pad).alias("y1"), (low("x0") - pad).alias("x0"), (high("x1") + pad).alias("x1"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("obs_id", "channels"))), lambda s: s["channels"])).alias("channels"),
        F.min("scale").alias("scale"), F.min_by("obs_id", F.struct("psf_size", "obs_id")).alias("narrowest"), F.max_by("obs_id", F.struct("psf_size", "obs_id")).alias("widest"),
    )
    return joint.withColumn("y1", F.greatest("y0", "y1")).withColumn("x1", F.greatest("x0", "x1"))


def project_to_frame(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Data on another frame of equal sampling: y, x relative to the box of its image, zero outside of the data."""
    cells = explode_grid(boxes.join(pixels.select(IMAGE, "band").distinct(), IMAGE), "y0", "y1", "x0", "x1")
    out = cells.join(pixels.select(IMAGE, "band", "y", "x", "value"), [IMAGE, "band", "y", "x"], "left")
    return out.selectExpr(IMAGE, "band", "y - y0 AS y", "x - x0 AS x", "coalesce(value, 0) AS value")
